"""Structured Streaming: change events, windows, a circuit breaker and incremental maintenance."""
