"""Syntax checking of source texts: lexers that turn a text into a string with one character a token, and
recursive-descent parsers over such strings."""

from weftgraph.llm.syntax.check import LANGUAGES, check, language_of  # noqa: F401
