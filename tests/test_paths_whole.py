"""Paths and chains are followed to their end, held against a search by hand."""

from datetime import datetime, timedelta

from weftgraph.queries.pathqueries import QUERIES

CHAIN = [f"f{i}" for i in range(12)]
SIDE = [f"c{i}" for i in range(1, 5)]


def test_chains_beyond_six_hops(spark, make_store):
    calls = [(a, b, None) for a, b in zip(CHAIN, CHAIN[1:])] + [("f0", "c1", "A")] + [(a, b, None) for a, b in zip(SIDE, SIDE[1:])]
    edges = [{"id": i, "invoker_id": a, "invoked_id": b, "relation": "INVOKES", "call_condition": c} for i, (a, b, c) in enumerate(calls)]
    root = make_store(edges=edges, functions=[{"id": f, "name": f} for f in CHAIN + SIDE])
    assert {(r.id, r.depth) for r in QUERIES["resolve_chain_whole"](spark, root).collect()} == {(f, i) for i, f in enumerate(CHAIN)}
    assert {r["where"]: r.n for r in QUERIES["diff_chains_whole"](spark, root).collect()} == {"both": len(CHAIN), "only_a": len(SIDE)}


def test_four_hops_back(spark, make_store):
    kinds = ["signup", "view", "click", "purchase", "error"]
    events = [{"event_id": i, "user_id": 1, "event_type": k, "ts": datetime(2024, 1, 1) + timedelta(minutes=i)} for i, k in enumerate(kinds)]
    got = {(r.path, r.hops, r.entry) for r in QUERIES["reverse_trace_whole"](spark, make_store(events=events)).collect()}
    assert got == {(">".join(f"1:{k}" for k in kinds[4 - n :]), n, n == 4) for n in range(1, 5)}
