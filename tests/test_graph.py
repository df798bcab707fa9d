"""Traversals on small graphs with cycles, and set-valued operators against plain Python."""

import random

import pytest

from weftgraph.operators import access, graph, traverse, versions


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


CYCLES = {"two": [("A", "B"), ("B", "A")], "self": [("A", "A")], "three": [("A", "B"), ("B", "C"), ("C", "A"), ("A", "D")], "diamond": [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A")]}


@pytest.mark.parametrize("name", CYCLES)
def test_closure_ends_on_cycles(spark, name):
    e = CYCLES[name]
    got = {r.id: r.depth for r in traverse.closure(spark, edges(spark, e), ids(spark, "A")).collect()}
    want, front, depth = {"A": 0}, {"A"}, 0
    while front:
        depth += 1
        front = {b for a, b in e if a in front} - set(want)
        want |= {x: depth for x in front}
    assert got == want


def test_chain(spark):
    e = edges(spark, [("main", "foo"), ("foo", "bar"), ("bar", "baz"), ("baz", "leaf")])
    at = lambda s, d, n: sorted(r.id for r in traverse.chain_levels(spark, e, ids(spark, s), d, n).collect())
    assert at("main", "down", 2) == ["bar", "foo", "main"] and len(at("main", "down", 5)) == 5 and len(at("leaf", "up", 5)) == 5


@pytest.mark.parametrize("seed", range(3))
def test_paths_against_python(spark, seed):
    r = random.Random(seed)
    names = "abcdef"
    e = sorted({(r.choice(names), r.choice(names)) for _ in range(14)})
    want = []

    def walk(path):
        for a, b in e:
            if a == path[-1] and b not in path and len(path) <= 3:
                want.append(tuple([*path, b]))
                walk([*path, b])

    walk(["a"])
    got = [tuple(x.path) for x in traverse.simple_paths(spark, edges(spark, e), ids(spark, "a"), 3).collect()]
    assert sorted(got) == sorted(want)
    to_b = [tuple(x.path) for x in traverse.simple_paths(spark, edges(spark, e), ids(spark, "a"), 3, ends=ids(spark, "b")).collect()]
    assert sorted(to_b) == sorted(p for p in want if p[-1] == "b")
    tree = {x.id: (x.depth, x.parent) for x in traverse.shortest_paths(spark, edges(spark, e), ids(spark, "a")).collect()}
    for n, (d, p) in tree.items():
        assert p is None and d == 0 or (p, n) in e and tree[p][0] == d - 1


def test_components(spark):
    e = [("a", "b"), ("c", "b"), ("d", "e")] + [(f"z{i}", f"z{i + 1}") for i in range(10, 30)]
    nodes = ids(spark, *sorted({x for p in e for x in p} | {"lone"}))
    got = {r.id: r.component for r in traverse.components(spark, edges(spark, e), nodes).collect()}
    assert got["c"] == got["a"] == "a" and got["e"] == "d" and got["z29"] == "z10" and got["lone"] == "lone"


@pytest.mark.parametrize("seed", range(3))
def test_races_are_counted_right(spark, seed):
    r = random.Random(seed)
    rows = sorted({(f"f{r.randrange(12)}", f"r{r.randrange(3)}") for _ in range(60)})
    rows = [(f, x, r.random() < 0.4, r.choice("mn") if r.random() < 0.9 else None, r.choice("kl")) for f, x in rows]
    one = spark.createDataFrame([(x, f, w, m, k) for f, x, w, m, k in rows], "res string, fn string, w boolean, model string, lock string")
    want = {}
    for i, (f, x, w, m, k) in enumerate(rows):
        for g, y, v, n, j in rows[i + 1 :]:
            if x == y and m != n and k != j and (w or v):
                want[x] = want.get(x, 0) + 1
    assert {q.res: q.n_races for q in access.race_summary(one).collect() if q.n_races} == want
    partners = sum(q.n_partners for q in access.race_partners(one).collect())
    assert partners == 2 * sum(want.values())


def test_locks_are_held_not_counted(spark):
    ev = [(1, t, x) for t, x in enumerate(["acq", "acq", "use", "rel", "use", "rel", "use", "acq", "use"])]
    df = spark.createDataFrame(ev, "k int, t int, x string")
    got = access.held_regions(df, "k", ["t"], df.x == "acq", df.x == "rel").where("x = 'use'").orderBy("t").collect()
    assert [r.held for r in got] == [True, False, False, True]


def test_prune_matches_endings_only_behind_a_slash(spark):
    n = spark.createDataFrame([("a/b/c.c",), ("b/c.c",), ("xb/c.c",), ("c.c",), (None,)], "p string")
    left = versions.prune_by_source(n, spark.createDataFrame([("b/c.c",)], "path string"), "p")
    assert sorted((r.p or "") for r in left.collect()) == ["", "c.c", "xb/c.c"]


def test_merge_keeps_rows_without_a_key(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("x", 3), ("y", 4), (None, 5)], "k string, v int")
    assert sorted(r.v for r in versions.merge_local_wins(a, b, "k").collect()) == [1, 2, 4, 5]


def test_hot_function_is_counted_by_caller(spark):
    n = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "id string, domain string")
    e = edges(spark, [("a", "b")] * 5 + [("a", "c"), ("b", "c")])
    assert [tuple(r) for r in graph.hotspots(n, e).collect()] == [("x", "y", 6)]
