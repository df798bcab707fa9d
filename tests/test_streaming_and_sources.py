from datetime import datetime, timedelta

import pytest

from weftgraph.functions import conditions
from weftgraph.operators import inference, paths
from weftgraph.sources import scan
from weftgraph.sources.transactions import ConflictError, VersionedStore
from weftgraph.streaming import maintenance as M

T = datetime(2024, 1, 1)
EVENT = "ts timestamp, key string, v int"


def put(spark, path, rows, schema=EVENT):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [(T + timedelta(minutes=k), f"k{k % 3}", k) for k in range(60)]
    put(spark, src, rows)
    put(spark, src, [(T + timedelta(days=1), "end", 0)])  # moves the watermark
    stream = M.windowed_counts(M.file_stream(spark, src, EVENT, 1), "ts", ["key"], "10 minutes")
    M.run_now(stream, f"{tmp_path}/cp", f"{tmp_path}/out")
    got = {(r.start, r.key): r.n for r in spark.read.parquet(f"{tmp_path}/out").where("key <> 'end'").collect()}
    want = {}
    for t, k, _ in rows:
        start = T + timedelta(minutes=(t - T).seconds // 600 * 10)
        want[start, k] = want.get((start, k), 0) + 1
    assert got == want


def test_bursts(spark, tmp_path):
    src = f"{tmp_path}/in"
    put(spark, src, [(T + timedelta(seconds=s), "a", s) for s in (0, 1, 2, 60, 61)])
    put(spark, src, [(T + timedelta(days=1), "end", 0)])
    M.run_now(M.debounced(M.file_stream(spark, src, EVENT, 1), "ts", "key", "10 seconds"), f"{tmp_path}/cp", f"{tmp_path}/out")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").where("key = 'a'").collect()) == [2, 3]


def test_breaker_opens_and_cools_down(spark, tmp_path):
    src = f"{tmp_path}/in"
    put(spark, src, [(T + timedelta(seconds=s), "x", i) for s, n in ((0, 3), (1, 9), (20, 1), (50, 1), (200, 1)) for i in range(n)])
    stream = M.breaker(M.file_stream(spark, src, EVENT), "key", "ts", most=10, seconds=15, cooldown=30)
    M.run_now(stream, f"{tmp_path}/cp", f"{tmp_path}/out")
    got = [(int((r.ts - T).total_seconds()), r.n, r.mode) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("ts").collect()]
    assert got == [(0, 3, "incremental"), (1, 12, "bulk"), (20, 1, "bulk"), (50, 1, "incremental"), (200, 1, "incremental")]


def test_upsert_keeps_the_newest_and_ignores_repeated_batches(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "id int, seq int, v string, gone boolean"
    put(spark, src, [(1, 1, "a", False), (2, 1, "b", False)], schema)
    put(spark, src, [(1, 3, "c", False), (1, 2, "late", False), (2, 5, "b", True)], schema)
    up = M.StreamingUpsert(spark, f"{tmp_path}/table", ["id"], "seq", schema, "gone")
    up.start(M.file_stream(spark, src, schema, 1), f"{tmp_path}/cp").awaitTermination()
    assert [tuple(r) for r in up.current().collect()] == [(1, 3, "c", False)]
    up(spark.createDataFrame([(9, 9, "again", False)], schema), 0)
    assert up.current().count() == 1


def test_edits_of_the_format_only(spark):
    rows = [("int  a; // x\n\n", "int a;"), ("int a; /* y */ int b;", "int a;\nint b;"), ("int a;", "int b;")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert [r[0] for r in df.select(M.normal_form(df.x) == M.normal_form(df.y)).collect()] == [True, True, False]


def test_scan_a_tree(spark, tmp_path):
    (tmp_path / "t/a").mkdir(parents=True)
    (tmp_path / "t/a/x.c").write_text('#include "y.h"\n#define N 3\n#ifdef A\n#endif\nstatic int f(int a)\n{\n    /* g(1) */ return g(a) + h("f(2)");\n}\nint g(int b) { return N; }\n')
    (tmp_path / "t/a/y.py").write_text("def p(x):\n    return q(x)\n\n\ndef q(x):\n    return x\n")
    (tmp_path / "t/a/z.txt").write_text("f(1)")
    found = scan.scan_tree(spark, f"{tmp_path}/t")
    rows = {(r.kind, r.name, r.line, r.detail) for r in found.collect()}
    assert {("function", "f", 5, "int a"), ("call", "g", 7, "f"), ("call", "h", 7, "f"), ("include", "y.h", 1, None), ("macro", "N", 2, "3"), ("condition", "ifdef", 3, "A"), ("function", "p", 1, "x"), ("call", "q", 2, "p")} <= rows
    nodes, edges = scan.graph_from_facts(found)
    names = {r.id: r.name for r in nodes.collect()}
    calls = {(names[r.src], names.get(r.dst, r.dst)) for r in edges.collect()}
    assert calls == {("f", "g"), ("f", "h"), ("p", "q")}


def test_json_graph_domains_and_index(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g/d.json").write_text('{"domain": "d", "nodes": [{"id": "a", "name": "a"}, {"id": "b"}], "edges": [{"src": "a", "dst": "b", "relation": "INVOKES"}]}')
    nodes, edges = scan.read_domain_json(spark, f"{tmp_path}/g")
    scan.write_domains(nodes, f"{tmp_path}/n")
    scan.write_index(edges, f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/n").where("domain = 'd'").count() == 2
    assert spark.read.json(f"{tmp_path}/i").first().callers == ["a"]


def test_rendered_tokens(spark):
    t = spark.createDataFrame([(1, 2, " ", "b"), (1, 1, None, "a"), (1, 10, "\n", "c")], "file_id int, seq int, preceding_whitespace string, spelling string")
    r = scan.render_tokens(t).first()
    assert r.text == "a b\nc" and len(r.sha256) == 64


def test_transactions(spark, tmp_path):
    s = VersionedStore(spark, f"{tmp_path}/s")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with s.transaction("first") as tx:
        tx.write("t", one)
    with pytest.raises(RuntimeError):
        with s.transaction("broken") as tx:
            tx.write("t", one.limit(0))
            raise RuntimeError
    assert s.read("t").count() == 2
    with s.transaction("second") as tx:
        tx.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(r.v for r in s.read("t").collect()) == ["a", "c", "d"] and s.read("t", 1).count() == 2
    with pytest.raises(ConflictError):
        with s.transaction("late") as tx:
            with s.transaction("faster") as other:
                other.write("u", one)
            tx.write("t", one)
    s.restore(1)
    assert s.read("t").count() == 2 and [x["version"] for x in s.snapshots()] == [4, 3, 2, 1]


@pytest.mark.parametrize(
    "text,macros,want",
    [("A && B", {"A": 1}, None), ("A && B", {"A": 0}, False), ("A || B", {"A": 1}, True), ("!defined(A)", {"A": None}, True), ("A == 3 && !(B < 2)", {"A": 3, "B": 2}, True), ("defined A", {}, None), ("0", {}, False), ("A > 2", {"A": "x"}, None)],
)
def test_conditions(text, macros, want):
    assert conditions.evaluate(conditions.parse(text), macros) is want


@pytest.mark.parametrize("text", ["", "A &&", "(A", "A B", "== 3"])
def test_bad_conditions(text):
    with pytest.raises(conditions.ConditionError):
        conditions.parse(text)


@pytest.mark.parametrize(
    "given,want",
    [(["x > 3", "x < 2"], (False, ["x"])), (["x > 3", "x < 5"], (True, [])), (["p == NULL", "p"], (False, ["p"])), (["x == 1 || x == 2", "x != 1"], (True, [])), (["x == 1 || x == 2", "x != 1", "x != 2"], (False, ["x"])), (["!(x >= 1)", "x == 1"], (False, ["x"])), (["f(x)", "x"], (True, [])), ([], (True, []))],
)
def test_feasible(given, want):
    assert conditions.feasible(given) == want


def test_truth_table_and_hold_regions():
    assert [v for _, v in conditions.truth_table("A && !B")] == [False, False, True, False]
    r = conditions.hold_regions([("acquire", "a"), ("acquire", "b"), ("release", "b"), ("release", "c")])
    assert r == {"regions": [("b", 1, 2)], "held": ["a"], "stray": ["c"], "balanced": False}


def test_parameter_flow(spark):
    args = spark.createDataFrame([("f", "g", 0, "&p->x"), ("f", "g", 1, "pp"), ("g", "h", 0, "a + 1"), ("h", "f", 0, "q")], "fn string, callee string, pos int, value string")
    params = spark.createDataFrame([("g", 0, "a"), ("g", 1, "b"), ("h", 0, "q"), ("f", 0, "p")], "fn string, pos int, name string")
    got = {(r.fn, r.name): r.depth for r in paths.param_flow(spark, args, params, spark.createDataFrame([("f", "p")], "fn string, name string")).collect()}
    assert got == {("f", "p"): 0, ("g", "a"): 1, ("h", "q"): 2}


def test_thread_models(spark):
    e = spark.createDataFrame([("m", "a"), ("a", "b"), ("w", "b"), ("b", "o"), ("o", "c")], "src string, dst string")
    entries = spark.createDataFrame([("m", "main", 1), ("w", "worker", 2)], "id string, model string, priority int")
    got = {r.id: r.model for r in paths.propagate_models(spark, e, entries, spark.createDataFrame([("o",), ("m",), ("w",)], "id string")).collect()}
    assert got == {"m": "main", "a": "main", "w": "worker", "b": "worker"}


def test_inference_passes(spark):
    n = spark.createDataFrame([("a", "alias_a", "d.x", "a.c"), ("b", "orig", "d.x", "b.c"), ("w", "call_run", "d", None), ("c", "user", "d", "c.c"), ("t", "impl", "d", "t.c"), ("u", "foo", "k.z", "foo.h"), ("v", "__foo", "k.y", "v.c"), ("p", "p", "d", "p.c"), ("p__cond_1_else", "x", "d", "p.c")], "id string, name string, domain string, source_file string")
    e = spark.createDataFrame([("c", "w"), ("c", "t")], "src string, dst string")
    reg = spark.createDataFrame([("ops", "run", "t"), ("ops", "run", "b")], "struct string, field string, target string")
    pair = lambda df: sorted((r.src, r.dst) for r in df.collect())
    assert pair(inference.alias_edges(spark.createDataFrame([("alias_a", "orig")], "alias string, original string"), n)) == [("a", "b")]
    assert pair(inference.finish(inference.wrapper_dispatch(n, e, reg), e)) == [("c", "b")]
    assert pair(inference.macro_bridges(n)) == [("u", "v")] and pair(inference.conditional_parents(n)) == [("p", "p__cond_1_else")]
    assert pair(inference.vtable_dispatch(spark.createDataFrame([("c", "ops", "run")], "src string, struct string, field string"), reg, 1)) == [("c", "b")]
    calls = spark.createDataFrame([("c", "run", "x->ops", "d"), ("a", "run", "y->ops", "d.x")], "src string, field string, chain string, domain string")
    given = spark.createDataFrame([("run", "x.ops", "t", "d"), ("run", "z.ops", "b", "d.x")], "field string, chain string, target string, domain string")
    assert pair(inference.field_dispatch(calls, given)) == [("a", "b"), ("c", "t")]
    cb = spark.createDataFrame([("c", "a", "t")], "src string, via string, target string")
    assert pair(inference.callback_bridges(spark.createDataFrame([("c", "a")], "src string, dst string"), cb)) == [("a", "t")]
    got = {r.callee: (r.dst, r.confidence) for r in inference.resolve_callees(
        spark.createDataFrame([("c", "c.c", "d", "impl"), ("c", "c.c", "d", "orig"), ("c", "c.c", "d", "m.impl"), ("c", "c.c", "d", "user"), ("c", "c.c", "d", "none")], "src string, file string, domain string, callee string"), n, spark.createDataFrame([("c.c", "orig", "b")], "file string, name string, id string")).collect()}
    assert got == {"impl": ("t", 0.75), "orig": ("b", 0.85), "m.impl": ("t", 0.60), "user": ("c", 0.95)}
