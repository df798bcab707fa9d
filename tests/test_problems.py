"""References, snapshots, skew and increments on small stores: nulls, repeated rows, ties, extra columns, failures."""

from datetime import datetime

import pytest

from tests.conftest import normal
from weftgraph.operators import incremental, orphans, skew, snapshots
from weftgraph.queries import problems
from weftgraph.workspace import Workspace

T = datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def messy():
    versions = [{"version_id": v, "commit_hash": f"c{v}"} for v in (1, 2, 4)]
    runs = [{"run_id": r, "version_id": v, "status": s} for r, v, s in ((1, 1, "ok"), (2, None, "failed"), (3, 2, "ok"), (4, 4, "ok"), (None, None, "ok"), (5, None, None))]
    functions = [{"id": i, "name": i, "first_seen_version": a, "last_seen_version": b} for i, a, b in (("f", 1, 2), ("f", 1, 2), ("g", 1, 4), ("f", 4, 4), ("h", 2, 2), (None, 1, 4), ("n", None, 4), ("m", 1, None))]
    edges = [{"id": k, "invoker_id": a, "invoked_id": b, "version_id": v, "relation": "INVOKES"} for k, a, b, v in (
        (1, "g", "f", 1), (1, "g", "f", 1), (2, "g", "f", 2), (3, "g", "f", 4), (4, None, "zz", 1), (5, "h", None, 2), (6, "g", "G", 1), (7, "n", "m", 1), (8, "g", "f", None), (9, "g", "", 1))]
    files = [{"delivery_id": d, "scan_run": r, "id": i, "path": f"a/b{i}.c", "is_deleted": x, "content_hash": c, "sha256": s} for d, r, i, x, c, s in (
        (1, 1, 10, False, "AB", None), (1, 1, 10, False, "AB", None), (2, 2, 10, True, None, None), (3, 3, 11, False, "", "x"), (4, 4, 10, False, "ab", None), (5, 4, 11, None, None, "X"), (6, 4, 12, False, None, None), (7, None, 13, False, "q", None), (8, 3, None, False, "q", None))]
    nodes = [{"version_id": v, "id": k, "fqn": q, "kind": kind, "signature": s, "attrs": a, "file_id": f, "loaded_at": t} for v, k, q, kind, s, a, f, t in (
        (1, 1, "p", "function", None, '{"a":1,"b":[1,2]}', 10, T), (1, 1, "p", "function", None, '{"a":1,"b":[1,2]}', 10, T), (2, 2, "p", "function", "", '{"b": [1, 2], "a": 1}', 10, T), (4, 3, "p", "function", "", '{"b": [2, 1], "a": 1}', 12, T),
        (1, 4, "q", "enum", None, None, None, None), (2, 5, "q", "enum", None, None, 99, T), (2, 6, "r", None, "x", "not json", 11, T), (4, 7, "r", None, "y", "not json", 11, T), (4, 8, None, "enum", None, None, 11, T), (None, 9, "s", "enum", None, None, 11, T))]
    return {"graph_versions": versions, "scan_runs": runs, "functions": functions, "edges": edges, "cgdb_files": files, "cgdb_nodes": nodes}


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("name", ["p1_found", "p1_counts", "p3_found", "p3_edge_counts", "p6_found"])
def test_messy_store_as_sql_says(spark, make_store, oracle, name, clashing):
    root = make_store(clashing, **messy())
    assert normal(problems.QUERIES[name](spark, root).collect()) == normal(oracle(root, problems.SQL[name]))


def test_orphans_by_hand(spark, make_store):
    root = make_store(**messy())
    found = rows(problems.p1_found(spark, root))
    assert ("edges", "invoked_id", 2, 2) in found and ("edges", "invoked_id", 1, 1) not in found and ("edges", "invoked_id", 3, 4) not in found
    assert ("edges", "invoked_id", 6, 1) in found  # keys are compared as written
    assert ("cgdb_nodes", "file_id", 2, 2) in found  # deleted by the failed run before


def test_pending_state_resolves_and_reopens(spark, tmp_path):
    work = Workspace(spark, "t", str(tmp_path / "t"))
    ref = lambda n: spark.createDataFrame([("r", "k", n)], orphans.REFS)
    parent = lambda d: spark.createDataFrame([("r", "k", d, None)], orphans.PARENTS)
    none_r, none_p = spark.createDataFrame([], orphans.REFS), spark.createDataFrame([], orphans.PARENTS)
    step = lambda *a: orphans.OrphanTracker(spark, work).advance(*a).first().asDict()  # noqa: E731  (a new tracker goes on)
    assert step(1, ref(3), none_p)["opened"] == 3
    assert step(2, none_r, parent(1))["resolved"] == 3
    assert step(3, ref(2), none_p)["opened"] == 0
    last = step(4, none_r, parent(-1))
    assert last["reopened"] == 5 and last["refs"] == 5 and last["pending"] == 5


def test_an_epoch_writes_only_the_keys_it_touches(spark, tmp_path):
    track = orphans.OrphanTracker(spark, Workspace(spark, "t", str(tmp_path / "t")))
    none_p = spark.createDataFrame([], orphans.PARENTS)
    assert track.advance(1, spark.range(1000).selectExpr("'r' as ref", "cast(id as string) as key", "1L as n"), none_p).count() == 1000
    assert track.advance(2, spark.createDataFrame([("r", "5", 2)], orphans.REFS), none_p).collect()[0].refs == 3
    assert track.state().count() == 1000


def test_many_epochs_at_once_are_as_one_after_the_other_and_through_compaction(spark, tmp_path, monkeypatch):
    import random

    r = random.Random(3)
    refs = spark.createDataFrame([("r", f"k{r.randrange(6)}", r.randrange(1, 4), e) for e in (5, 2, 9, 4) for _ in range(4)], orphans.REFS + ", epoch int")
    parents = spark.createDataFrame([("r", f"k{r.randrange(6)}", r.choice([1, -1]), None, e) for e in (5, 2, 9, 4) for _ in range(2)], orphans.PARENTS + ", epoch int")
    cols = ["key", "epoch", "alive", "refs", "n", "opened", "resolved", "reopened", "pending"]
    want = rows(orphans.OrphanTracker(spark, Workspace(spark, "a", f"{tmp_path}/a")).advance_many([5, 2, 9, 4], refs, parents).select(cols))
    monkeypatch.setattr(orphans, "COMPACT_AFTER", 1)
    track, got = orphans.OrphanTracker(spark, Workspace(spark, "b", f"{tmp_path}/b")), []
    for e in (5, 2, 9, 4):
        got += rows(track.advance(e, refs.where(f"epoch = {e}").drop("epoch"), parents.where(f"epoch = {e}").drop("epoch")).select(cols))
    assert sorted(got) == want and len(track.deltas) == 1


def test_heavy_keys_do_not_change_the_result(spark, testdata):
    (deltas, _, refs), _ = problems._orphans(spark, testdata)
    assert rows(orphans.orphan_rows(deltas, refs, heavy_rows=3, heavy_keys=10**9)) == rows(orphans.orphan_rows(deltas, refs))


def test_counts_add_up(spark, testdata):
    from collections import Counter

    counts = {tuple(r)[:3]: r.opened for r in problems.p1_counts(spark, testdata).collect()}
    found = Counter((r.table_name, r.column_name, r.version_id) for r in problems.p1_found(spark, testdata).collect())
    assert found == Counter({k: n for k, n in counts.items() if n})


@pytest.mark.parametrize("clashing", [False, True])
def test_snapshot_changes(spark, make_store, clashing):
    root = make_store(clashing, **messy())
    assert rows(problems.p2_found(spark, root)) == [(2, "r", "added"), (4, "p", "changed"), (4, "q", "removed"), (4, "r", "changed")]


def test_changed_values(spark, make_store):
    got = {(r.version_id, r.fqn): r for r in problems.p2_changes(spark, make_store(**messy())).collect()}
    assert got[4, "r"].old_signature == "x" and got[4, "r"].new_signature == "y"
    assert got[2, "r"].old_signature is None and got[4, "q"].new_kind is None


def test_json_spelling(spark):
    df = spark.createDataFrame([('{"a":1,"b":[1,2]}',), ('{ "b" : [1, 2],\n"a":1.0}',), ('{"a":1,"b":[2,1]}',)], "a string")
    a, b, c = [r[0] for r in df.select(snapshots.json_value("a")).collect()]
    assert a == b != c


def test_latest_row_counts_and_ties_are_settled(spark, make_store):
    n = lambda k, s, t: {"version_id": 1, "id": k, "fqn": "p", "signature": s, "loaded_at": t}
    a = [n(1, "x", T), n(2, "y", datetime(2024, 1, 2)), {"version_id": 2, "fqn": "p", "signature": "y", "loaded_at": T}]
    assert rows(problems.p2_found(spark, make_store(cgdb_nodes=a))) == []


def test_chunks_are_equal_and_exact(spark, tmp_path):
    data = [("hot",)] * 700 + [(f"k{i % 50}",) for i in range(300)] + [(None,)] * 3
    df = spark.createDataFrame(data, "key string").repartition(7)
    work = Workspace(spark, "s", str(tmp_path / "s"))
    placed = skew.placed_rows(work, df, ["key"])
    numbered = skew.offsets(spark, work, skew.key_runs(placed), 5)
    ranges = sorted((r.start, r.start + r.n) for r in numbered.collect())
    assert ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:])) and ranges[-1][1] == 1003
    chunked = skew.in_chunks(placed, skew.cuts(placed, numbered, 100))
    from pyspark.sql import functions as F

    sizes = [tuple(r)[1:] for r in chunked.groupBy(F.spark_partition_id().alias("p"), "_chunk").count().collect()]
    assert sorted(sizes) == [(k, 100) for k in range(10)] + [(10, 3)]  # one partition each, all of one size
    states = skew.chunk_states(chunked, ["key"], 100).collect()
    hot = sorted((s.chunk, s.first, s["last"], s.n) for s in states if s.key == "hot")
    assert all(b[1] - 1 == a[2] for a, b in zip(hot, hot[1:])) and sum(s[3] for s in hot) == 700  # numbers go on from chunk to chunk
    counts = {r.key: (r.rows, r.chunks, r["last"] - r["first"] + 1) for r in skew.chunked_counts(spark, Workspace(spark, "s2", str(tmp_path / "s2")), df, ["key"], 100).collect()}
    assert counts["hot"][0] == counts["hot"][2] == 700 and counts["hot"][1] >= 7 and counts["k3"][::2] == (6, 6) and counts[None][0] == 3


def test_chunk_of_as_by_comparison():
    import random

    import numpy as np

    r = random.Random(2)
    for _ in range(50):
        borders = sorted({(r.randrange(4), r.randrange(6)) for _ in range(r.randrange(6))})
        rows = [(r.randrange(-1, 5), r.randrange(7)) for _ in range(40)]
        got = skew.chunk_of(*(np.array(x, np.int64) for x in zip(*rows)), np.array([b[0] for b in borders], np.int64), np.array([b[1] for b in borders], np.int64))
        assert got.tolist() == [sum(b <= x for b in borders) for x in rows]


@pytest.mark.parametrize("where", ["state", "sink", "commit"])
@pytest.mark.parametrize("run", [1, 3, 4])
def test_a_failed_run_is_replayed_without_loss_or_repetition(spark, make_store, tmp_path, where, run):
    root = make_store(**messy())
    files = spark.read.parquet(f"{root}/cgdb_files.parquet")
    want = rows(incremental.ChangeFeed(spark, Workspace(spark, "a", f"{tmp_path}/a")).run(files, [1, 3, 4]))

    def break_off(step, r):
        if (step, r) == (where, run):
            raise RuntimeError("lost")

    work = Workspace(spark, "b", f"{tmp_path}/b")
    with pytest.raises(RuntimeError):
        incremental.ChangeFeed(spark, work, on_step=break_off).run(files, [1, 3, 4])
    assert rows(incremental.ChangeFeed(spark, work).run(files, [1, 3, 4])) == want
    assert rows(incremental.ChangeFeed(spark, work).run(files, [1, 3, 4])) == want  # nothing left to do


def test_late_records_wait_for_the_next_run(spark, make_store, tmp_path):
    root = make_store(**messy())
    files = spark.read.parquet(f"{root}/cgdb_files.parquet")
    work = Workspace(spark, "c", f"{tmp_path}/c")
    incremental.ChangeFeed(spark, work).run(files, [1])
    late = spark.createDataFrame([(50, 1, 10, "a/b10.c", False, "new")], "delivery_id bigint, scan_run int, id bigint, path string, is_deleted boolean, content_hash string")
    more = files.unionByName(late, allowMissingColumns=True)
    assert [tuple(r)[:3] for r in incremental.ChangeFeed(spark, work).run(more, [1]).collect()] == [(1, 10, "ab")]


def test_a_late_record_between_plan_and_replay_is_in_the_next_batch(spark, make_store, tmp_path):
    root = make_store(**messy())
    files = spark.read.parquet(f"{root}/cgdb_files.parquet")
    work = Workspace(spark, "c", f"{tmp_path}/c")

    def break_off(step, run):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.ChangeFeed(spark, work, on_step=break_off).run(files, [1])
    late = spark.createDataFrame([(50, 1, 77, "a/b77.c", False, "late")], "delivery_id bigint, scan_run int, id bigint, path string, is_deleted boolean, content_hash string")
    got = incremental.ChangeFeed(spark, work).run(files.unionByName(late, allowMissingColumns=True), [1, 3])
    assert {(r.run_id, r.file_id) for r in got.collect()} >= {(1, 10), (3, 77)} and (1, 77) not in {(r.run_id, r.file_id) for r in got.collect()}


def test_a_batch_writes_what_it_brings_and_tables_are_made_one(spark, tmp_path, monkeypatch):
    schema = "delivery_id bigint, scan_run int, id bigint, path string, is_deleted boolean, content_hash string, sha256 string"
    files = spark.createDataFrame([(k, 1, k, "p", False, "a", None) for k in range(200)] + [(1000 + r, r, r, "p", False, "b", None) for r in (2, 3, 4)], schema)
    monkeypatch.setattr(incremental, "COMPACT_AFTER", 2)
    work = Workspace(spark, "c", f"{tmp_path}/c")
    got = incremental.ChangeFeed(spark, work).run(files, [1, 2, 3, 4])
    assert sorted((r.run_id, r.file_id) for r in got.collect() if r.run_id > 1) == [(2, 2), (3, 3), (4, 4)]
    assert work.load("state/2").count() == work.load("state/4").count() == 1
    assert work.get("commits/3.json")["state"] == ["state/upto=3"] and work.get("commits/4.json")["state"] == ["state/upto=3", "state/4"]
