"""Processing only new or changed records, exactly once per successful run.

The delivered records are a log, spread over a fixed number of partitions by record id; a record's offset in its
partition is (scan_run, delivery_id). A batch takes the records of one successful run and of the failed ones before it,
from where the batch before ended in each partition:

1. its plan, with the offsets of every partition, is written ahead;
2. the last record of each id in the batch is held against the state, and the ids that the batch has get their new state;
3. changes go to the sink under the batch's name;
4. a commit note ends it.

A batch that has a plan but no commit is replayed by its plan, never planned anew; what came after its plan is left to
the next batch. Tables of a batch replace what a failed attempt left, and the sink's reader keeps one row per key with
the greatest offset, so nothing is skipped or repeated. The state of an id is its row in the last table that has it: a
batch writes as much as it brings, and every so many batches the tables are made one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.workspace import Workspace

#: State tables after which they are made one.
COMPACT_AFTER = 16

STATE = "id bigint, content string, deleted boolean, scan_run int, delivery_id bigint"
SINK = "run_id int, file_id bigint, content string, scan_run int, delivery_id bigint"


def file_log(files: DataFrame, log_partitions: int) -> DataFrame:
    """id, scan_run, delivery_id, deleted, content, part. Records without an id or run have no place in the log. Content is
    content_hash or, where that is null or empty, sha256, in lower case; null if both are missing."""
    some = lambda c: F.when(F.col(c) != "", F.lower(c))
    return files.where("id is not null and scan_run is not null").select(
        "id", "scan_run", "delivery_id", F.coalesce("is_deleted", F.lit(False)).alias("deleted"), F.coalesce(some("content_hash"), some("sha256")).alias("content"),
        F.pmod(F.xxhash64("id"), F.lit(log_partitions)).cast("int").alias("part"),
    )


class ChangeFeed:
    def __init__(self, spark: SparkSession, work: Workspace, log_partitions: int = 64, on_step: Callable[[str, int], None] | None = None):
        """on_step: called before each step with its name and run, so that tests can break off there."""
        self.spark, self.work, self.log_partitions = spark, work, log_partitions
        self.on_step = on_step or (lambda step, run: None)

    def plan(self, files: DataFrame, runs: list[int]) -> list[dict]:
        """Plans of all successful runs, the ones already written unchanged."""
        if all(self.work.get(f"plans/{r}.json") for r in runs):
            return [self.work.get(f"plans/{r}.json") for r in runs]
        log = file_log(files, self.log_partitions)
        # one row per log partition and run: offsets, not records
        ends = log.groupBy("part", "scan_run").agg(F.max("delivery_id").alias("last")).collect()
        out: list[dict] = []
        for r in runs:
            plan = self.work.get(f"plans/{r}.json")
            if plan is None:
                start = out[-1]["to"] if out else {}
                to = dict(start)
                for e in ends:
                    if e["scan_run"] <= r:
                        to[str(e["part"])] = max(to.get(str(e["part"]), [-1, -1]), [e["scan_run"], e["last"] if e["last"] is not None else -1])
                plan = {"run": r, "from": start, "to": to}
                self.work.put(f"plans/{r}.json", plan)
            out.append(plan)
        return out

    def run(self, files: DataFrame, runs: list[int]) -> DataFrame:
        """Processes what isn't committed and returns the sink."""
        runs = sorted(set(runs))
        state: list[str] = []
        for plan in self.plan(files, runs):
            r = plan["run"]
            note = self.work.get(f"commits/{r}.json")
            if not note:
                note = self.batch(files, plan, state)
            state = note["state"]
        return self.sink(runs)

    @staticmethod
    def _offset(offsets: dict):
        """The log partition's offset in ``offsets``; null without one. As many entries as log partitions."""
        kind = "struct<s: int, d: bigint>"
        entries = ", ".join(f"{int(p)}, named_struct('s', {int(s)}, 'd', {int(d)}L)" for p, (s, d) in offsets.items())
        return F.expr(f"try_element_at(map({entries}), part)" if entries else f"cast(null as {kind})")

    def batch(self, files: DataFrame, plan: dict, state: list[str]) -> dict:
        r = plan["run"]
        self.on_step("state", r)
        at = F.struct(F.col("scan_run").alias("s"), F.coalesce("delivery_id", F.lit(-1)).cast("bigint").alias("d"))
        least = min((s for s, _ in plan["from"].values()), default=None) if len(plan["from"]) == self.log_partitions else None
        # what lies beyond an offset has at least its run, so earlier runs needn't be read
        log = file_log(files.where(F.col("scan_run").between(least, r) if least is not None else F.col("scan_run") <= r), self.log_partitions)
        log = log.where(at <= self._offset(plan["to"]))
        if plan["from"]:
            log = log.where(self._offset(plan["from"]).isNull() | (at > self._offset(plan["from"])))
        last = F.max(F.struct("scan_run", "delivery_id", "deleted", "content"))
        new = log.groupBy("id").agg(last.alias("new"))
        old = self.spark.createDataFrame([], STATE)
        for name in state:
            old = old.unionByName(self.work.load(name, STATE))
        was = old.join(new.select("id"), "id", "left_semi").groupBy("id").agg(last.alias("old")) if state else old.select("id", F.struct("scan_run", "delivery_id", "deleted", "content").alias("old"))
        fresh = ~F.col("new.deleted") & (F.col("old").isNull() | F.col("old.deleted") | ~F.col("old.content").eqNullSafe(F.col("new.content")))
        now = F.greatest("old", "new")  # a late record of an earlier run doesn't take back what is known
        out = new.join(was, "id", "left").select("id", *[now.getField(c).alias(c) for c in ("content", "deleted", "scan_run", "delivery_id")], (fresh & (now == F.col("new"))).alias("fresh"))
        out = self.work.save(out, f"state/{r}")
        self.on_step("sink", r)
        self.work.save(out.where("fresh").select(F.lit(r).alias("run_id"), F.col("id").alias("file_id"), "content", "scan_run", "delivery_id"), f"sink/{r}")
        tables = [*state, f"state/{r}"]
        if len(tables) > COMPACT_AFTER:
            every = self.work.load(tables[0], STATE)
            for name in tables[1:]:
                every = every.unionByName(self.work.load(name, STATE))
            self.work.save(every.groupBy("id").agg(last.alias("last")).select("id", "last.content", "last.deleted", "last.scan_run", "last.delivery_id"), f"state/upto={r}")
            tables = [f"state/upto={r}"]
        self.on_step("commit", r)
        note = {"run": r, "state": tables}
        self.work.put(f"commits/{r}.json", note)
        return note

    def sink(self, runs: list[int]) -> DataFrame:
        out = self.spark.createDataFrame([], SINK)
        for r in runs:
            out = out.unionByName(self.work.load(f"sink/{r}", SINK))
        last = F.max(F.struct("scan_run", "delivery_id", "content")).alias("last")
        return out.groupBy("run_id", "file_id").agg(last).select("run_id", "file_id", "last.content", "last.scan_run", "last.delivery_id")
