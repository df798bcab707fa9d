"""References to records that do not exist, kept incrementally.

State, one row per (reference column, key): how often the key is alive as a parent, and how many references to it have
been seen. An epoch brings new references, arriving parents and deletions:

* a new reference to a key that isn't alive opens an orphan,
* a parent that arrives resolves what waits for it,
* a deletion reopens the references seen so far.

An epoch writes a row for each key that it touches and no other: its state afterwards and what changed. The state is the
latest row of each key; several epochs that are there at once are folded in order in one pass over the keys. References
are combined by key and epoch before they are shuffled, so a key that holds a third of them costs one row per map task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.workspace import Workspace

#: References of one key and epoch from which its rows take no part in a shuffle by key, and the most such keys there may be.
HEAVY_ROWS, HEAVY_KEYS = 1_000_000, 10_000
#: Deltas after which the state is written anew as one table.
COMPACT_AFTER = 16

DELTA = "ref string, key string, epoch int, seq int, alive bigint, refs bigint, n bigint, opened bigint, resolved bigint, reopened bigint, pending bigint"
REFS = "ref string, key string, n bigint"
PARENTS = "ref string, key string, delta bigint, set_to bigint"


@dataclass
class OrphanTracker:
    """Pending-orphan state in ``work``. Deltas that a tracker before has written there are taken up, so that a run goes on
    where the last one ended; an epoch that broke off is written again."""

    spark: SparkSession
    work: Workspace
    deltas: list[str] = field(default_factory=list)

    def __post_init__(self):
        note = self.work.get("deltas.json")
        self.deltas, self.seq = (note["deltas"], note["seq"]) if note else ([], 0)

    def state(self) -> DataFrame:
        """ref, key, alive, refs, seq of each key seen so far."""
        rows = self.spark.createDataFrame([], DELTA)
        for name in self.deltas:
            rows = rows.unionByName(self.work.load(name, DELTA))
        return rows.groupBy("ref", "key").agg(F.max(F.struct("seq", "alive", "refs")).alias("last")).select("ref", "key", "last.alive", "last.refs", "last.seq")

    def advance(self, epoch: int, refs: DataFrame, parents: DataFrame) -> DataFrame:
        """One epoch. ``refs``: ref, key, n; ``parents``: ref, key and either delta (spans that begin or end) or set_to (0 or
        1, the key's last record). Returns the keys that it touched, as DELTA."""
        return self.advance_many([epoch], refs.withColumn("epoch", F.lit(epoch)), parents.withColumn("epoch", F.lit(epoch)))

    def advance_many(self, epochs: list[int], refs: DataFrame, parents: DataFrame) -> DataFrame:
        """Several epochs in the given order; refs and parents have their ``epoch``. Rows of no listed epoch are left out."""
        zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
        place = F.array_position(F.array(*map(F.lit, epochs)).cast("array<int>"), F.col("epoch").cast("int")).cast("int") if epochs else F.lit(0)
        arrivals = (
            refs.select("ref", "key", place.alias("at"), "n", zero.alias("delta"), none.alias("set_to"))
            .unionByName(parents.select("ref", "key", place.alias("at"), zero.alias("n"), F.coalesce(F.col("delta").cast("bigint"), zero).alias("delta"), F.col("set_to").cast("bigint")))
            .where("at > 0")
            .groupBy("ref", "key", "at").agg(F.sum("n").alias("n"), F.sum("delta").alias("delta"), F.max("set_to").alias("set_to"))
        )
        if self.deltas:  # the state of touched keys stands before the first epoch
            before = self.state().join(arrivals.select("ref", "key").distinct(), ["ref", "key"], "left_semi")
            arrivals = arrivals.unionByName(before.select("ref", "key", F.lit(0).alias("at"), F.col("refs").alias("n"), F.col("alive").alias("delta"), none.alias("set_to")))
        upto = Window.partitionBy("ref", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        order = Window.partitionBy("ref", "key").orderBy("at")
        was, seen, alive, refs_now = F.col("was"), F.col("seen"), F.col("alive"), F.col("refs")
        pending = lambda a, r: F.when(a <= 0, r).otherwise(0)
        step = (
            arrivals.withColumns({"alive": F.coalesce(F.last("set_to", ignorenulls=True).over(upto), F.sum("delta").over(upto)), "refs": F.sum("n").over(upto)})
            .withColumns({"was": F.coalesce(F.lag("alive").over(order), zero), "seen": F.coalesce(F.lag("refs").over(order), zero)})
            .where("at > 0")
            .select(
                "ref", "key", F.element_at(F.array(*map(F.lit, epochs or [0])), F.col("at")).cast("int").alias("epoch"), (F.col("at") + self.seq).alias("seq"), "alive", "refs", "n",
                F.when(alive <= 0, F.col("n")).otherwise(0).alias("opened"), F.when((was <= 0) & (alive > 0), seen).otherwise(0).alias("resolved"),
                F.when((was > 0) & (alive <= 0), seen).otherwise(0).alias("reopened"), (pending(alive, refs_now) - pending(was, seen)).alias("pending"),
            )
        )
        name = f"delta={self.seq}"
        out = self.work.save(step, name)
        self.deltas, self.seq = [*self.deltas, name], self.seq + len(epochs)
        if len(self.deltas) > COMPACT_AFTER:
            flat = self.state().select("ref", "key", F.lit(None).cast("int").alias("epoch"), "seq", "alive", "refs", *[zero.alias(c) for c in ("n", "opened", "resolved", "reopened", "pending")])
            self.work.save(flat, f"state={self.seq}")
            self.deltas = [f"state={self.seq}"]
        self.work.put("deltas.json", {"deltas": self.deltas, "seq": self.seq})
        return out


def epochs_of(refs: DataFrame, version: str) -> list[int]:
    """The versions for which references were recorded; as many as the graph has versions, whatever its size."""
    return sorted(r[0] for r in refs.where(F.col(version).isNotNull()).select(version).distinct().collect())


def counted_refs(rows: DataFrame) -> DataFrame:
    """rows: ref, key, version, row_id. Distinct references by key and version. A row that occurs twice counts once, one whose
    row_id is null as one of that id."""
    return rows.where("key is not null and version is not null").select("ref", "key", "version", "row_id").distinct().groupBy("ref", "key", "version").agg(F.count("*").alias("n"))


def span_events(functions: DataFrame, refs: list[str], last_version: int) -> DataFrame:
    """Begin and end of each life span as +1 and -1: alive at V means first <= V and (last > V or last = last_version)."""
    first, last = F.col("first_seen_version"), F.col("last_seen_version")
    known = functions.where("id is not null and first_seen_version is not null and last_seen_version is not null")
    begins = known.select("id", first.alias("at"), F.lit(1).alias("delta"))
    ends = known.where(last != last_version).select("id", F.greatest(first, last).alias("at"), F.lit(-1).alias("delta"))
    return (
        begins.unionByName(ends)
        .groupBy(F.col("id").alias("key"), "at").agg(F.sum("delta").alias("delta"))
        .select(F.explode(F.array(*map(F.lit, refs))).alias("ref"), "key", "at", "delta", F.lit(None).cast("bigint").alias("set_to"))
    )


def record_events(files: DataFrame, refs: list[str], at: Column) -> DataFrame:
    """The last record of each file in each epoch; ``at`` names the first epoch that sees a record."""
    last = F.max(F.struct("scan_run", "delivery_id", F.when(F.coalesce("is_deleted", F.lit(False)), 0).otherwise(1).cast("bigint").alias("on")))
    return (
        files.where("id is not null and scan_run is not null")
        .select(F.col("id").cast("string").alias("key"), at.alias("at"), "scan_run", "delivery_id", "is_deleted")
        .where("at is not null")
        .groupBy("key", "at").agg(last.alias("last"))
        .select(F.explode(F.array(*map(F.lit, refs))).alias("ref"), "key", "at", F.lit(None).cast("bigint").alias("delta"), F.col("last.on").alias("set_to"))
    )


def track(tracker: OrphanTracker, epochs: list[int], refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Epochs are versions in ascending order. refs: ref, key, version, n. parents: ref, key, at, delta, set_to; what comes
    between two epochs belongs to the later one. Returns the deltas of all epochs."""
    ends = F.array(*map(F.lit, epochs)).cast("array<int>")
    epoch = F.try_element_at(F.filter(ends, lambda e: e >= F.col("at")), F.lit(1))
    return track_in_order(tracker, epochs, refs, parents.withColumn("at", epoch))


def track_in_order(tracker: OrphanTracker, epochs: list[int], refs: DataFrame, parents: DataFrame) -> DataFrame:
    """As ``track``, for epochs in any given order; ``at`` of the parents is one of them, or null for none."""
    return tracker.advance_many(epochs, refs.withColumnRenamed("version", "epoch"), parents.withColumnRenamed("at", "epoch").where("epoch is not null"))


def orphan_rows(deltas: DataFrame, rows: DataFrame, heavy_rows: int = HEAVY_ROWS, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """The references that were orphans in the epoch in which they came: ref, row_id, version, each once.

    Keys with very many references in an epoch are told from a broadcast table and their rows never shuffled by key; as each
    has at least 1 / heavy_keys of all references, there are at most that many. All others meet by key."""
    keys = ["ref", "key", "version"]
    known = deltas.where("n > 0").select("ref", "key", F.col("epoch").alias("version"), "n", (F.col("opened") > 0).alias("orphan"))
    total = known.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") >= max(heavy_rows, total // heavy_keys + 1)
    rows = rows.where("key is not null and version is not null").select(*keys, "row_id").join(F.broadcast(known.where(heavy).select(*keys, "orphan")), keys, "left")
    few = rows.where("orphan is null").join(known.where(~heavy & F.col("orphan")).select(*keys), keys, "left_semi")
    return few.unionByName(rows.where("orphan")).select("ref", "row_id", "version").distinct()


def orphan_counts(deltas: DataFrame, epochs: list[int]) -> DataFrame:
    """The snapshot of each epoch: references opened, resolved and reopened in it, and still pending at its end. ``epochs``:
    their order; an epoch that touched nothing of a column has no row."""
    sums = deltas.groupBy("ref", F.col("epoch").alias("version")).agg(*[F.sum(c).alias(c) for c in ("opened", "resolved", "reopened", "pending")])
    # a row for each column and epoch, so windows over them are small
    place = F.array_position(F.array(*map(F.lit, epochs)).cast("array<int>"), F.col("version"))
    return sums.withColumn("pending", F.sum("pending").over(Window.partitionBy("ref").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)))
