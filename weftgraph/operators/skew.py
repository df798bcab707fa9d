"""Per-key results when a few keys hold most rows: exact offset chunking.

1. Rows are put down once with their place (input partition and order in it), and counted by key in each input partition.
2. The runs (key, input partition, count) are range-partitioned in key order; sums by partition, then running sums, give
   the number of the first row of each run in the order of all rows: key by key, input partition by input partition.
3. That order is cut into chunks of equal size. A cut within a run is found by numbering the rows of that run only; the
   places of all cuts, one for each chunk, tell every row its chunk.
4. Each chunk is one partition. Its rows are sorted, numbered, and processed to a state for each of its keys.
5. Keys that lie in several chunks have their boundary states merged in the order of the chunks.

So every task gets the same number of rows, whatever the keys are, and no two keys are treated differently. Keys are
ordered by a hash of theirs, which costs less than their values; keys of equal hash lie mixed and are told apart in 4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.workspace import Workspace

#: Rows of a chunk, and the number of chunks beyond which they get larger instead of more.
CHUNK_ROWS, MOST_CHUNKS = 250_000, 20_000


def placed_rows(work: Workspace, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds _h, a hash of the keys, and _at, the row's place: ascending within an input partition and from one to the next.
    Written, so that a place never changes."""
    return work.save(rows.select("*", F.xxhash64(*keys).alias("_h"), F.monotonically_increasing_id().alias("_at")), "rows")


def key_runs(placed: DataFrame) -> DataFrame:
    """_h, part, n: rows by key and input partition, combined before they are shuffled."""
    return placed.select("_h", F.shiftright("_at", 33).alias("part")).groupBy("_h", "part").agg(F.count("*").alias("n"))


def offsets(spark: SparkSession, work: Workspace, runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds ``start``, the number of rows before each run in the order of _h and part."""
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["_h", "part"]
    cut = runs.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id())
    cut = work.save(cut, "runs")  # ranges are sampled, so they are settled before they are summed
    # as many rows as range partitions, so one task can hold them
    sums = cut.groupBy("slice").agg(F.sum("n").alias("total"))
    before = sums.select("slice", (F.sum("total").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return cut.join(before, "slice").select(*order, "n", (F.col("base") + within).alias("start"))


def cuts(placed: DataFrame, numbered: DataFrame, chunk_rows: int) -> list[tuple[int, int]]:
    """_h and _at of the first row of each chunk but the first, in order: as many as chunks, not as rows."""
    size = F.lit(chunk_rows)
    first = F.greatest(F.lit(1), F.ceil(F.col("start") / size))
    last = F.floor((F.col("start") + F.col("n") - 1) / size)
    inside = numbered.where(last >= first).select("_h", "part", "start", F.explode(F.sequence(first, last)).alias("chunk"))
    inside = inside.select("_h", "part", (F.col("chunk") * size - F.col("start") + 1).alias("nth"))
    # only the runs that a cut lies in are numbered; a run is at most one input partition's rows of a key
    runs = placed.select("_h", "_at", F.shiftright("_at", 33).alias("part")).join(inside.select("_h", "part").distinct(), ["_h", "part"], "left_semi")
    ranked = runs.withColumn("nth", F.row_number().over(Window.partitionBy("_h", "part").orderBy("_at")))
    return sorted((r["_h"], r["_at"]) for r in ranked.join(inside, ["_h", "part", "nth"]).select("_h", "_at").collect())


def chunk_of(h: np.ndarray, at: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many cuts (starts, places), which are in order, lie at or before each (h, at)."""
    low, high = np.searchsorted(starts, h, "left"), np.searchsorted(starts, h, "right")
    out = low.copy()
    for a in np.unique(low[low < high]):  # rows of a key that has cuts
        mine = (low == a) & (high > a)
        out[mine] = a + np.searchsorted(places[a : high[mine][0]], at[mine], "right")
    return out


def in_chunks(placed: DataFrame, borders: list[tuple[int, int]]) -> DataFrame:
    """The rows with their ``_chunk``, one partition for each chunk."""
    shared = placed.sparkSession.sparkContext.broadcast((np.array([b[0] for b in borders], np.int64), np.array([b[1] for b in borders], np.int64)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, places = shared.value
        for b in batches:
            chunk = chunk_of(b.column("_h").to_numpy(), b.column("_at").to_numpy(), starts, places)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunk, pa.int32())], names=[*b.schema.names, "_chunk"])

    return placed.mapInArrow(run, f"{fields}, _chunk int").repartitionById(len(borders) + 1, F.col("_chunk"))


def chunk_states(chunked: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """keys, chunk, n, first, last: for each key of a chunk its rows there, and the numbers of its first and last one."""
    kinds = {f.name: f.dataType.simpleString() for f in chunked.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)  # a chunk, at most ``chunk_rows``
        rows = rows.take(pa.array(np.lexsort((rows["_at"].to_numpy(), rows["_h"].to_numpy()))))
        chunk = rows["_chunk"][0].as_py()
        rows = rows.append_column("_number", pa.array(np.arange(rows.num_rows) + chunk * chunk_rows, pa.int64()))
        out = rows.group_by(keys).aggregate([("_number", "count"), ("_number", "min"), ("_number", "max")])
        arrays = [out[k] for k in keys] + [pa.chunked_array([pa.array([chunk] * out.num_rows, pa.int32())]), out["_number_count"], out["_number_min"], out["_number_max"]]
        yield from pa.table(arrays, names=[*keys, "chunk", "n", "first", "last"]).to_batches()

    return chunked.select(*keys, "_h", "_at", "_chunk").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", chunk int, n bigint, first bigint, last bigint")


def merged_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, chunks, first, last. A key's states are taken in the order of their chunks, as many as it has chunks."""
    in_order = F.sort_array(F.collect_list(F.struct("chunk", "n", "first", "last")))
    zero = F.struct(F.lit(0).cast("bigint").alias("rows"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"))
    merge = lambda a, s: F.struct((a["rows"] + s["n"]).alias("rows"), F.coalesce(a["first"], s["first"]).alias("first"), s["last"].alias("last"))
    out = states.groupBy(*keys).agg(in_order.alias("s")).select(*keys, F.size("s").alias("chunks"), F.aggregate("s", zero, merge).alias("m"))
    return out.select(*keys, "m.rows", F.col("chunks").cast("bigint").alias("chunks"), "m.first", "m.last")


def chunked_counts(spark: SparkSession, work: Workspace, rows: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """keys, rows, chunks, first, last: rows per key from chunks of equal size, and the numbers of its first and last row in
    the order of all rows. Null keys count as a key. An empty input gives no rows. ``rows`` may have no other columns than
    the keys."""
    placed = placed_rows(work, rows.select(*keys), keys)
    numbered = work.save(offsets(spark, work, key_runs(placed)), "numbered")
    total = numbered.agg(F.sum("n")).first()[0] or 0
    size = max(chunk_rows, -(-total // MOST_CHUNKS))
    states = chunk_states(in_chunks(placed, cuts(placed, numbered, size)), keys, size)
    return merged_states(states, keys)
