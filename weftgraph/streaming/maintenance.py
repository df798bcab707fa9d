"""Change events as streams.

Event time is used throughout, with a watermark for late events. State is keyed and bounded: windows by the watermark, the
breaker by its window, the previous contents of files by one hash each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.workspace import Workspace

# fixed values: the defaults of the daemon
BREAKER_EVENTS, BREAKER_SECONDS, COOLDOWN_SECONDS = 1000, 60, 30
DEBOUNCE_MS, LEAST_WINDOW_MS, MOST_WINDOW_MS = 500, 200, 5000


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100, **options: str) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).options(**options).parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def debounced(events: DataFrame, ts: str, key: str, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """One row for each burst of events of a key: a burst ends when nothing comes for ``gap``."""
    rows = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def pending_once(events: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once while it is within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def adaptive_window(load: Column) -> Column:
    """Milliseconds: the least window below a load of 0.3, the most above 0.8, linear between."""
    span = MOST_WINDOW_MS - LEAST_WINDOW_MS
    return F.when(load < 0.3, float(LEAST_WINDOW_MS)).when(load > 0.8, float(MOST_WINDOW_MS)).otherwise(LEAST_WINDOW_MS + (load - 0.3) / 0.5 * span)


_BREAKER = "source string, ts timestamp, n int, mode string"


def breaker(events: DataFrame, source: str, ts: str, late: str = "10 minutes", most: int = BREAKER_EVENTS, seconds: int = BREAKER_SECONDS, cooldown: int = COOLDOWN_SECONDS) -> DataFrame:
    """For every second of a source with events: how many came in the window before it, and whether the job is ``bulk`` (more
    than ``most``, or less than ``cooldown`` after that happened) or ``incremental``. State: counts of the window's seconds."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        counts, tripped = ({}, None)
        if state.exists:
            keys, values, tripped = state.get
            counts = dict(zip(keys, values))
        new = pd.concat(list(frames))["_second"].value_counts().to_dict()
        out = []
        for s in sorted(new):
            counts[s] = counts.get(s, 0) + new[s]
            n = sum(v for k, v in counts.items() if s - seconds < k <= s)
            if n > most:
                tripped = s
            bulk = n > most or tripped is not None and 0 <= s - tripped < cooldown
            out.append((key[0], pd.Timestamp(s, unit="s"), int(n), "bulk" if bulk else "incremental"))
        newest = max(counts)
        counts = {k: v for k, v in counts.items() if k > newest - seconds}
        state.update((list(counts), list(counts.values()), tripped))
        yield pd.DataFrame(out, columns=["source", "ts", "n", "mode"])

    rows = events.withWatermark(ts, late).select(F.col(source).alias("source"), F.col(ts).cast("timestamp").cast("bigint").alias("_second"))
    return rows.groupBy("source").applyInPandasWithState(step, _BREAKER, "seconds array<bigint>, counts array<bigint>, tripped bigint", "append", "NoTimeout")


def normal_form(text: Column) -> Column:
    """A text without comments, blank lines and differences in spacing; equal for edits of the format only."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
    bare = F.regexp_replace(bare, r"(?m)(?://|#(?!include|define|if|else|endif)).*$", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


class StreamingUpsert:
    """Keeps a table of the newest row per key from a stream, batch by batch. A batch is written under its number and a
    pointer moves last, so a batch that comes again after a failure changes nothing."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str, schema: str, delete: str | None = None):
        self.spark, self.key, self.order, self.schema, self.delete = spark, key, order, schema, delete
        self.work = Workspace(spark, "upsert", path)

    def current(self) -> DataFrame:
        at = self.work.get("pointer.json")
        rows = self.work.load(f"v={at['batch']}", self.schema) if at else self.spark.createDataFrame([], self.schema)
        return rows.where(f"not {self.delete}") if self.delete else rows

    def __call__(self, batch: DataFrame, number: int) -> None:
        at = self.work.get("pointer.json")
        if at and at["batch"] >= number:
            return
        fields = [f for f in self.spark.createDataFrame([], self.schema).columns]
        old = self.work.load(f"v={at['batch']}", self.schema) if at else self.spark.createDataFrame([], self.schema)
        rows = old.unionByName(batch.select(fields))
        last = F.max(F.struct(self.order, *[f for f in fields if f != self.order and f not in self.key])).alias("r")
        new = rows.groupBy(*self.key).agg(last).select(*[F.col(f) if f in self.key else F.col(f"r.{f}").alias(f) for f in fields])
        self.work.save(new, f"v={number}")
        self.work.put("pointer.json", {"batch": number})
        if at:
            self.work.drop(f"v={at['batch']}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_now(stream: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> None:
    """Everything that is there, to a parquet folder, then stops."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start().awaitTermination()


def for_each(stream: DataFrame, checkpoint: str, fn: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
