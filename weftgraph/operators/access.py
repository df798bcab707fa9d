"""Accesses to shared fields: who writes, who reads, what may race.

accesses: fn, res (the field), is_write, model (thread model), lock. Pairs of functions are counted, never listed: the
number of pairs that differ in model and lock follows from counts per model, per lock and per both, so a field that
everything touches costs one row for each of those and not the square of its accessors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accessors(accesses: DataFrame) -> DataFrame:
    """One row for each function and field: whether it writes, and its model and lock."""
    return accesses.where("fn is not null and res is not null").groupBy("res", "fn").agg(F.max("is_write").alias("w"), F.max("model").alias("model"), F.max("lock").alias("lock"))


def race_summary(one: DataFrame) -> DataFrame:
    """res, n_fns, n_writers, n_races: pairs of functions with different models and different locks, one of which writes. A
    null model or lock is a value of its own.

    Of all pairs those of one model and those of one lock are taken off, those of both put back; then the same for pairs of
    readers. The group sizes for that come from one pass with grouping sets."""
    cells = one.groupBy("res", "model", "lock").agg(F.count("*").alias("n"), F.sum((~F.col("w")).cast("bigint")).alias("r"))
    sets = cells.groupingSets([["res", "model", "lock"], ["res", "model"], ["res", "lock"], ["res"]], "res", "model", "lock")
    sizes = sets.agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.grouping_id().alias("g"))
    whole = F.col("g") == 3  # neither model nor lock is a key
    sign = F.when(whole | (F.col("g") == 0), 1).otherwise(-1)
    pairs = F.col("n") * (F.col("n") - 1) / 2 - F.col("r") * (F.col("r") - 1) / 2
    return sizes.groupBy("res").agg(
        F.sum(F.when(whole, F.col("n"))).alias("n_fns"), F.sum(F.when(whole, F.col("n") - F.col("r"))).alias("n_writers"), F.sum(sign * pairs).cast("bigint").alias("n_races"),
    )


def race_partners(one: DataFrame) -> DataFrame:
    """res, fn, n_partners: with how many others each accessor may race."""
    other = lambda *keys: F.count("*").over(Window.partitionBy("res", *keys))
    writers = lambda *keys: F.sum(F.col("w").cast("bigint")).over(Window.partitionBy("res", *keys))
    differ = lambda f: f() - f("model") - f("lock") + f("model", "lock")
    return one.select("res", "fn", "w", F.when(F.col("w"), differ(other)).otherwise(differ(writers)).alias("n_partners"))


def reads_and_writes(accesses: DataFrame) -> DataFrame:
    return accesses.where("fn is not null and res is not null").groupBy("res", "fn").agg(F.max("is_write").alias("w"), F.max(~F.col("is_write")).alias("r"))


def dependency_counts(rw: DataFrame) -> DataFrame:
    """res, n_writers, n_readers, n_edges: edges from each writer to each other reader, counted."""
    n = lambda c: F.sum(c.cast("bigint"))
    rows = rw.groupBy("res").agg(n(F.col("w")).alias("n_writers"), n(F.col("r")).alias("n_readers"), n(F.col("w") & F.col("r")).alias("both"))
    return rows.select("res", "n_writers", "n_readers", (F.col("n_writers") * F.col("n_readers") - F.col("both")).alias("n_edges"))


def dead_writes(accesses: DataFrame) -> DataFrame:
    """Fields that are written and never read."""
    read = accesses.where("not is_write").select("res").distinct()
    return accesses.where("is_write").groupBy("res").agg(F.countDistinct("fn").alias("n_writers")).join(read, "res", "left_anti")


def forward_impact(accesses: DataFrame, fns: DataFrame) -> DataFrame:
    """res, fn: other functions that read what the given ones write. fns: fn."""
    mine = accesses.where("is_write").join(fns, "fn", "left_semi").select("res").distinct()
    return accesses.where("not is_write").join(mine, "res", "left_semi").join(fns, "fn", "left_anti").select("res", "fn").distinct()


def uninitialized_reads(accesses: DataFrame, fns: DataFrame) -> DataFrame:
    """Fields that the given functions read and no other function writes."""
    mine = accesses.where("not is_write").join(fns, "fn", "left_semi").select("res").distinct()
    others = accesses.where("is_write").join(fns, "fn", "left_anti").select("res").distinct()
    return mine.join(others, "res", "left_anti")


def held_regions(events: DataFrame, key: str, order: list[str], acquire: Column, release: Column) -> DataFrame:
    """Adds ``held``: whether the last acquire or release before an event was an acquire. A lock is held or not; it isn't
    counted, so two acquires need one release."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(acquire, True).when(release, False)
    return events.withColumn("held", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def balance(events: DataFrame, key: str, acquire: Column, release: Column) -> DataFrame:
    """Acquires and releases per key, and which of them prevail."""
    rows = events.groupBy(key).agg(F.sum(acquire.cast("bigint")).alias("n_acquire"), F.sum(release.cast("bigint")).alias("n_release"))
    kind = F.when(F.col("n_acquire") > F.col("n_release"), "leak").when(F.col("n_acquire") < F.col("n_release"), "double_release").otherwise("balanced")
    return rows.withColumn("bucket", kind)
