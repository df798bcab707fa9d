"""Versioned records: time travel, diffs, merges and pruning.

A record with first_seen_version and last_seen_version is alive at V if first <= V and (last > V or last is the highest
version of all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alive_at(rows: DataFrame, version: int, newest: int) -> DataFrame:
    first, last = F.col("first_seen_version"), F.col("last_seen_version")
    return rows.where((first <= version) & ((last > version) | (last == newest)))


def alive_counts(rows: DataFrame, versions: list[int], newest: int) -> DataFrame:
    """version, n: alive ids at each version. Life spans are counted as changes and summed up, not laid out by version."""
    first, last = F.col("first_seen_version"), F.col("last_seen_version")
    spans = rows.where("id is not null and first_seen_version is not null and last_seen_version is not null").select("id", first.alias("a"), F.when(last == newest, None).otherwise(F.greatest(first, last)).alias("b")).distinct()
    listed = F.array(*[F.lit(v) for v in versions])
    at = F.explode(F.filter(listed, lambda v: (v >= F.col("a")) & (F.col("b").isNull() | (v < F.col("b")))))
    # an id with two spans that overlap counts once, so ids are kept up to here
    return spans.select("id", at.alias("version")).distinct().groupBy("version").agg(F.count("*").alias("n"))


def version_diff(rows: DataFrame, v1: int, v2: int) -> DataFrame:
    """id, change: added if first seen in (v1, v2], removed if last seen there."""
    inside = lambda c: (F.col(c) > v1) & (F.col(c) <= v2)
    added = rows.where(inside("first_seen_version")).select("id", F.lit("added").alias("change"))
    removed = rows.where(inside("last_seen_version")).select("id", F.lit("removed").alias("change"))
    return added.unionByName(removed).distinct()


def soft_delete(rows: DataFrame, gone: Column, version: int) -> DataFrame:
    """Ends the life of the given records at a version."""
    last = F.when(gone & (F.col("last_seen_version") > version), F.lit(version)).otherwise(F.col("last_seen_version"))
    return rows.withColumn("last_seen_version", last)


def record_version(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Appends versions whose commit isn't recorded yet."""
    return versions.unionByName(new.join(versions.select("commit_hash"), "commit_hash", "left_anti").select(versions.columns))


def keyed_diff(old: DataFrame, new: DataFrame, key: list[str], value: Column) -> DataFrame:
    """key, change: added, removed or changed between two tables with unique keys."""
    a = old.select(*key, value.alias("_v")).withColumn("_old", F.lit(True))
    b = new.select(*key, value.alias("_w")).withColumn("_new", F.lit(True))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full_outer").where(F.col("_old").isNull() | F.col("_new").isNull() | ~F.col("_v").eqNullSafe(F.col("_w"))).select(*key, change.alias("change"))


def merge_local_wins(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Union by key in which local rows win; rows without a key are all kept."""
    rest = remote.join(local.where(F.col(key).isNotNull()).select(key), key, "left_anti")
    return local.unionByName(rest.select(local.columns))


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes.select(base.columns))


def prune_by_source(nodes: DataFrame, deleted: DataFrame, path: str) -> DataFrame:
    """Nodes without those of deleted files; a deleted path matches as a whole or as an ending behind a slash. deleted: path.
    Each node's path is taken apart into its endings, so the match is an equality."""
    parts = F.split(F.col(path), "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts) - n + 1), "/"))
    paths = nodes.where(F.col(path).isNotNull()).select(path).distinct()
    hit = paths.select(path, F.explode(endings).alias("ending")).join(deleted.select(F.col("path").alias("ending")).distinct(), "ending", "left_semi").select(path).distinct()
    return nodes.join(hit, path, "left_anti").select(nodes.columns)
