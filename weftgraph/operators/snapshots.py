"""What changed between full snapshots.

The last snapshot is kept as an index from key to hash, bucketed by key. A new snapshot becomes such an index too; the
two are compared bucket by bucket without a shuffle, old and new values are fetched only for keys whose hash differs,
and the new index takes the old one's place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.workspace import Workspace


def json_value(c: Column | str) -> Column:
    """A JSON text in one spelling: sorted keys, no spacing, numbers without trailing zeros. A text that is no JSON stays
    as it is. Numbers with an exponent count as floating point and differ from whole ones."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def fingerprint(texts: list[Column]) -> Column:
    """128 bits over texts of which null equals empty."""
    return F.unhex(F.md5(F.concat_ws("\x1e", *[F.concat(F.length(t), F.lit(":"), t) for t in (F.coalesce(x.cast("string"), F.lit("")) for x in texts)])))


class SnapshotIndex:
    """Key-to-hash indexes in buckets, one after the other."""

    def __init__(self, spark: SparkSession, work: Workspace, key: str, buckets: int | None = None):
        self.spark, self.work, self.key = spark, work, key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.current: str | None = None

    def build(self, rows: DataFrame) -> str:
        """rows: key, hash; each key once."""
        name = f"weft_idx_{uuid.uuid4().hex[:16]}"
        rows = rows.repartition(self.buckets, self.key)
        rows.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.work.at(name)).saveAsTable(name)
        return name

    def forget(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        self.work.drop(name)

    def compare(self, old: str, new: str) -> DataFrame:
        a, b = self.spark.table(old).withColumnRenamed("hash", "old_hash"), self.spark.table(new).withColumnRenamed("hash", "new_hash")
        change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("changed")
        return a.join(b, self.key, "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(self.key, change.alias("change"))


def current_rows(rows: DataFrame, key: str, order: str, hashed: Column) -> DataFrame:
    """For each key the hash of its row with the greatest ``order``; among equal ones the greatest hash, nulls last."""
    best = F.max(F.struct(F.col(order), hashed.alias("hash")))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("best")).select(key, F.col("best.hash").alias("hash"))


def snapshot_changes(spark: SparkSession, work: Workspace, rows: DataFrame, version: str, key: str, order: str, hashed: Column) -> DataFrame:
    """Every change from each version to the next that occurs: version, key, change. The first version gives none."""
    versions = sorted(r[0] for r in rows.where(F.col(version).isNotNull()).select(version).distinct().collect())
    index = SnapshotIndex(spark, work, key)
    kind = rows.schema[key].dataType.simpleString()
    out = spark.createDataFrame([], f"{version} int, {key} {kind}, change string")
    for v in versions:
        new = index.build(current_rows(rows.where(F.col(version) == v), key, order, hashed))
        if index.current:
            found = index.compare(index.current, new).select(F.lit(v).cast("int").alias(version), key, "change")
            out = out.unionByName(work.save(found, f"changes={v}"))
            index.forget(index.current)
        index.current = new
    if index.current:
        index.forget(index.current)
    return out


def changed_values(changes: DataFrame, rows: DataFrame, version: str, key: str, order: str, columns: list[str]) -> DataFrame:
    """Old and new values, fetched for the changes only: for each change the row that counts before and after it."""
    versions = sorted(r[0] for r in rows.where(F.col(version).isNotNull()).select(version).distinct().collect())
    before = dict(zip(versions[1:], versions))
    pairs = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None).cast("map<int,int>")
    wanted = changes.select(key, "change", F.col(version).alias("_now"), F.try_element_at(pairs, F.col(version)).alias("_was"))
    sides = wanted.select(key, "change", "_now", F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("_was").alias(version)), F.struct(F.lit("new").alias("side"), F.col("_now").alias(version)))).alias("s")).select(key, "change", "_now", "s.side", f"s.{version}")
    hit = rows.join(sides, [version, key]).groupBy("_now", key, "change", "side").agg(F.max(F.struct(order, *columns)).alias("r"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct(*[F.col(f"r.{c}").alias(c) for c in columns])))
    return hit.groupBy(F.col("_now").alias(version), key, "change").agg(side("old").alias("old"), side("new").alias("new"))
