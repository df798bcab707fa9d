"""Operators over enumerated paths and over chains of calls under conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import best_per_group
from weftgraph.operators.traverse import closure, simple_paths


def path_between(spark: SparkSession, edges: DataFrame, starts: DataFrame, ends: DataFrame, max_hops: int, limit: int | None = None) -> DataFrame:
    """Simple paths from any start to any end, the shortest first; limit is the report's length."""
    out = simple_paths(spark, edges, starts, max_hops, ends=ends).select("start", "id", "hops", F.array_join("path", ">").alias("path"))
    return out.orderBy("hops", "path").limit(limit) if limit else out


def reverse_trace(spark: SparkSession, edges: DataFrame, target: DataFrame, max_hops: int, entries: DataFrame) -> DataFrame:
    """Paths that end at the target, from the target back: path in calling order, whether it begins at an entry. Only paths
    that can't be longer, or that begin at an entry, are reported."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = simple_paths(spark, back, target, max_hops)
    is_entry = entries.select("id").distinct().withColumn("entry", F.lit(True))
    return found.join(is_entry, "id", "left").select(F.array_join(F.reverse("path"), ">").alias("path"), "hops", F.coalesce("entry", F.lit(False)).alias("entry"))


def key_paths(spark: SparkSession, edges: DataFrame, entries: DataFrame, ends: DataFrame, max_hops: int, top: int) -> DataFrame:
    """The best path of each entry: the entry's score times its length, 1.3 times that across domains; ends count once.
    entries: id, score, domain; ends: id, domain."""
    found = simple_paths(spark, edges, entries.select("id"), max_hops, ends=ends.select("id"))
    rows = found.join(entries.select(F.col("id").alias("start"), "score", F.col("domain").alias("a")), "start").join(ends.select("id", F.col("domain").alias("b")), "id")
    value = F.round(F.col("score") * F.col("hops") * F.when(F.col("a") != F.col("b"), 1.3).otherwise(1.0), 6)
    rows = rows.select("start", "id", "hops", F.array_join("path", ">").alias("path"), value.alias("value"))
    one = best_per_group(rows, ["start"], [F.desc("value"), F.asc("path")], 1, "_r").drop("_r")
    one = best_per_group(one, ["id"], [F.desc("value"), F.asc("path")], 1, "_r").drop("_r")
    return one.orderBy(F.desc("value"), "path").limit(top)


def resolve_chain(spark: SparkSession, edges: DataFrame, start: DataFrame, alive: Column, max_depth: int = 20) -> DataFrame:
    """What a start reaches over edges that are alive under a binding: id, depth. alive: a column over the edges."""
    return closure(spark, edges.where(alive).select("src", "dst"), start, "down", max_depth).select("id", "depth")


def diff_chains(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, where: only_a, only_b or both."""
    rows = a.select("id", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("id", F.lit(0).alias("x"), F.lit(1).alias("y"))).groupBy("id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return rows.select("id", F.when((F.col("x") == 1) & (F.col("y") == 1), "both").when(F.col("x") == 1, "only_a").otherwise("only_b").alias("where"))


def param_flow(spark: SparkSession, args: DataFrame, params: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """Follows a parameter through argument positions. args: fn, callee, pos, value (the text of an argument); params: fn, pos,
    name; start: fn, name. Returns fn, name, depth; an argument carries a parameter that it names as a whole word."""
    from weftgraph.workspace import Workspace

    work = Workspace(spark, "params")
    words = work.save(args.select("fn", "callee", "pos", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"([A-Za-z_]\w*)"), 1))).alias("name")), "words")
    level = work.save(start.select("fn", "name").distinct().withColumn("depth", F.lit(0)), "level=0")
    seen = level
    for depth in range(1, max_depth + 1):
        step = level.select("fn", "name").join(words, ["fn", "name"]).select(F.col("callee").alias("fn"), "pos").join(params, ["fn", "pos"]).select("fn", "name").distinct()
        level = work.save(step.join(seen, ["fn", "name"], "left_anti").withColumn("depth", F.lit(depth)), f"level={depth}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def propagate_models(spark: SparkSession, edges: DataFrame, entries: DataFrame, owners: DataFrame) -> DataFrame:
    """Thread models handed down from entries to what they reach, stopping at functions that own one. entries: id, model,
    priority; of several models the one with the greatest priority, then the greatest name, wins. Returns id, model.

    What travels is a model, not an entry, so a function is visited once for each model and not for each entry."""
    from weftgraph.workspace import Workspace

    work = Workspace(spark, "models")
    stop = work.save(owners.select("id").distinct(), "owners")
    calls = work.save(edges.select("src", "dst").distinct(), "calls")
    level = work.save(entries.select("id", "model", "priority").distinct(), "level=0")
    seen, step = level, 0
    while not level.isEmpty():
        step += 1
        new = level.withColumnRenamed("id", "src").join(calls, "src").select(F.col("dst").alias("id"), "model", "priority").distinct()
        new = new.join(stop, "id", "left_anti").join(seen, ["id", "model", "priority"], "left_anti")
        level = work.save(new, f"level={step}")
        seen = seen.unionByName(level)
    return seen.groupBy("id").agg(F.max(F.struct("priority", "model")).alias("m")).select("id", "m.model")
