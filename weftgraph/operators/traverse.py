"""Traversals as loops of joins over a frontier.

Each level is a table in the shared folder, so no lineage grows and a lost executor costs a task. The visited set is an
anti join; the frontier holds each node once, so a hub costs its own edges and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.workspace import Workspace

#: Hops of an open variable-length pattern.
OPEN_HOPS = 5


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    down = edges.select("src", "dst")
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"down": down, "up": up, "both": down.unionByName(up)}[direction]


#: Hops up to which a traversal reads the edges again at each level instead of writing them down once.
FEW_HOPS = 2


def _hops(work: Workspace, edges: DataFrame, direction: str, max_depth: int | None) -> DataFrame:
    """Edges by their source. Repeated ones stay: a level is made distinct anyway, and telling them here would shuffle all
    edges for what may be a few hops."""
    rows = _directed(edges, direction)
    return rows if max_depth is not None and max_depth <= FEW_HOPS else work.save(rows, "hops")


def closure(spark: SparkSession, edges: DataFrame, starts: DataFrame, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """start, id, depth: what each start reaches, with the least depth; the start itself at depth 0. starts: id."""
    work = Workspace(spark, "closure")
    hops = _hops(work, edges, direction, max_depth)
    level = work.save(starts.where("id is not null").select(F.col("id").alias("start"), "id").distinct().withColumn("depth", F.lit(0)), "level=0")
    seen, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.join(hops, level.id == hops.src).select("start", F.col("dst").alias("id")).distinct()
        level = work.save(step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)), f"level={depth}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def chain_levels(spark: SparkSession, edges: DataFrame, starts: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """depth, id: the set of nodes at each depth. A node on a cycle comes again at several depths, as with UNION recursion."""
    work = Workspace(spark, "chain")
    hops = _hops(work, edges, direction, max_depth)
    level = work.save(starts.where("id is not null").select("id").distinct().withColumn("depth", F.lit(0)), "level=0")
    out = level
    for depth in range(1, max_depth + 1):
        level = work.save(level.join(hops, level.id == hops.src).select(F.col("dst").alias("id")).distinct().withColumn("depth", F.lit(depth)), f"level={depth}")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def simple_paths(spark: SparkSession, edges: DataFrame, starts: DataFrame, max_hops: int, min_hops: int = 1, ends: DataFrame | None = None) -> DataFrame:
    """start, id, hops, path: every path without a repeated node. With ``ends`` only those that end there; paths that can't
    get there any more are dropped on the way. The number of paths grows with max_hops, so it has no default."""
    work = Workspace(spark, "paths")
    hops = work.save(_directed(edges, "down").distinct(), "hops")
    if ends is not None:  # no detours: only edges on some way to an end
        near = closure(spark, hops, ends, "up", max_hops).select(F.col("id").alias("dst")).distinct()
        hops = work.save(hops.join(near, "dst", "left_semi").select("src", "dst"), "useful")
    level = work.save(starts.select(F.col("id").alias("start"), "id", F.array("id").alias("path")).distinct(), "level=0")
    out = None
    for n in range(1, max_hops + 1):
        step = level.join(hops, level.id == hops.src).where(~F.array_contains("path", F.col("dst")))
        level = work.save(step.select("start", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")), f"level={n}")
        if n >= min_hops:
            found = level.withColumn("hops", F.lit(n))
            out = found if out is None else out.unionByName(found)
        if level.isEmpty():
            break
    if out is None:
        out = level.limit(0).withColumn("hops", F.lit(0))
    if ends is not None:
        out = out.join(ends.select("id").distinct(), "id", "left_semi")
    return out.select("start", "id", "hops", "path")


def shortest_paths(spark: SparkSession, edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, depth, parent: a shortest-path tree from one start; among equal parents the least id."""
    work = Workspace(spark, "shortest")
    hops = _hops(work, edges, "down", max_depth)
    level = work.save(start.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct(), "level=0")
    seen, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.join(hops, level.id == hops.src).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        level = work.save(step.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent"), f"level={depth}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def impact(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Callers and callers' callers of one node: id, rank (1 or 2), via. For the second the least via counts."""
    e = _directed(edges, "up").distinct()
    first = e.join(node.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    second = first.join(e, first.id == e.src).groupBy(F.col("dst").alias("id2")).agg(F.min("src").alias("via"))
    second = second.join(first, second.id2 == first.id, "left_anti").join(node, second.id2 == node.id, "left_anti").select(F.col("id2").alias("id"), F.lit(2).alias("rank"), "via")
    return first.join(node, "id", "left_anti").select("id", F.lit(1).alias("rank"), F.lit(None).cast("string").alias("via")).unionByName(second)


def risk(n):
    """How far a change reaches: more than 50 is high, more than 10 medium, any low."""
    return F.when(n > 50, "high").when(n > 10, "medium").when(n > 0, "low").otherwise("none")


def cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """domain, n_inner, n_outer, cohesion: the share of a domain's calls that stay inside."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("domain").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("domain").alias("b"))
    counted = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.sum("n").alias("n"))
    rows = counted.groupBy(F.col("a").alias("domain")).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("n_inner"), F.sum(F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0)).alias("n_outer"))
    return rows.withColumn("cohesion", F.round(F.col("n_inner") / (F.col("n_inner") + F.col("n_outer")), 6))


def components(spark: SparkSession, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component: the least id reachable without regard to direction, by min-label propagation with pointer jumping."""
    work = Workspace(spark, "components")
    links = work.save(_directed(edges, "both").distinct(), "links")
    labels = work.save(nodes.select("id", F.col("id").alias("component")).distinct(), "round=0")
    n = 0
    while True:
        n += 1
        heard = links.join(labels, links.src == labels.id).groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("heard"))
        better = labels.join(heard, "id", "left").select("id", F.least("component", F.coalesce("heard", "component")).alias("component"))
        root = better.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = better.join(root, "component", "left").select("id", F.least("component", F.coalesce("root", "component")).alias("component"))
        new = work.save(jumped, f"round={n}")
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old")
        done = changed.isEmpty()
        work.drop(f"round={n - 1}") if n > 1 else None
        labels = new
        if done:
            return labels
