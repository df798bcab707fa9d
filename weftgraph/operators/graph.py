"""The call graph as two tables, and the relational operators over it.

nodes: id, name, domain, source_file, line_number, signature, labels; one row for each function id, its latest life span.
edges: src, dst and what the edge says, parallel edges kept, rows delivered twice once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relations that are no calls; every call traversal leaves them out.
NOT_CALLS = ("CONTAINS", "IMPORTS")


def function_nodes(functions: DataFrame) -> DataFrame:
    cols = ["first_seen_version", "last_seen_version", "name", "domain", "source_file", "line_number", "signature"]
    last = F.max(F.struct(*cols, "labels")).alias("f")
    return functions.where("id is not null").groupBy("id").agg(last).select("id", *[f"f.{c}" for c in cols], "f.labels")


def all_edges(edges: DataFrame) -> DataFrame:
    cols = ["relation", "call_order", "call_condition", "concurrency", "confidence", "confidence_score", "version_id"]
    rows = edges.where("invoker_id is not null and invoked_id is not null").select("id", F.col("invoker_id").alias("src"), F.col("invoked_id").alias("dst"), *cols)
    return rows.dropDuplicates(["id"])


def call_edges(edges: DataFrame) -> DataFrame:
    """Edges that are calls; an edge without a relation counts as one."""
    return all_edges(edges).where(~F.coalesce("relation", F.lit("INVOKES")).isin(*NOT_CALLS))


def pairs(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst), as a directed graph without parallel edges has it."""
    return edges.select("src", "dst").distinct()


def degree(edges: DataFrame, end: str, name: str) -> DataFrame:
    return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))


def top(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


def hotspots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls between different domains: src_domain, dst_domain, n. Calls are counted by pair of functions first, so a
    function that a third of all calls reach is one row for each caller."""
    counted = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    a, b = nodes.select(F.col("id").alias("src"), F.col("domain").alias("src_domain")), nodes.select(F.col("id").alias("dst"), F.col("domain").alias("dst_domain"))
    rows = counted.join(a, "src").join(b, "dst").where("src_domain <> dst_domain")
    return rows.groupBy("src_domain", "dst_domain").agg(F.sum("n").alias("n"))


def domain_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("id").alias("src"), F.col("domain").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("domain").alias("b"))
    inner = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(a, "src").join(b, "dst").where("a = b").groupBy(F.col("a").alias("domain")).agg(F.sum("n").alias("n_edges"))
    return nodes.groupBy("domain").agg(F.count("*").alias("n_nodes")).join(inner, "domain", "left").select("domain", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def external_callees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Called keys that no function has: id, n_calls."""
    return degree(edges, "dst", "n_calls").join(nodes.select("id"), "id", "left_anti")


def hub_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in x out x (1 + 0.5 for each other domain that calls), over the greatest."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("domain").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("domain").alias("b"))
    cross = pairs(edges).join(a, "src").join(b, "dst").where("a <> b").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("a").alias("cross"))
    one = degree(edges, "dst", "n_in").join(degree(edges, "src", "n_out"), "id").join(cross, "id", "left")
    raw = one.join(nodes.select("id"), "id").withColumn("raw", F.col("n_in") * F.col("n_out") * (1 + 0.5 * F.coalesce("cross", F.lit(0))))
    most = raw.agg(F.max("raw").alias("most"))  # one row
    return raw.crossJoin(F.broadcast(most)).select("id", "n_in", "n_out", F.round(F.col("raw") / F.col("most"), 6).alias("score"))


# fixed patterns of names
TEST_NAMES = "^(test|mock|stub|bench|spec)_"
ENTRY_NAMES = "^(main|run|start|execute)$|^(handle|on|process|do|perform|dispatch)_"
UTILITY_NAMES = "^(get|set|is|has|check|validate)_"


def entry_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """out / (in + 1), doubled for API entries, times 1.5 for entry names, else 0.3 for utilities, or 0.1 for tests, to three
    places. Names are told by how they begin."""
    one = nodes.select("id", "name", F.coalesce(F.array_contains("labels", "API_entry"), F.lit(False)).alias("api"))
    one = one.join(degree(edges, "dst", "n_in"), "id", "left").join(degree(edges, "src", "n_out"), "id", "left").na.fill(0, ["n_in", "n_out"])
    low = F.lower("name")
    factor = F.when(low.rlike(TEST_NAMES), 0.1).when(low.rlike(ENTRY_NAMES), 1.5).when(low.rlike(UTILITY_NAMES), 0.3).otherwise(1.0)
    return one.select("id", "n_in", "n_out", F.round(F.col("n_out") / (F.col("n_in") + 1) * F.when(F.col("api"), 2.0).otherwise(1.0) * factor, 3).alias("score"))


def best_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def concurrency_risks(edges: DataFrame) -> DataFrame:
    """For each spawning call how many calls of the same function come after it: more than 3 is HIGH, any MEDIUM, none LOW;
    a callback's HIGH counts as MEDIUM. Counted by a window over the function's calls in order, without pairing them."""
    from pyspark.sql import Window

    kinds = ("thread_spawn", "goroutine", "spawn_target", "callback")
    after = F.count("*").over(Window.partitionBy("src").orderBy(F.desc("call_order")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.count("*").over(Window.partitionBy("src", "call_order"))
    rows = edges.where("call_order is not null").groupBy("src", "dst", "call_order", "concurrency").agg(F.count("*").alias("copies"))
    # functions without a spawning call need no window at all
    spawning = edges.where(F.col("concurrency").isin(*kinds)).select("src").distinct()
    rows = rows.join(spawning, "src", "left_semi").withColumn("later", after)
    level = F.when((F.col("later") > 3) & (F.col("concurrency") != "callback"), "HIGH").when(F.col("later") >= 1, "MEDIUM").otherwise("LOW")
    return rows.where(F.col("concurrency").isin(*kinds)).select("src", "dst", "call_order", "concurrency", "later", level.alias("risk"))
