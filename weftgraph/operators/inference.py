"""Build-time passes that infer edges: each takes facts as tables and gives edges src, dst, relation, concurrency,
confidence, confidence_score. Edges from a function to itself and edges that exist already are left out by ``finish``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import best_per_group

COLUMNS = ("src", "dst", "relation", "concurrency", "confidence", "confidence_score")


def _edges(rows: DataFrame, concurrency: str, score, confidence: str = "INFERRED", relation: str = "INVOKES") -> DataFrame:
    s = score if isinstance(score, Column) else F.lit(float(score))
    return rows.select("src", "dst", F.lit(relation).alias("relation"), F.lit(concurrency).alias("concurrency"), F.lit(confidence).alias("confidence"), s.alias("confidence_score"))


def finish(edges: DataFrame, existing: DataFrame) -> DataFrame:
    new = edges.where("src is not null and dst is not null and src <> dst")
    best = best_per_group(new, ["src", "dst"], [F.desc("confidence_score"), F.asc("concurrency")], 1, "_r").drop("_r")
    return best.join(existing.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def alias_edges(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """aliases: alias, original (names)."""
    a = aliases.join(nodes.select(F.col("name").alias("alias"), F.col("id").alias("src")), "alias").join(nodes.select(F.col("name").alias("original"), F.col("id").alias("dst")), "original")
    return _edges(a, "", 1.0, "EXTRACTED")


def chain_key(chain: Column) -> Column:
    """A chain of fields in one spelling."""
    return F.regexp_replace(F.regexp_replace(chain, "->", "."), r"\s+", "")


def field_dispatch(calls: DataFrame, assignments: DataFrame, generic: int = 5, most: int = 20) -> DataFrame:
    """Calls through a field to what was assigned to it. calls: src, field, chain, domain; assignments: field, chain, target,
    domain. An exact chain wins; else a field with at most ``generic`` targets in the caller's domain; fields with more than
    ``most`` targets need the exact chain."""
    c = calls.withColumn("k", chain_key(F.col("chain")))
    t = assignments.withColumn("k", chain_key(F.col("chain"))).select("field", "k", F.col("target").alias("dst"), F.col("domain").alias("t_domain")).distinct()
    sizes = t.groupBy("field").agg(F.countDistinct("dst").alias("n_field"))
    near = t.groupBy("field", "t_domain").agg(F.countDistinct("dst").alias("n_domain"))
    exact = c.join(t.select("field", "k", "dst").distinct(), ["field", "k"]).select("src", "field", "k", "dst", F.lit(0.9).alias("score"))
    done = exact.select("src", "field", "k").distinct()
    rest = c.join(done, ["src", "field", "k"], "left_anti").join(sizes, "field").where(F.col("n_field") <= most)
    loose = rest.join(t.drop("k"), "field").where(F.col("domain") == F.col("t_domain")).join(near, ["field", "t_domain"]).where(F.col("n_domain") <= generic)
    loose = loose.select("src", "field", "k", "dst", F.lit(0.6).alias("score")).distinct()
    rows = exact.unionByName(loose)
    return _edges(rows, "field_dispatch", F.col("score"))


def vtable_dispatch(calls: DataFrame, registrations: DataFrame, cap: int = 50) -> DataFrame:
    """calls: src, struct, field; registrations: struct, field, target. At most ``cap`` targets for one call, the first by id:
    the cap is part of the rule."""
    rows = calls.join(registrations.select("struct", "field", F.col("target").alias("dst")), ["struct", "field"]).distinct()
    return _edges(best_per_group(rows, ["src", "struct", "field"], [F.asc("dst")], cap, "_r"), "vtable_dispatch", 0.8)


def wrapper_dispatch(nodes: DataFrame, calls: DataFrame, registrations: DataFrame) -> DataFrame:
    """Callers of call_X, __call_X and invoke_X without a source of their own go to what is registered for X."""
    w = nodes.where("source_file is null or source_file = ''").select(F.col("id").alias("dst"), F.regexp_extract("name", r"^(?:__)?(?:call|invoke)_(\w+)$", 1).alias("field")).where("field <> ''")
    rows = calls.select("src", "dst").distinct().join(w, "dst").select("src", "field").join(registrations.select("field", F.col("target").alias("dst")), "field").distinct()
    return _edges(rows, "vtable_dispatch", 0.7)


def callback_bridges(calls: DataFrame, callbacks: DataFrame, most_callers: int = 15, most_targets: int = 20) -> DataFrame:
    """A function that calls a callback it was handed reaches what its callers hand over. calls: src, dst; callbacks: src (who
    hands over), via (to whom), target. Functions with more callers or targets are left out, as the rule has it."""
    callers = calls.select("src", "dst").distinct()
    few = callers.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") <= most_callers).select(F.col("dst").alias("via"))
    rows = callbacks.join(few, "via").select(F.col("via").alias("src"), F.col("target").alias("dst")).distinct()
    small = rows.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") <= most_targets).select("src")
    return _edges(rows.join(small, "src"), "callback_dispatch", 0.7)


def macro_bridges(nodes: DataFrame) -> DataFrame:
    """A function without a source, or from a header, to the one named with two underscores before it, in the same domain."""
    n = nodes.select("id", F.lower("name").alias("name"), F.split("domain", r"\.")[0].alias("root"), "source_file")
    a = n.where(~F.col("name").startswith("__") & (F.coalesce("source_file", F.lit("")).eqNullSafe("") | F.col("source_file").endswith(".h"))).select(F.col("id").alias("src"), F.concat(F.lit("__"), "name").alias("name"), "root")
    return _edges(a.join(n.select(F.col("id").alias("dst"), "name", "root"), ["name", "root"]), "macro_bridge", 0.95)


def conditional_parents(nodes: DataFrame) -> DataFrame:
    """X -> X__cond_N and X__cond_N_else."""
    n = nodes.select("id", F.regexp_extract("id", r"^(.+)__cond_\d+(?:_else)?$", 1).alias("parent")).where("parent <> ''")
    return _edges(n.join(nodes.select(F.col("id").alias("parent")), "parent").select(F.col("parent").alias("src"), F.col("id").alias("dst")), "conditional_entry", 0.95, "EXTRACTED")


def contains_edges(nodes: DataFrame) -> DataFrame:
    """From a node for each file to the functions in it."""
    rows = nodes.where("source_file is not null and source_file <> ''").select(F.concat(F.lit("file:"), "source_file").alias("src"), F.col("id").alias("dst"))
    return _edges(rows, "contains", 1.0, "EXTRACTED", "CONTAINS")


def degree_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, labels: in_end without callers; out_end without calls and without a source; leaf_func otherwise without calls."""
    calls = edges.where("coalesce(relation, 'INVOKES') not in ('CONTAINS', 'IMPORTS')")
    has_in = calls.select(F.col("dst").alias("id")).distinct().withColumn("i", F.lit(True))
    has_out = calls.select(F.col("src").alias("id")).distinct().withColumn("o", F.lit(True))
    n = nodes.select("id", "source_file").join(has_in, "id", "left").join(has_out, "id", "left")
    own = F.coalesce("source_file", F.lit("")) != ""
    extra = F.array(F.when(F.col("i").isNull(), "in_end"), F.when(F.col("o").isNull() & ~own, "out_end"), F.when(F.col("o").isNull() & own, "leaf_func"))
    return n.select("id", F.filter(extra, lambda x: x.isNotNull()).alias("labels"))


def resolve_callees(calls: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """src, callee, dst, confidence: the best of same file .95, import .85, same domain .75, suffix .60, unique name .55, and an
    ambiguous name .40 in the domain or .30 elsewhere. calls: src, file, domain, callee; imports: file, name, id."""
    # one candidate for each name, name in a domain and name in a file, so that a common name doesn't meet all its definitions
    n = nodes.where("name is not null").select("id", F.col("name").alias("callee"), F.col("source_file").alias("file"), "domain")
    by = lambda *keys: n.groupBy("callee", *keys).agg(F.min("id").alias("dst"), F.countDistinct("id").alias("n"))
    calls = calls.where("callee is not null")
    one = lambda rows, score: rows.select("src", "callee", "dst", score.alias("confidence"))
    whole = by().withColumnRenamed("n", "n_all")
    here = calls.join(by("file"), ["callee", "file"])
    near = calls.join(by("domain"), ["callee", "domain"]).join(whole.select("callee", "n_all"), "callee")
    last = F.element_at(F.split("callee", r"[.:]+"), -1)
    tails = calls.where(last != F.col("callee")).select("src", "callee", last.alias("last"))
    cand = (
        one(here, F.lit(0.95))
        .unionByName(one(near, F.when(F.col("n_all") == 1, 0.75).otherwise(0.40)))
        .unionByName(one(calls.join(whole, "callee"), F.when(F.col("n_all") == 1, 0.55).otherwise(0.30)))
        .unionByName(one(calls.join(imports.groupBy("file", F.col("name").alias("callee")).agg(F.min("id").alias("dst")), ["file", "callee"]), F.lit(0.85)))
        .unionByName(one(tails.join(whole.withColumnRenamed("callee", "last"), "last"), F.lit(0.60)))
    )
    return best_per_group(cand, ["src", "callee"], [F.desc("confidence"), F.asc("dst")], 1, "_r").drop("_r")
