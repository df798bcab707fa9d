"""Named views, closures over typed edges, structure and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import infer
from weftgraph.functions import text as words
from weftgraph.operators import graph, traverse
from weftgraph.plans.cypher import Cypher
from weftgraph.sources.tables import table

TOP = 20


def _nodes(spark, d):
    return graph.function_nodes(table(spark, d, "functions"))


def _edges(spark, d):
    return graph.all_edges(table(spark, d, "edges"))


def _busiest(spark, d, relations):
    e = _edges(spark, d).where(F.col("relation").isin(*relations))
    return graph.degree(e, "src", "n").orderBy(F.desc("n"), "id").limit(1).select("id")


def sync_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Functions by the locks that they take."""
    e = _edges(spark, d).where("relation = 'LOCKS'")
    return e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_locks"), F.countDistinct("dst").alias("n_resources")).orderBy(F.desc("n_locks"), "id").limit(TOP)


def data_flow_hotspots(spark, d):
    e = _edges(spark, d).where("relation in ('DATA_FLOW', 'RETURN_FLOW')")
    return e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_flows")).orderBy(F.desc("n_flows"), "id").limit(TOP)


def version_history(spark, d):
    """Each version with its commit, parent and what its snapshot and its edges hold."""
    n = table(spark, d, "cgdb_nodes").groupBy("version_id").agg(F.countDistinct("fqn").alias("n_nodes"))
    e = table(spark, d, "edges").groupBy("version_id").agg(F.countDistinct("id").alias("n_edges"))
    v = table(spark, d, "graph_versions").select("version_id", "commit_short", "parent_version_id")
    return v.join(n, "version_id", "left").join(e, "version_id", "left").na.fill(0, ["n_nodes", "n_edges"])


def shared_commits(spark, d):
    """Commits that more than one version has."""
    v = table(spark, d, "graph_versions").where("commit_hash is not null")
    return v.groupBy("commit_hash").agg(F.count("*").alias("n"), F.min("version_id").alias("first_version"), F.max("version_id").alias("last_version")).where("n > 1")


def trace_data_flow(spark, d):
    """What data of the function with most flows reaches, over data and return flows."""
    rel = ("DATA_FLOW", "RETURN_FLOW")
    e = _edges(spark, d).where(F.col("relation").isin(*rel))
    return traverse.closure(spark, e, _busiest(spark, d, rel), "down", 20).select("id", "depth")


def include_closure(spark, d):
    """What is affected by a change of the function that most import: all importers, at any distance."""
    e = _edges(spark, d).where("relation = 'IMPORTS'")
    start = graph.degree(e, "dst", "n").orderBy(F.desc("n"), "id").limit(1).select("id")
    return traverse.closure(spark, e, start, "up").select("id", "depth")


def find_invokers(spark, d):
    """Callers and binders of the function that most calls reach, within two typed hops."""
    e = _edges(spark, d).where("relation in ('INVOKES', 'OPS_BIND')")
    start = graph.degree(e, "dst", "n").join(_nodes(spark, d).select("id"), "id").orderBy(F.desc("n"), "id").limit(1).select("id")
    return traverse.closure(spark, e, start, "up", 2).where("depth > 0").select("id", "depth")


def ops_impls(spark, d):
    """Implementations that tables of operations bind: each with its rank by name within its table."""
    e = _edges(spark, d).where("relation = 'OPS_BIND'").select("src", "dst").distinct().join(_nodes(spark, d).select(F.col("id").alias("dst"), "name"), "dst")
    return e.select("src", "dst", "name", F.row_number().over(Window.partitionBy("src").orderBy("name", "dst")).alias("rank"))


def struct_layout(spark, d):
    """Fields of each file's snapshot in byte order: the offset to the field before."""
    n = table(spark, d, "cgdb_nodes").where("kind = 'field' and file_id is not null and byte_start is not null and fqn is not null")
    n = n.select("version_id", "file_id", "fqn", "byte_start").distinct()
    w = Window.partitionBy("version_id", "file_id").orderBy("byte_start", "fqn")
    return n.select("version_id", "file_id", "fqn", "byte_start", F.row_number().over(w).alias("position"), (F.col("byte_start") - F.lag("byte_start").over(w)).alias("gap"))


def kind_counts(spark, d):
    """The index's status: rows and names by kind in the newest snapshot."""
    n = table(spark, d, "cgdb_nodes")
    newest = n.agg(F.max("version_id").alias("version_id"))
    return n.join(F.broadcast(newest), "version_id", "left_semi").groupBy("kind").agg(F.count("*").alias("n_rows"), F.countDistinct("fqn").alias("n_names"))


def label_counts(spark, d):
    return _nodes(spark, d).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def confidence_stats(spark, d):
    """Confidence by source of the edge: count, mean and least score."""
    return _edges(spark, d).groupBy("confidence").agg(F.count("*").alias("n"), F.count("confidence_score").alias("n_scored"), F.round(F.avg("confidence_score"), 6).alias("mean"), F.min("confidence_score").alias("least"))


def undocumented_hubs(spark, d):
    """Suggestions: functions with at least three callers and no documentation in any span."""
    bodies = table(spark, d, "functions").where("id is not null").groupBy("id").agg(F.max(F.coalesce(infer.documented(F.col("body_text_compressed")), F.lit(False))).alias("doc"))
    callers = graph.pairs(graph.call_edges(table(spark, d, "edges"))).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_callers")).where("n_callers >= 3")
    return callers.join(bodies, "id").where("not doc").select("id", "n_callers")


def fan_out(spark, d):
    """Suggestions: functions that call at least 20 others."""
    return graph.pairs(graph.call_edges(table(spark, d, "edges"))).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_callees")).where("n_callees >= 20")


def dead_apis(spark, d):
    """Suggestions: API entries that nothing calls."""
    called = graph.call_edges(table(spark, d, "edges")).select(F.col("dst").alias("id")).distinct()
    return _nodes(spark, d).where(F.array_contains("labels", "API_entry")).join(called, "id", "left_anti").select("id", "name")


def endpoint_classes(spark, d):
    """Called keys that no function has, classified by name."""
    low = F.lower("id")
    kind = F.when(low.rlike("lock|mutex|sync"), "synchronization").when(low.rlike("alloc|heap|arena|page|cache"), "memory").when(low.rlike("queue|channel|packet|net"), "messaging").when(low.rlike("read|write|flush|poll|io"), "io").when(low.rlike("log|trace|probe"), "tracing").otherwise("other")
    ends = graph.external_callees(_nodes(spark, d), graph.call_edges(table(spark, d, "edges")))
    return ends.groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.sum("n_calls").alias("n_calls"))


def relevance_search(spark, d):
    """Scored search with synonyms: a part of the name 3, a prefix of one 1.5, the signature 1, the domain 0.5; synonyms count
    half."""
    query = {"flush": 1.0, "drain": 0.5, "page": 1.0}
    parts = words.name_parts(F.col("name"))
    has = lambda c: F.when(c, 1.0).otherwise(0.0)
    begins = lambda w: F.exists(parts, lambda p: F.startswith(p, F.lit(w[:4])))
    score = F.lit(0.0)
    for w, weight in query.items():
        one = F.when(F.array_contains(parts, w), 3.0).when(begins(w), 1.5).otherwise(0.0)
        one = one + has(F.coalesce(F.contains(F.lower("signature"), F.lit(w)), F.lit(False))) + 0.5 * has(F.coalesce(F.contains(F.lower("domain"), F.lit(w)), F.lit(False)))
        score = score + weight * one
    return _nodes(spark, d).where("name is not null").select("id", F.round(score, 4).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(TOP)


def postconditions(spark, d):
    """Constants that functions return last, by how many do."""
    rows = table(spark, d, "functions").where("body_text_compressed is not null").select("id", F.col("body_text_compressed").alias("body")).distinct()
    last = F.element_at(infer.return_expressions(F.col("body")), -1)
    got = rows.where(F.size(infer.return_expressions(F.col("body"))) > 0).select(last.alias("value"))
    return got.groupBy("value").agg(F.count("*").alias("n"), F.max(F.col("value").rlike("^(?:0|SUCCESS|OK|true|True|nil|None)$")).alias("success"))


def node_resolution(spark, d):
    """The best match for a partial name: exact id, exact name, prefix of the name, part of the id, part of the name; the least
    id of the best kind."""
    q = "flush"
    rank = F.when(F.col("id") == q, 1).when(F.col("name") == q, 2).when(F.startswith("name", F.lit(q)), 3).when(F.contains("id", F.lit(q)), 4).when(F.contains("name", F.lit(q)), 5)
    return _nodes(spark, d).withColumn("rank", rank).where("rank is not null").orderBy("rank", "id").limit(1).select("id", "rank")


def source_origins(spark, d):
    """Provenance: edges by the extractor that found them and by version."""
    rows = table(spark, d, "edges").where("id is not null").select("id", F.coalesce("source", F.lit("unknown")).alias("source"), "version_id").distinct()
    return rows.groupBy("source", "version_id").agg(F.count("*").alias("n"))


def cypher_config(spark, d):
    """Functions with a call under a condition that names ready, by CONFIG()."""
    e = _edges(spark, d)
    config = table(spark, d, "edges").where("call_condition is not null and invoker_id is not null").select(F.col("invoker_id").alias("id"), F.col("call_condition").alias("predicate")).distinct()
    return Cypher(spark, _nodes(spark, d).select("id", "name", "labels"), e, config).run("MATCH (n) WHERE CONFIG(n, 'ready') RETURN n.id AS id, n.name AS name")


QUERIES = {
    f.__name__: f
    for f in (
        sync_hotspots, data_flow_hotspots, version_history, shared_commits, trace_data_flow, include_closure, find_invokers, ops_impls, struct_layout, kind_counts, label_counts, confidence_stats, undocumented_hubs, fan_out,
        dead_apis, endpoint_classes, relevance_search, postconditions, node_resolution, source_origins, cypher_config,
    )
}

_B = """ranked as (select *, row_number() over (partition by id order by first_seen_version desc nulls last, last_seen_version desc nulls last, name desc nulls last, domain desc nulls last, source_file desc nulls last, line_number desc nulls last, signature desc nulls last) as rn from functions where id is not null),
nodes as (select * from ranked where rn = 1),
e as (select distinct on (id) id, invoker_id as src, invoked_id as dst, relation, confidence, confidence_score from edges where invoker_id is not null and invoked_id is not null),
calls as (select * from e where coalesce(relation, 'INVOKES') not in ('CONTAINS', 'IMPORTS')), pairs as (select distinct src, dst from calls)"""


def _reach(start: str, relations: str, frm: str, to: str, depth: int) -> str:
    return f"x as (select distinct src, dst from e where relation in ({relations})), s as ({start}), r as (select id, 0 as depth from s union select x.{to}, r.depth + 1 from r join x on x.{frm} = r.id where r.depth < {depth})"


_DF = "'DATA_FLOW', 'RETURN_FLOW'"
_P = "list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '([a-z0-9]+)', 1))"
_REL = " + ".join(
    f"{k} * (case when list_contains(p, '{w}') then 3.0 when len(list_filter(p, lambda z: starts_with(z, '{w[:4]}'))) > 0 then 1.5 else 0.0 end + case when contains(lower(signature), '{w}') then 1.0 else 0.0 end + case when contains(lower(domain), '{w}') then 0.5 else 0.0 end)"
    for w, k in (("flush", 1.0), ("drain", 0.5), ("page", 1.0))
)

SQL = {
    "sync_hotspots": f"with {_B} select src as id, count(*) as n_locks, count(distinct dst) as n_resources from e where relation = 'LOCKS' group by 1 order by 2 desc, 1 limit 20",
    "data_flow_hotspots": f"with {_B} select dst as id, count(*) as n_flows from e where relation in ({_DF}) group by 1 order by 2 desc, 1 limit 20",
    "version_history": "select v.version_id, v.commit_short, v.parent_version_id, coalesce(n.n, 0) as n_nodes, coalesce(e.n, 0) as n_edges from graph_versions v left join (select version_id, count(distinct fqn) as n from cgdb_nodes group by 1) n using (version_id) left join (select version_id, count(distinct id) as n from edges group by 1) e using (version_id)",
    "shared_commits": "select commit_hash, count(*) as n, min(version_id) as first_version, max(version_id) as last_version from graph_versions where commit_hash is not null group by 1 having count(*) > 1",
    "trace_data_flow": f"with recursive {_B}, {_reach(f'select src as id from e where relation in ({_DF}) group by 1 order by count(*) desc, 1 limit 1', _DF, 'src', 'dst', 20)} select id, min(depth) as depth from r group by 1",
    "include_closure": f"""with recursive {_B}, {_reach("select dst as id from e where relation = 'IMPORTS' group by 1 order by count(*) desc, 1 limit 1", "'IMPORTS'", 'dst', 'src', 60)} select id, min(depth) as depth from r group by 1""",
    "find_invokers": f"""with recursive {_B}, {_reach("select dst as id from e join nodes n on n.id = dst where relation in ('INVOKES', 'OPS_BIND') group by 1 order by count(*) desc, 1 limit 1", "'INVOKES', 'OPS_BIND'", 'dst', 'src', 2)} select id, min(depth) as depth from r group by 1 having min(depth) > 0""",
    "ops_impls": f"with {_B}, b as (select distinct src, dst from e where relation = 'OPS_BIND') select b.src, b.dst, n.name, row_number() over (partition by b.src order by n.name nulls first, b.dst) as rank from b join nodes n on n.id = b.dst",
    "struct_layout": "with n as (select distinct version_id, file_id, fqn, byte_start from cgdb_nodes where kind = 'field' and file_id is not null and byte_start is not null and fqn is not null) select *, row_number() over w as position, byte_start - lag(byte_start) over w as gap from n window w as (partition by version_id, file_id order by byte_start, fqn)",
    "kind_counts": "select kind, count(*) as n_rows, count(distinct fqn) as n_names from cgdb_nodes where version_id = (select max(version_id) from cgdb_nodes) group by 1",
    "label_counts": f"with {_B} select label, count(*) as n from (select unnest(labels) as label from nodes) group by 1",
    "confidence_stats": f"with {_B} select confidence, count(*) as n, count(confidence_score) as n_scored, round(avg(confidence_score), 6) as mean, min(confidence_score) as least from e group by 1",
    "undocumented_hubs": f"with {_B}, b as (select id, bool_or(coalesce(regexp_matches(body_text_compressed, '(?s)^\\s*(?:/\\*|//|#[ #]|(?:async )?def [^\\n]*\\n\\s*r?(?:\"\"\"|''''''))'), false)) as doc from functions where id is not null group by 1), c as (select dst as id, count(*) as n_callers from pairs group by 1 having count(*) >= 3) select id, n_callers from c join b using (id) where not doc",
    "fan_out": f"with {_B} select src as id, count(*) as n_callees from pairs group by 1 having count(*) >= 20",
    "dead_apis": f"with {_B} select id, name from nodes where list_contains(labels, 'API_entry') and id not in (select dst from calls)",
    "endpoint_classes": f"with {_B}, x as (select dst as id, count(*) as c from calls where dst not in (select id from nodes) group by 1) select case when regexp_matches(lower(id), 'lock|mutex|sync') then 'synchronization' when regexp_matches(lower(id), 'alloc|heap|arena|page|cache') then 'memory' when regexp_matches(lower(id), 'queue|channel|packet|net') then 'messaging' when regexp_matches(lower(id), 'read|write|flush|poll|io') then 'io' when regexp_matches(lower(id), 'log|trace|probe') then 'tracing' else 'other' end as type, count(*) as n, sum(c)::bigint as n_calls from x group by 1",
    "relevance_search": f"with {_B}, t as (select id, signature, domain, {_P} as p from nodes where name is not null), s as (select id, round({_REL}, 4)::double as score from t) select id, score from s where score > 0 order by score desc, id limit 20",
    "postconditions": "with b as (select distinct id, body_text_compressed as body from functions where body_text_compressed is not null), r as (select trim(list_extract(regexp_extract_all(body, '\\breturn\\b[ \\t]*([^;\\n{}]*)', 1), -1), ' ') as value from b where len(regexp_extract_all(body, '\\breturn\\b[ \\t]*([^;\\n{}]*)', 1)) > 0) select value, count(*) as n, bool_or(regexp_matches(value, '^(?:0|SUCCESS|OK|true|True|nil|None)$')) as success from r group by 1",
    "node_resolution": f"with {_B}, r as (select id, case when id = 'flush' then 1 when name = 'flush' then 2 when starts_with(name, 'flush') then 3 when contains(id, 'flush') then 4 when contains(name, 'flush') then 5 end as rank from nodes) select id, rank from r where rank is not null order by rank, id limit 1",
    "source_origins": "select source, version_id, count(*) as n from (select distinct id, coalesce(source, 'unknown') as source, version_id from edges where id is not null) group by 1, 2",
    "cypher_config": f"with {_B} select id, name from nodes where id in (select invoker_id from edges where regexp_matches(call_condition, 'ready') and replace(call_condition, 'NOT ready', '') like '%ready%')",
}
