"""Queries over the call graph of functions and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import graph, traverse
from weftgraph.plans.cypher import Cypher
from weftgraph.sources.tables import table

TOP = 20


def _nodes(spark, d):
    return graph.function_nodes(table(spark, d, "functions"))


def _calls(spark, d):
    return graph.call_edges(table(spark, d, "edges"))


def _most_called(spark, d):
    """The function that most calls reach; the start of the queries that need one."""
    n = _nodes(spark, d)
    return graph.degree(_calls(spark, d), "dst", "n").join(n.select("id"), "id").orderBy(F.desc("n"), "id").limit(1).select("id")


def _busiest(spark, d):
    n = _nodes(spark, d)
    return graph.degree(_calls(spark, d), "src", "n").join(n.select("id"), "id").orderBy(F.desc("n"), "id").limit(1).select("id")


def hub_functions(spark: SparkSession, d: str) -> DataFrame:
    return graph.top(graph.degree(_calls(spark, d), "src", "n_calls"), "n_calls", TOP, "id")


def hub_targets(spark: SparkSession, d: str) -> DataFrame:
    return graph.top(graph.degree(_calls(spark, d), "dst", "n_calls"), "n_calls", TOP, "id")


def cross_domain_hotspots(spark, d):
    return graph.top(graph.hotspots(_nodes(spark, d), _calls(spark, d)), "n", TOP, "src_domain", "dst_domain")


def domain_stats(spark, d):
    return graph.domain_stats(_nodes(spark, d), _calls(spark, d))


def external_callees(spark, d):
    return graph.external_callees(_nodes(spark, d), _calls(spark, d))


def hub_scores(spark, d):
    return graph.hub_scores(_nodes(spark, d), _calls(spark, d))


def entry_scores(spark, d):
    return graph.entry_scores(_nodes(spark, d), _calls(spark, d))


def archetype_top5(spark, d):
    """The five best entries of each archetype."""
    low = F.lower("name")
    kind = F.when(low.rlike("init|open|start|mount|attach"), "init").when(low.rlike("read|write|flush|poll|fold|pack"), "io").when(low.rlike("close|stop|detach|retire|drain"), "shutdown").when(low.rlike("config|set|bind"), "config").otherwise("other")
    rows = graph.entry_scores(_nodes(spark, d), _calls(spark, d)).join(_nodes(spark, d).select("id", kind.alias("archetype")), "id")
    return graph.best_per_group(rows, ["archetype"], [F.desc("score"), F.asc("id")], 5).select("archetype", "rank", "id", "score")


def callers(spark, d):
    e = _calls(spark, d).join(_most_called(spark, d).select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.join(_nodes(spark, d).select(F.col("id").alias("src"), "name", "domain"), "src").select("src", "name", "domain", "call_order", "relation")


def callees(spark, d):
    e = _calls(spark, d).join(_busiest(spark, d).select(F.col("id").alias("src")), "src", "left_semi")
    return e.join(_nodes(spark, d).select(F.col("id").alias("dst"), "name", "domain"), "dst").select("dst", "name", "domain", "call_order", "relation")


def neighbors_bfs(spark, d):
    return traverse.closure(spark, _calls(spark, d), _busiest(spark, d), "both", 2).select("id", "depth")


def call_chain_down(spark, d):
    return traverse.chain_levels(spark, _calls(spark, d), _busiest(spark, d), "down", 5)


def call_chain_up(spark, d):
    return traverse.chain_levels(spark, _calls(spark, d), _most_called(spark, d), "up", 5)


def shortest_path(spark, d):
    return traverse.shortest_paths(spark, _calls(spark, d), _busiest(spark, d))


def blast_radius(spark, d):
    """What calls the most called function within three hops, counted."""
    near = traverse.closure(spark, _calls(spark, d), _most_called(spark, d), "up", 3).where("depth > 0").select("id", "depth")
    rows = near.join(_nodes(spark, d), "id")
    api = F.array_contains("labels", "API_entry")
    return rows.agg(
        F.count("*").alias("n_affected"), F.sum((F.col("depth") == 1).cast("bigint")).alias("n_direct"), F.sum(F.coalesce(api, F.lit(False)).cast("bigint")).alias("n_api"),
        F.sum(F.col("name").rlike("test|ut_|unit_|perf|verify").cast("bigint")).alias("n_tests"), F.countDistinct("domain").alias("n_domains"),
    )


def impact_two_hop(spark, d):
    return traverse.impact(_calls(spark, d), _most_called(spark, d))


def impact_closure_risk(spark, d):
    """How many functions the most called one may affect at any distance, and the risk."""
    reach = traverse.closure(spark, _calls(spark, d), _most_called(spark, d), "up").where("depth > 0")
    return reach.groupBy("start").agg(F.count("*").alias("n")).select(F.col("start").alias("id"), "n", traverse.risk(F.col("n")).alias("risk"))


def cohesion(spark, d):
    return traverse.cohesion(_nodes(spark, d), _calls(spark, d))


def call_components(spark, d):
    """Weakly connected components: component and size."""
    e = graph.pairs(_calls(spark, d))
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return traverse.components(spark, e, ends).groupBy("component").agg(F.count("*").alias("n"))


def concurrency_risks(spark, d):
    return graph.concurrency_risks(_calls(spark, d))


def dead_functions(spark, d):
    """Functions that nothing calls and that are no entries: anti join."""
    called = _calls(spark, d).select(F.col("dst").alias("id")).distinct()
    quiet = _nodes(spark, d).join(called, "id", "left_anti")
    return quiet.where(~F.coalesce(F.arrays_overlap("labels", F.array(F.lit("API_entry"), F.lit("thread_processor"), F.lit("constructor"), F.lit("callback_func"))), F.lit(False))).select("id", "name")


def duplicate_names(spark, d):
    """Names that functions of at least two domains have."""
    return _nodes(spark, d).where("name is not null").groupBy("name").agg(F.countDistinct("domain").alias("n_domains"), F.count("*").alias("n")).where("n_domains >= 2")


def relation_confidence(spark, d):
    """Counts over relation, confidence and both, as grouping sets."""
    e = graph.all_edges(table(spark, d, "edges"))
    return e.cube("relation", "confidence").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 6).alias("avg_score")).where("relation is not null or confidence is not null")


def keyword_search(spark, d):
    """Scored search: 3 for the name, 2 for the id, 1 each for file and domain; ties by degree."""
    words = ["lock", "flush"]
    has = lambda c, w, n: F.when(F.contains(F.lower(c), F.lit(w)), n).otherwise(0)
    score = sum((has("name", w, 3) + has("id", w, 2) + has("source_file", w, 1) + has("domain", w, 1) for w in words), F.lit(0))
    n = _nodes(spark, d).withColumn("score", score).where("score > 0")
    deg = graph.degree(_calls(spark, d), "src", "n_out").join(graph.degree(_calls(spark, d), "dst", "n_in"), "id", "full").select("id", (F.coalesce("n_out", F.lit(0)) + F.coalesce("n_in", F.lit(0))).alias("degree"))
    return n.join(deg, "id", "left").select("id", "score", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("score"), F.desc("degree"), "id").limit(TOP)


def resolve_best_candidate(spark, d):
    """Called keys that no function has, resolved by the name at their end: a function of the same name wins by shared
    first domain, then uniqueness. One candidate each, ambiguous ones by the least id."""
    nodes = _nodes(spark, d).where("name is not null and domain is not null").select("id", F.lower("name").alias("name"), F.split("domain", r"\.")[0].alias("root"))
    missing = graph.external_callees(_nodes(spark, d), _calls(spark, d)).select(F.col("id").alias("key"))
    tail = missing.withColumn("name", F.regexp_extract(F.lower("key"), r"_([a-z0-9]+_[a-z0-9]+_?[a-z0-9]*)$", 1)).where("name <> ''").withColumn("root", F.split("key", "_")[0])
    many = nodes.groupBy("name").agg(F.count("*").alias("n"))
    cand = tail.join(nodes.withColumnRenamed("root", "node_root"), "name").join(many, "name")
    conf = F.when(F.col("root") == F.col("node_root"), 0.75).when(F.col("n") == 1, 0.55).otherwise(0.30)
    ranked = graph.best_per_group(cand.withColumn("confidence", conf), ["key"], [F.desc("confidence"), F.asc("id")])
    return ranked.select("key", "id", "confidence")


# Cypher

CYPHER = {
    "cypher_rel_match": "MATCH (a)-[:LOCKS]->(b) RETURN a.id AS a_id, b.id AS b_id",
    "cypher_rel_reverse": "MATCH (a:API_entry)<-[:INVOKES]-(b:constructor) RETURN a.id AS a_id, b.id AS b_id",
    "cypher_node_where": "MATCH (n:API_entry) WHERE n.line_number > 100 AND NOT n.domain LIKE 'larkspur%' RETURN n.id AS id, n.line_number AS line",
    "cypher_group_having": "MATCH (n) RETURN n.domain AS domain, COUNT(*) AS n, AVG(n.line_number) AS avg_line, MAX(n.line_number) AS max_line GROUP BY n.domain HAVING n > 3",
    "cypher_order_nulls": "MATCH (n) RETURN n.id AS id, n.signature AS signature ORDER BY signature DESC LIMIT 25",
    "cypher_in_like_regex": "MATCH (n) WHERE n.name =~ '.*lock.*' OR 'dead_code' IN n.labels OR n.line_number IN [1, 5, 10] RETURN n.id AS id",
    "cypher_two_patterns": "MATCH (a)-[:LOCKS]->(b), (a)-[:ALLOCATES]->(c) RETURN a.id AS a_id, b.id AS b_id, c.id AS c_id",
    "cypher_varlen": "MATCH (a:constructor)-[:ALLOCATES*1..2]->(b) RETURN a.id AS a_id, b.id AS b_id",
    "cypher_aggregate_all": "MATCH (n:out_end) RETURN COUNT(*) AS n, SUM(n.line_number) AS total, MIN(n.line_number) AS least",
}


def _cypher(text):
    def run(spark: SparkSession, d: str) -> DataFrame:
        cols = ["id", "name", "domain", "source_file", "line_number", "signature", "labels"]
        return Cypher(spark, _nodes(spark, d).select(*cols), graph.all_edges(table(spark, d, "edges"))).run(text)

    return run


QUERIES = {
    f.__name__: f
    for f in (
        hub_functions, hub_targets, cross_domain_hotspots, domain_stats, external_callees, hub_scores, entry_scores, archetype_top5, callers, callees, neighbors_bfs, call_chain_down, call_chain_up, shortest_path, blast_radius,
        impact_two_hop, impact_closure_risk, cohesion, call_components, concurrency_risks, dead_functions, duplicate_names, relation_confidence, keyword_search, resolve_best_candidate,
    )
} | {name: _cypher(text) for name, text in CYPHER.items()}

_BASE = """
ranked as (select *, row_number() over (partition by id order by first_seen_version desc nulls last, last_seen_version desc nulls last, name desc nulls last, domain desc nulls last, source_file desc nulls last, line_number desc nulls last, signature desc nulls last) as rn from functions where id is not null),
nodes as (select id, name, domain, source_file, line_number, signature, labels from ranked where rn = 1),
e as (select distinct on (id) id, invoker_id as src, invoked_id as dst, relation, call_order, concurrency, confidence, confidence_score from edges where invoker_id is not null and invoked_id is not null),
calls as (select * from e where coalesce(relation, 'INVOKES') not in ('CONTAINS', 'IMPORTS')),
pairs as (select distinct src, dst from calls),
most_called as (select dst as id from calls join nodes n on n.id = dst group by 1 order by count(*) desc, 1 limit 1),
busiest as (select src as id from calls join nodes n on n.id = src group by 1 order by count(*) desc, 1 limit 1)
"""
_DEG = "dout as (select src as id, count(*) as n_out from calls group by 1), din as (select dst as id, count(*) as n_in from calls group by 1)"
_SCORE = f"""{_DEG}, scored as (
  select n.id, n.name, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out,
    round(coalesce(n_out, 0) / (coalesce(n_in, 0) + 1) * case when coalesce(list_contains(n.labels, 'API_entry'), false) then 2.0 else 1.0 end *
      case when regexp_matches(lower(name), '^(test|mock|stub|bench|spec)_') then 0.1 when regexp_matches(lower(name), '^(main|run|start|execute)$|^(handle|on|process|do|perform|dispatch)_') then 1.5
        when regexp_matches(lower(name), '^(get|set|is|has|check|validate)_') then 0.3 else 1.0 end, 3) as score
  from nodes n left join dout using (id) left join din using (id))"""


def _q(body: str, extra: str = "", recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{_BASE}{', ' + extra if extra else ''} {body}"


def _reach(start: str, frm: str, to: str, depth: int) -> str:
    return f"r as (select id, 0 as depth from {start} union select p.{to}, r.depth + 1 from r join pairs p on p.{frm} = r.id where r.depth < {depth})"


SQL = {
    "hub_functions": _q("select src as id, count(*) as n_calls from calls group by 1 order by 2 desc, 1 limit 20"),
    "hub_targets": _q("select dst as id, count(*) as n_calls from calls group by 1 order by 2 desc, 1 limit 20"),
    "cross_domain_hotspots": _q("select a.domain as src_domain, b.domain as dst_domain, count(*) as n from calls join nodes a on a.id = src join nodes b on b.id = dst where a.domain <> b.domain group by 1, 2 order by 3 desc, 1, 2 limit 20"),
    "domain_stats": _q("select n.domain, n.n_nodes, coalesce(i.n_edges, 0) as n_edges from (select domain, count(*) as n_nodes from nodes group by 1) n left join (select a.domain, count(*) as n_edges from calls join nodes a on a.id = src join nodes b on b.id = dst where a.domain = b.domain group by 1) i using (domain)"),
    "external_callees": _q("select dst as id, count(*) as n_calls from calls where dst not in (select id from nodes) group by 1"),
    "hub_scores": _q(
        "select id, n_in, n_out, round(raw / (select max(raw) from raw), 6) as score from raw",
        _DEG + ", xd as (select dst as id, count(distinct a.domain) as c from pairs join nodes a on a.id = src join nodes b on b.id = dst where a.domain <> b.domain group by 1), raw as (select n.id, n_in, n_out, n_in * n_out * (1 + 0.5 * coalesce(c, 0)) as raw from nodes n join dout using (id) join din using (id) left join xd using (id))",
    ),
    "call_components": _q(
        "select component, count(*) as n from (select id, min(other) as component from reach group by 1) group by 1",
        "links as (select src, dst from pairs union select dst, src from pairs), reach as (select src as id, src as other from links union select r.id, l.dst from reach r join links l on l.src = r.other)", True,
    ),
    "entry_scores": _q("select id, n_in, n_out, score from scored", _SCORE),
    "archetype_top5": _q(
        "select archetype, rank, id, score from (select *, row_number() over (partition by archetype order by score desc, id) as rank from k) where rank <= 5",
        _SCORE + ", k as (select id, score, case when regexp_matches(lower(name), 'init|open|start|mount|attach') then 'init' when regexp_matches(lower(name), 'read|write|flush|poll|fold|pack') then 'io' when regexp_matches(lower(name), 'close|stop|detach|retire|drain') then 'shutdown' when regexp_matches(lower(name), 'config|set|bind') then 'config' else 'other' end as archetype from scored)",
    ),
    "callers": _q("select src, name, domain, call_order, relation from calls join nodes n on n.id = src where dst in (select id from most_called)"),
    "callees": _q("select dst, name, domain, call_order, relation from calls join nodes n on n.id = dst where src in (select id from busiest)"),
    "neighbors_bfs": _q("select id, min(depth) as depth from r group by 1", "both_ways as (select src, dst from pairs union select dst, src from pairs), r as (select id, 0 as depth from busiest union select b.dst, r.depth + 1 from r join both_ways b on b.src = r.id where r.depth < 2)", True),
    "call_chain_down": _q("select id, depth from r", _reach("busiest", "src", "dst", 5), True),
    "call_chain_up": _q("select id, depth from r", _reach("most_called", "dst", "src", 5), True),
    "shortest_path": _q(
        "select m.id, m.depth, min(p.src) as parent from m left join pairs p on p.dst = m.id and p.src in (select id from m x where x.depth = m.depth - 1) group by 1, 2",
        _reach("busiest", "src", "dst", 30) + ", m as (select id, min(depth) as depth from r group by 1)", True,
    ),
    "blast_radius": _q(
        "select count(*) as n_affected, sum(case when depth = 1 then 1 else 0 end)::bigint as n_direct, sum(case when coalesce(list_contains(labels, 'API_entry'), false) then 1 else 0 end)::bigint as n_api, sum(case when regexp_matches(name, 'test|ut_|unit_|perf|verify') then 1 else 0 end)::bigint as n_tests, count(distinct domain) as n_domains from m join nodes using (id) where depth > 0",
        _reach("most_called", "dst", "src", 3) + ", m as (select id, min(depth) as depth from r group by 1)", True,
    ),
    "impact_two_hop": _q(
        "select id, 1 as rank, null::varchar as via from f where id not in (select id from most_called) union all select p.src, 2, min(p.dst) from pairs p join f on f.id = p.dst where p.src not in (select id from f) and p.src not in (select id from most_called) group by 1",
        "f as (select distinct src as id from pairs where dst in (select id from most_called))",
    ),
    "impact_closure_risk": _q("select (select id from most_called) as id, count(*) - 1 as n, case when count(*) - 1 > 50 then 'high' when count(*) - 1 > 10 then 'medium' when count(*) > 1 then 'low' else 'none' end as risk from r", "r as (select id from most_called union select p.src from r join pairs p on p.dst = r.id)", True),
    "cohesion": _q("select domain, n_inner, n_outer, round(n_inner / (n_inner + n_outer), 6) as cohesion from c", "c as (select a.domain, sum(case when a.domain = b.domain then 1 else 0 end)::bigint as n_inner, sum(case when a.domain <> b.domain then 1 else 0 end)::bigint as n_outer from calls join nodes a on a.id = src join nodes b on b.id = dst group by 1)"),
    "concurrency_risks": _q(
        "select s.src, s.dst, s.call_order, s.concurrency, s.later, case when s.later > 3 and s.concurrency <> 'callback' then 'HIGH' when s.later >= 1 then 'MEDIUM' else 'LOW' end as risk from (select g.*, (select count(*) from g h where h.src = g.src and h.call_order > g.call_order) as later from g where concurrency in ('thread_spawn', 'goroutine', 'spawn_target', 'callback')) s",
        "g as (select distinct src, dst, call_order, concurrency from calls where call_order is not null)",
    ),
    "dead_functions": _q("select id, name from nodes where id not in (select dst from calls) and not coalesce(list_has_any(labels, ['API_entry', 'thread_processor', 'constructor', 'callback_func']), false)"),
    "duplicate_names": _q("select name, count(distinct domain) as n_domains, count(*) as n from nodes where name is not null group by 1 having count(distinct domain) >= 2"),
    "relation_confidence": _q("select relation, confidence, count(*) as n, round(avg(confidence_score), 6) as avg_score from e group by cube (relation, confidence) having relation is not null or confidence is not null"),
    "keyword_search": _q(
        "select id, score, coalesce(n_out, 0) + coalesce(n_in, 0) as degree from s left join dout using (id) left join din using (id) where score > 0 order by score desc, degree desc, id limit 20",
        _DEG + ", s as (select id, " + " + ".join(f"case when contains(lower({c}), '{w}') then {k} else 0 end" for w in ("lock", "flush") for c, k in (("name", 3), ("id", 2), ("source_file", 1), ("domain", 1))) + " as score from nodes)",
    ),
    "resolve_best_candidate": _q(
        "select key, id, confidence from (select *, row_number() over (partition by key order by confidence desc, id) as rn from c) where rn = 1",
        """m as (select distinct dst as key from calls where dst not in (select id from nodes)),
        t as (select key, regexp_extract(lower(key), '_([a-z0-9]+_[a-z0-9]+_?[a-z0-9]*)$', 1) as name, split_part(key, '_', 1) as root from m),
        nn as (select id, lower(name) as name, split_part(domain, '.', 1) as root, count(*) over (partition by lower(name)) as n from nodes where name is not null and domain is not null),
        c as (select t.key, nn.id, case when t.root = nn.root then 0.75 when nn.n = 1 then 0.55 else 0.30 end::double as confidence from t join nn on nn.name = t.name where t.name <> '')""",
    ),
    "cypher_rel_match": _q("select distinct a.id as a_id, b.id as b_id from e join nodes a on a.id = src join nodes b on b.id = dst where coalesce(relation, 'INVOKES') = 'LOCKS'"),
    "cypher_rel_reverse": _q("select distinct b.id as a_id, a.id as b_id from e join nodes a on a.id = src join nodes b on b.id = dst where coalesce(relation, 'INVOKES') = 'INVOKES' and list_contains(b.labels, 'API_entry') and list_contains(a.labels, 'constructor')"),
    "cypher_node_where": _q("select id, line_number as line from nodes where list_contains(labels, 'API_entry') and line_number > 100 and not coalesce(domain like 'larkspur%', false)"),
    "cypher_group_having": _q("select domain, count(*) as n, coalesce(avg(line_number), 0)::double as avg_line, coalesce(max(line_number), 0)::double as max_line from nodes group by 1 having count(*) > 3"),
    "cypher_order_nulls": _q("select id, signature from nodes order by signature desc nulls first, id limit 25"),
    "cypher_in_like_regex": _q("select id from nodes where coalesce(regexp_matches(name, '^.*lock.*$'), false) or coalesce(list_contains(labels, 'dead_code'), false) or coalesce(line_number in (1, 5, 10), false)"),
    "cypher_two_patterns": _q("select distinct l.src as a_id, l.dst as b_id, c.dst as c_id from (select distinct src, dst from e where relation = 'LOCKS') l join (select distinct src, dst from e where relation = 'ALLOCATES') c using (src) join nodes x on x.id = l.src join nodes y on y.id = l.dst join nodes z on z.id = c.dst"),
    "cypher_varlen": _q(
        "select a.id as a_id, b.id as b_id from p join nodes a on a.id = p.s join nodes b on b.id = p.t where list_contains(a.labels, 'constructor')",
        "x as (select distinct src, dst from e where relation = 'ALLOCATES'), p as (select src as s, dst as t from x where src <> dst union all select a.src, b.dst from x a join x b on a.dst = b.src where a.src <> a.dst and b.dst <> a.src and b.dst <> a.dst)",
    ),
    "cypher_aggregate_all": _q("select count(*) as n, coalesce(sum(line_number), 0)::double as total, coalesce(min(line_number), 0)::double as least from nodes where list_contains(labels, 'out_end')"),
}
