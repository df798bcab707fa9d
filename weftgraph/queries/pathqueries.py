"""Queries over paths: a graph with cycles, from each user's events to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators import graph, inference, paths, traverse
from weftgraph.sources.tables import table


def _event_edges(spark, d):
    """Per user an edge from each kind of event to the one that follows: at most five nodes a user, with cycles."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = lambda c: F.concat_ws(":", "user_id", c)
    rows = table(spark, d, "events").select("user_id", "event_type", F.lead("event_type").over(w).alias("next")).where("next is not null")
    return rows.select(node("event_type").alias("src"), node("next").alias("dst")).distinct()


def _event_nodes(spark, d, kind):
    return table(spark, d, "events").where(F.col("event_type") == kind).select(F.concat_ws(":", "user_id", "event_type").alias("id")).distinct()


def varlen_1_3(spark: SparkSession, d: str) -> DataFrame:
    """Simple paths of one to three hops from every sign-up."""
    out = traverse.simple_paths(spark, _event_edges(spark, d), _event_nodes(spark, d, "signup"), 3)
    return out.select("start", "id", "hops", F.array_join("path", ">").alias("path"))


def path_between(spark, d):
    """Every simple path of at most four hops from a user's sign-up to a purchase."""
    return paths.path_between(spark, _event_edges(spark, d), _event_nodes(spark, d, "signup"), _event_nodes(spark, d, "purchase"), 4)


def reverse_trace(spark, d):
    """Paths of at most three hops that end at an error, with whether they begin at a sign-up."""
    return paths.reverse_trace(spark, _event_edges(spark, d), _event_nodes(spark, d, "error"), 3, _event_nodes(spark, d, "signup"))


def key_paths(spark, d):
    """The best path from each user's sign-up to an error, scored by length."""
    dom = F.pmod(F.split("id", ":")[0].cast("bigint"), F.lit(2))
    entries = _event_nodes(spark, d, "signup").select("id", F.lit(5.0).alias("score"), F.lit(0).alias("domain"))
    ends = _event_nodes(spark, d, "error").select("id", dom.cast("int").alias("domain"))
    return paths.key_paths(spark, _event_edges(spark, d), entries, ends, 4, 20)


def _start(spark, d):
    calls = graph.call_edges(table(spark, d, "edges"))
    nodes = graph.function_nodes(table(spark, d, "functions"))
    return graph.degree(calls, "src", "n").join(nodes.select("id"), "id").orderBy(F.desc("n"), "id").limit(1).select("id")


def resolve_chain(spark, d):
    """What the busiest function reaches over unconditional calls, within six hops."""
    e = graph.call_edges(table(spark, d, "edges"))
    return paths.resolve_chain(spark, e, _start(spark, d), F.col("call_condition").isNull(), 6)


def diff_chains(spark, d):
    """The chains with and without conditional calls: how many functions are in both or in one."""
    e = graph.call_edges(table(spark, d, "edges"))
    a = paths.resolve_chain(spark, e, _start(spark, d), F.lit(True), 2)
    b = paths.resolve_chain(spark, e, _start(spark, d), F.col("call_condition").isNull(), 2)
    return paths.diff_chains(a, b).groupBy("where").agg(F.count("*").alias("n"))


def reverse_trace_whole(spark, d):
    """Paths of any length that end at an error: five kinds of events give simple paths of at most four hops."""
    return paths.reverse_trace(spark, _event_edges(spark, d), _event_nodes(spark, d, "error"), 10, _event_nodes(spark, d, "signup"))


def resolve_chain_whole(spark, d):
    """What the busiest function reaches over unconditional calls, to the operator's depth of 20."""
    e = graph.call_edges(table(spark, d, "edges"))
    return paths.resolve_chain(spark, e, _start(spark, d), F.col("call_condition").isNull())


def diff_chains_whole(spark, d):
    """The chains with and without conditional calls to the operator's depth of 20: how many functions are in both or in one."""
    e = graph.call_edges(table(spark, d, "edges"))
    a = paths.resolve_chain(spark, e, _start(spark, d), F.lit(True))
    b = paths.resolve_chain(spark, e, _start(spark, d), F.col("call_condition").isNull())
    return paths.diff_chains(a, b).groupBy("where").agg(F.count("*").alias("n"))


def contains_edges(spark, d):
    e = inference.contains_edges(graph.function_nodes(table(spark, d, "functions")))
    return e.groupBy("src").agg(F.count("*").alias("n"))


def degree_labels(spark, d):
    rows = inference.degree_labels(graph.function_nodes(table(spark, d, "functions")), graph.all_edges(table(spark, d, "edges")))
    return rows.groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count("*").alias("n"))


def affinity_pairs(spark, d):
    """Pairs of domains by calls over the root of their sizes; only pairs that call each other at all come up."""
    nodes = graph.function_nodes(table(spark, d, "functions")).where("domain is not null")
    size = nodes.groupBy("domain").agg(F.count("*").alias("size"))
    h = graph.hotspots(nodes, graph.call_edges(table(spark, d, "edges")))
    pair = h.groupBy(F.least("src_domain", "dst_domain").alias("a"), F.greatest("src_domain", "dst_domain").alias("b")).agg(F.sum("n").alias("n"))
    rows = pair.join(size.select(F.col("domain").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("domain").alias("b"), F.col("size").alias("sb")), "b")
    return rows.select("a", "b", "n", F.round(F.col("n") / F.sqrt(F.col("sa") * F.col("sb")), 6).alias("affinity")).where("affinity >= 0.1")


QUERIES = {f.__name__: f for f in (varlen_1_3, path_between, reverse_trace, reverse_trace_whole, key_paths, resolve_chain, resolve_chain_whole, diff_chains, diff_chains_whole, contains_edges, degree_labels, affinity_pairs)}

_EV = "n as (select user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as nx from events), e as (select distinct user_id || ':' || event_type as src, user_id || ':' || nx as dst from n where nx is not null)"


def _walk(start: str, hops: int, frm: str = "src", to: str = "dst") -> str:
    return f"p as (select distinct user_id || ':' || event_type as start, user_id || ':' || event_type as id, [user_id || ':' || event_type] as path, 0 as hops from events where event_type = '{start}' union all select p.start, e.{to}, list_append(p.path, e.{to}), p.hops + 1 from p join e on e.{frm} = p.id where not list_contains(p.path, e.{to}) and p.hops < {hops})"


_F = """ranked as (select *, row_number() over (partition by id order by first_seen_version desc nulls last, last_seen_version desc nulls last, name desc nulls last, domain desc nulls last, source_file desc nulls last, line_number desc nulls last, signature desc nulls last) as rn from functions where id is not null),
nodes as (select * from ranked where rn = 1),
ed as (select distinct on (id) id, invoker_id as src, invoked_id as dst, relation, call_condition from edges where invoker_id is not null and invoked_id is not null),
calls as (select * from ed where coalesce(relation, 'INVOKES') not in ('CONTAINS', 'IMPORTS')),
busiest as (select src as id from calls join nodes n on n.id = src group by 1 order by count(*) desc, 1 limit 1)"""

SQL = {
    "varlen_1_3": f"with recursive {_EV}, {_walk('signup', 3)} select start, id, hops, array_to_string(path, '>') as path from p where hops > 0",
    "path_between": f"with recursive {_EV}, {_walk('signup', 4)} select start, id, hops, array_to_string(path, '>') as path from p where hops > 0 and id like '%:purchase'",
    "reverse_trace": f"with recursive {_EV}, {_walk('error', 3, 'dst', 'src')} select array_to_string(list_reverse(path), '>') as path, hops, id like '%:signup' as entry from p where hops > 0",
    "key_paths": f"with recursive {_EV}, {_walk('signup', 4)}, v as (select start, id, hops, array_to_string(path, '>') as path, round(5.0 * hops * case when cast(split_part(id, ':', 1) as bigint) % 2 <> 0 then 1.3 else 1.0 end, 6)::double as value from p where hops > 0 and id like '%:error'), a as (select *, row_number() over (partition by start order by value desc, path) as r from v), b as (select *, row_number() over (partition by id order by value desc, path) as q from a where r = 1) select start, id, hops, path, value from b where q = 1 order by value desc, path limit 20",
    "resolve_chain": f"with recursive {_F}, l as (select distinct src, dst from calls where call_condition is null), r as (select id, 0 as depth from busiest union select l.dst, r.depth + 1 from r join l on l.src = r.id where r.depth < 6) select id, min(depth) as depth from r group by 1",
    "diff_chains": f"with recursive {_F}, l as (select distinct src, dst from calls where call_condition is null), c as (select distinct src, dst from calls), r as (select id, 0 as depth from busiest union select l.dst, r.depth + 1 from r join l on l.src = r.id where r.depth < 2), s as (select id, 0 as depth from busiest union select c.dst, s.depth + 1 from s join c on c.src = s.id where s.depth < 2), x as (select id, bool_or(k = 1) as a, bool_or(k = 2) as b from (select id, 1 as k from s union all select id, 2 from r) group by 1) select case when a and b then 'both' when a then 'only_a' else 'only_b' end as \"where\", count(*) as n from x group by 1",
    "contains_edges": f"with {_F} select 'file:' || source_file as src, count(*) as n from nodes where source_file is not null and source_file <> '' group by 1",
    "degree_labels": f"with {_F}, x as (select n.id, id not in (select dst from calls) as i, id not in (select src from calls) as o, coalesce(source_file, '') <> '' as own from nodes n) select array_to_string(list_filter([case when i then 'in_end' end, case when o and not own then 'out_end' end, case when o and own then 'leaf_func' end], lambda v: v is not null), ',') as labels, count(*) as n from x group by 1",
    "affinity_pairs": f"with {_F}, z as (select domain, count(*) as size from nodes where domain is not null group by 1), c as (select least(a.domain, b.domain) as a, greatest(a.domain, b.domain) as b, count(*) as n from calls join nodes a on a.id = src join nodes b on b.id = dst where a.domain <> b.domain group by 1, 2) select * from (select c.a, c.b, n, round(n / sqrt(x.size * y.size), 6) as affinity from c join z x on x.domain = c.a join z y on y.domain = c.b) where affinity >= 0.1",
}
