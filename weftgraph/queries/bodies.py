"""Queries on what function bodies do: accesses, locks, races, flows of parameters, and inferred edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import bodies, inference, paths
from weftgraph.sources.tables import table


def _functions(spark, d) -> DataFrame:
    model = F.get_json_object("extra_json", "$.thread_model")
    return table(spark, d, "functions").select("id", F.col("body_text_compressed").alias("body"), F.coalesce(model, F.lit("")).alias("model"))


def _accesses(spark, d) -> DataFrame:
    return bodies.covered_accesses(bodies.body_events(_functions(spark, d)))


def lock_coverage(spark, d):
    return bodies.lock_coverage(_accesses(spark, d))


def semantic_access_edges(spark, d):
    """READS and WRITES edges to resource nodes, by how many functions have them."""
    rows = _accesses(spark, d).select("fn", F.when(F.col("is_write"), "WRITES").otherwise("READS").alias("relation"), F.concat(F.lit("resource::"), "res").alias("resource"))
    return rows.groupBy("relation", "resource").agg(F.countDistinct("fn").alias("n"))


def race_classes(spark, d):
    return bodies.race_classes(_accesses(spark, d))


def race_members(spark, d):
    accesses = _accesses(spark, d)
    return bodies.race_members(accesses, bodies.race_classes(accesses))


def lock_order(spark, d):
    return bodies.lock_order(bodies.body_events(_functions(spark, d)))


def _named(spark, d) -> DataFrame:
    """C functions by repository and name."""
    f = table(spark, d, "functions").where(r"source_file rlike '\\.[ch]$' and name is not null and domain is not null")
    return f.select(F.concat_ws(":", F.split("domain", r"\.")[0], "name").alias("fn"), "signature", F.col("body_text_compressed").alias("body"), "labels", F.split("domain", r"\.")[0].alias("repo"))


def param_flow(spark, d):
    """Where the first parameters of API entries end up, through argument positions of calls in the same repository."""
    f = _named(spark, d)
    args = bodies.call_arguments(f.select("fn", "body")).withColumn("callee", F.concat_ws(":", F.split("fn", ":")[0], "callee"))
    params = bodies.parameters(f.select("fn", "signature"))
    start = params.where("pos = 0").join(f.where("array_contains(labels, 'API_entry')").select("fn").distinct(), "fn", "left_semi").select("fn", "name")
    return paths.param_flow(spark, args, params, start, 40).select("fn", "name")


def _nodes(spark, d) -> DataFrame:
    return table(spark, d, "functions").where("id is not null").select("id", "name", "domain", "source_file").distinct()


def infer_macro_bridges(spark, d):
    return inference.macro_bridges(_nodes(spark, d)).select("src", "dst").distinct()


def infer_conditional_parents(spark, d):
    return inference.conditional_parents(_nodes(spark, d)).select("src", "dst").distinct()


def infer_contains(spark, d):
    return inference.contains_edges(_nodes(spark, d)).select("src", "dst", "relation").distinct()


def resolved_callees(spark, d):
    """Calls read from bodies, resolved to functions: the best of file, domain and name."""
    f = table(spark, d, "functions").where("id is not null and body_text_compressed is not null")
    calls = f.select(F.col("id").alias("src"), F.col("source_file").alias("file"), "domain", F.explode(F.array_distinct(F.regexp_extract_all("body_text_compressed", F.lit(r"(\w+)\("), 1))).alias("callee")).distinct()
    nodes = _nodes(spark, d)
    imports = spark.createDataFrame([], "file string, name string, id string")
    return inference.resolve_callees(calls, nodes, imports)


QUERIES = {f.__name__: f for f in (lock_coverage, semantic_access_edges, race_classes, race_members, lock_order, param_flow, infer_macro_bridges, infer_conditional_parents, infer_contains, resolved_callees)}


def _s(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_EVENTS = f"""
f as (select distinct id, body_text_compressed as body, coalesce(json_extract_string(extra_json, '$.thread_model'), '') as model from functions where id is not null and body_text_compressed is not null),
lines as (select id, model, unnest(string_split(body, chr(10))) as t, generate_subscripts(string_split(body, chr(10)), 1) - 1 as line from f),
toks as (select id, model, line, unnest(regexp_extract_all(t, {_s(bodies.TOKEN)}, 0)) as token, generate_subscripts(regexp_extract_all(t, {_s(bodies.TOKEN)}, 0), 1) - 1 as pos from lines),
kinds as (
  select *, line::bigint * {bodies.LINE} + pos as seq, case when regexp_matches(token, {_s(bodies.RELEASE)}) then 'release' when regexp_matches(token, {_s(bodies.ACQUIRE)}) then 'acquire'
    when regexp_matches(token, {_s(bodies.WRITE)}) then 'write' else 'read' end as kind from toks),
ev as (
  select id, model, seq, kind, case when kind in ('acquire', 'release') then coalesce(nullif(regexp_extract(token, {_s(bodies.LOCK_ARGUMENT)}, 1), ''), regexp_extract(token, {_s(bodies.LOCK_OWNER)}, 1))
    else regexp_extract(token, {_s(bodies.FIELD)}, 1) end as name from kinds),
held as (select * from (select id, name as lock, seq as since, kind, lead(seq) over (partition by id, name order by seq) as until from ev where kind in ('acquire', 'release')) where kind = 'acquire'),
locks as (
  select a.id, a.seq, array_to_string(list_sort(list(distinct h.lock)), ',') as locks from ev a join held h on h.id = a.id and h.since < a.seq and (h.until is null or a.seq < h.until)
  where a.kind in ('read', 'write') group by 1, 2),
acc as (select a.id as fn, a.model, a.seq, a.name as res, a.kind = 'write' as is_write, coalesce(l.locks, '') as locks from ev a left join locks l on l.id = a.id and l.seq = a.seq where a.kind in ('read', 'write')),
one as (select distinct fn, res, is_write, model, locks from acc)
"""

_RACES = """
pr as (
  select a.res, a.is_write as a_writes, a.model as a_model, a.locks as a_locks, b.is_write as b_writes, b.model as b_model, b.locks as b_locks, a.fn as f, b.fn as g
  from one a join one b on a.res = b.res and a.fn <> b.fn and (a.is_write, a.model, a.locks) <= (b.is_write, b.model, b.locks)
  where (a.is_write or b.is_write) and not (a.model = b.model and a.model <> '')
    and (a.locks = '' or b.locks = '' or not list_has_any(string_split(a.locks, ','), string_split(b.locks, ',')))),
cl as (select res, is_write, model, locks, min(fn) as first_fn from one group by 1, 2, 3, 4)
"""

_HIT = "select res, a_writes, a_model, a_locks from pr union select res, b_writes, b_model, b_locks from pr"

SQL = {
    "lock_coverage": f"with {_EVENTS} select fn, res, is_write, locks <> '' as protected, count(*) as n from acc group by 1, 2, 3, 4",
    "semantic_access_edges": f"with {_EVENTS} select case when is_write then 'WRITES' else 'READS' end as relation, 'resource::' || res as resource, count(distinct fn) as n from acc group by 1, 2",
    "race_classes": f"""with {_EVENTS}, {_RACES}
        select p.res, a_writes, a_model, a_locks, b_writes, b_model, b_locks, min(x.first_fn) as a_fn, min(y.first_fn) as b_fn,
          count(*) // (case when (a_writes, a_model, a_locks) = (b_writes, b_model, b_locks) then 2 else 1 end) as n_pairs
        from pr p join cl x on (x.res, x.is_write, x.model, x.locks) = (p.res, a_writes, a_model, a_locks) join cl y on (y.res, y.is_write, y.model, y.locks) = (p.res, b_writes, b_model, b_locks)
        group by 1, 2, 3, 4, 5, 6, 7""",
    "race_members": f"with {_EVENTS}, {_RACES}, hit as ({_HIT}) select o.fn, o.res, o.is_write, o.model, o.locks from one o where (o.res, o.is_write, o.model, o.locks) in (select (res, a_writes, a_model, a_locks) from hit)",
    "lock_order": f"""with {_EVENTS}, r as (select name as lock, id, max((kind = 'acquire')::bigint) as a, max((kind = 'release')::bigint) as r from ev where kind in ('acquire', 'release') group by 1, 2)
        select lock, sum(r)::bigint as n_release, sum(a)::bigint as n_acquire, (sum(r) * sum(a) - sum(a * r))::bigint as n_edges from r group by 1""",
    "param_flow": rf"""with recursive
        f as (select string_split(domain, '.')[1] || ':' || name as fn, signature, body_text_compressed as body, labels from functions where regexp_matches(source_file, '\.[ch]$') and name is not null and domain is not null),
        calls as (select distinct fn, unnest(regexp_extract_all(body, {_s(bodies.CALL)}, 0)) as call from f where body is not null),
        parts as (select fn, string_split(fn, ':')[1] || ':' || regexp_extract(call, '^(\w+)', 1) as callee, string_split(regexp_extract(call, {_s(bodies.PARAMETERS)}, 1), ',') as vs from calls),
        args as (select distinct fn, callee, unnest(vs) as value, generate_subscripts(vs, 1) - 1 as pos from parts),
        words as (select distinct fn, callee, pos, unnest(regexp_extract_all(value, '[A-Za-z_]\w*', 0)) as name from args),
        ps as (select distinct fn, string_split(regexp_extract(signature, {_s(bodies.PARAMETERS)}, 1), ',') as vs from f where signature is not null),
        pu as (select fn, unnest(vs) as p, generate_subscripts(vs, 1) - 1 as pos from ps),
        params as (select distinct fn, pos, regexp_extract(p, {_s(bodies.LAST_WORD)}, 1) as name from pu where regexp_extract(p, {_s(bodies.LAST_WORD)}, 1) <> ''),
        flow as (
          select fn, name from params where pos = 0 and fn in (select fn from f where list_contains(labels, 'API_entry'))
          union select p.fn, p.name from flow w join words a on a.fn = w.fn and a.name = w.name join params p on p.fn = a.callee and p.pos = a.pos)
        select fn, name from flow""",
    "infer_macro_bridges": r"""
        with n as (select distinct id, lower(name) as name, string_split(domain, '.')[1] as root, source_file from functions where id is not null)
        select distinct a.id as src, b.id as dst from n a join n b on b.name = '__' || a.name and b.root = a.root
        where not starts_with(a.name, '__') and (coalesce(a.source_file, '') = '' or a.source_file like '%.h')""",
    "infer_conditional_parents": r"""
        with n as (select distinct id, regexp_extract(id, '^(.+)__cond_\d+(?:_else)?$', 1) as parent from functions where id is not null)
        select distinct p.id as src, n.id as dst from n join n p on p.id = n.parent where n.parent <> ''""",
    "infer_contains": "select distinct 'file:' || source_file as src, id as dst, 'CONTAINS' as relation from functions where id is not null and source_file is not null and source_file <> ''",
    "resolved_callees": r"""
        with n as (select distinct id, name as callee, source_file as f, domain as d from functions where id is not null),
        many as (select callee, count(distinct id) as n from n where callee is not null group by 1),
        calls as (select distinct id as src, source_file as file, domain, unnest(regexp_extract_all(body_text_compressed, '(\w+)\(', 1)) as callee from functions where id is not null and body_text_compressed is not null),
        c as (
          select src, c.callee, n.id as dst, case when file = n.f then 0.95 when domain = n.d and many.n = 1 then 0.75 when many.n = 1 then 0.55 when domain = n.d then 0.40 else 0.30 end as confidence
          from calls c join n on n.callee = c.callee join many on many.callee = c.callee)
        select src, callee, dst, confidence::double as confidence from (select *, row_number() over (partition by src, callee order by confidence desc, dst) as r from c) where r = 1""",
}
