"""Queries on references, snapshots, skew and increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import incremental, orphans, skew, snapshots
from weftgraph.sources.tables import table
from weftgraph.workspace import Workspace

EDGE_REFS = ["edges.invoker_id", "edges.invoked_id"]
NODE_REF = "cgdb_nodes.file_id"
#: A key with at least this share of all rows in its column dominates.
DOMINATING = 0.02


def _edge_refs(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(*[F.struct(F.lit(r).alias("ref"), F.col(r.split(".")[1]).alias("key")) for r in EDGE_REFS])).alias("end")
    return edges.select("id", "version_id", ends).select("end.ref", "end.key", F.col("version_id").alias("version"), F.col("id").alias("row_id"))


def _node_refs(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.lit(NODE_REF).alias("ref"), F.col("file_id").cast("string").alias("key"), F.col("version_id").alias("version"), F.col("id").alias("row_id"))


def _orphans(spark: SparkSession, d: str) -> list[tuple[DataFrame, list[int], DataFrame]]:
    """Deltas, the order of epochs and reference rows, of edges and of nodes."""
    work = Workspace(spark, "orphans")
    edge_refs, node_refs = _edge_refs(table(spark, d, "edges")), _node_refs(table(spark, d, "cgdb_nodes"))
    # versions and runs are metadata, a handful of rows at any size of the graph
    last = table(spark, d, "graph_versions").agg(F.max("version_id")).first()[0]
    spans = orphans.span_events(table(spark, d, "functions"), EDGE_REFS, last if last is not None else -1)
    made = {r["version_id"]: r["run"] for r in table(spark, d, "scan_runs").where("version_id is not null").groupBy("version_id").agg(F.max("run_id").alias("run")).collect()}
    versions = orphans.epochs_of(table(spark, d, "cgdb_nodes"), "version_id")
    of_run = sorted((made[v], v) for v in versions if v in made)
    ends = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(v).alias("v")) for r, v in of_run]) if of_run else None
    at = F.try_element_at(F.filter(ends, lambda e: e["run"] >= F.col("scan_run")), F.lit(1))["v"] if of_run else F.lit(None).cast("int")
    records = orphans.record_events(table(spark, d, "cgdb_files"), [NODE_REF], at)
    # a version that no run produced has no records behind it: its epoch comes before all others
    order = [v for v in versions if v not in made] + [v for _, v in of_run]
    epochs = orphans.epochs_of(table(spark, d, "edges"), "version_id")
    one = orphans.track(orphans.OrphanTracker(spark, Workspace(spark, "", work.at("functions"))), epochs, orphans.counted_refs(edge_refs), spans)
    two = orphans.track_in_order(orphans.OrphanTracker(spark, Workspace(spark, "", work.at("files"))), order, orphans.counted_refs(node_refs), records)
    return [(one, epochs, edge_refs), (two, order, node_refs)]


def _reference(column: str = "ref") -> list:
    part = F.split(column, r"\.")
    return [part[0].alias("table_name"), part[1].alias("column_name")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    (one, _, edge_refs), (two, _, node_refs) = _orphans(spark, d)
    found = orphans.orphan_rows(one, edge_refs).unionByName(orphans.orphan_rows(two, node_refs))
    return found.select(*_reference(), "row_id", F.col("version").alias("version_id"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per referencing column and version, a snapshot at the end of each epoch."""
    (one, first, _), (two, second, _) = _orphans(spark, d)
    counts = orphans.orphan_counts(one, first).unionByName(orphans.orphan_counts(two, second))
    return counts.select(*_reference(), F.col("version").alias("version_id"), "opened", "resolved", "reopened", "pending")


def _node_hash():
    return snapshots.fingerprint([F.col("kind"), F.col("type_spelling"), F.col("signature"), snapshots.json_value("attrs")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(spark, Workspace(spark, "snapshots"), table(spark, d, "cgdb_nodes"), "version_id", "fqn", "loaded_at", _node_hash())


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each change with the values before and after it."""
    nodes = table(spark, d, "cgdb_nodes").withColumn("hash", _node_hash())
    changes = p2_found(spark, d)
    values = ["hash", "kind", "type_spelling", "signature", "attrs"]
    out = snapshots.changed_values(changes, nodes, "version_id", "fqn", "loaded_at", values)
    return out.select("version_id", "fqn", "change", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in values[1:]])


def _edge_keys(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("func_id")) for c in ("invoker_id", "invoked_id")])).alias("end")
    return edges.select("relation", ends).select("end.column_name", "end.func_id", "relation")


def p3_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _edge_keys(table(spark, d, "edges"))
    out = skew.chunked_counts(spark, Workspace(spark, "skew"), rows, ["column_name", "func_id", "relation"])
    return out.where("func_id is not null").select("column_name", "func_id", "relation", F.col("rows").alias("n_edges"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    work = Workspace(spark, "skew")
    rows = _edge_keys(table(spark, d, "edges"))
    counts = skew.chunked_counts(spark, work, rows, ["column_name", "func_id", "relation"])
    counts = work.save(counts.groupBy("column_name", "func_id").agg(F.sum("rows").alias("rows")), "counts")
    totals = counts.groupBy("column_name").agg(F.sum("rows").alias("total"))  # two rows
    hit = counts.join(F.broadcast(totals), "column_name").where(F.col("func_id").isNotNull() & (F.col("rows") >= DOMINATING * F.col("total")))
    return hit.select("column_name", "func_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    runs = [r[0] for r in table(spark, d, "scan_runs").where("status = 'ok' and run_id is not null").select("run_id").distinct().collect()]
    feed = incremental.ChangeFeed(spark, Workspace(spark, "changes"))  # a lasting path would go on where the last call ended
    return feed.run(table(spark, d, "cgdb_files"), runs).select("run_id", "file_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_changes, p3_found, p3_edge_counts, p6_found)}

_ALIVE = """
alive as (select f.id, f.first_seen_version as a, f.last_seen_version as b, (select max(version_id) from graph_versions) as m from functions f),
refs as (
  select 'invoker_id' as column_name, id as row_id, version_id, invoker_id as key from edges where invoker_id is not null and version_id is not null
  union all select 'invoked_id', id, version_id, invoked_id from edges where invoked_id is not null and version_id is not null),
edge_orphans as (
  select distinct 'edges' as table_name, column_name, row_id, version_id from refs r
  where not exists (select 1 from alive x where x.id = r.key and x.a <= r.version_id and (x.b > r.version_id or x.b = x.m))),
made as (select version_id, max(run_id) as run from scan_runs where version_id is not null group by 1),
node_keys as (select distinct n.file_id, n.version_id, m.run from cgdb_nodes n left join made m using (version_id) where n.file_id is not null and n.version_id is not null),
node_last as (
  select k.file_id, k.version_id, arg_max(coalesce(f.is_deleted, false), (f.scan_run, f.delivery_id)) as gone
  from node_keys k join cgdb_files f on f.id = k.file_id and f.scan_run <= k.run group by 1, 2),
node_orphans as (
  select distinct 'cgdb_nodes' as table_name, 'file_id' as column_name, n.id as row_id, n.version_id
  from cgdb_nodes n left join node_last l using (file_id, version_id)
  where n.file_id is not null and n.version_id is not null and coalesce(l.gone, true)),
orphan_rows as (select * from edge_orphans union all select * from node_orphans)
"""

_CHANGES = """
norm as (
  select version_id, fqn, loaded_at, coalesce(kind, '') as kind, coalesce(type_spelling, '') as type_spelling, coalesce(signature, '') as signature,
    (select list_sort(list({'k': k, 'v': cast(json_extract(attrs, '$."' || k || '"') as varchar)})) from unnest(json_keys(attrs)) u(k)) as attrs,
    row_number() over (partition by version_id, fqn order by loaded_at desc nulls last) as rn
  from cgdb_nodes where fqn is not null and version_id is not null),
cur as (select norm.*, v.r from norm join (select version_id, row_number() over (order by version_id) as r from (select distinct version_id from cgdb_nodes where version_id is not null)) v using (version_id) where rn = 1),
vs as (select distinct r, version_id from cur),
pairs as (
  select coalesce(b.r, a.r + 1) as r, coalesce(a.fqn, b.fqn) as fqn, a.fqn is null as is_new, b.fqn is null as is_gone,
    a.kind is distinct from b.kind or a.type_spelling is distinct from b.type_spelling or a.signature is distinct from b.signature
      or replace(cast(a.attrs as varchar), ' ', '') is distinct from replace(cast(b.attrs as varchar), ' ', '') as differs
  from cur a full outer join cur b on a.fqn = b.fqn and b.r = a.r + 1)
"""

_COUNTS = """
ends as (select version_id as v, row_number() over (order by version_id) as pos from (select distinct version_id from edges where version_id is not null)),
live as (
  select e.pos, f.id, max(case when f.first_seen_version <= e.v and (f.last_seen_version > e.v or f.last_seen_version = (select max(version_id) from graph_versions)) then 1 else 0 end) as on_
  from ends e cross join functions f where f.id is not null and f.first_seen_version is not null and f.last_seen_version is not null group by 1, 2),
edge_seen as (
  select 'edges' as t, r.column_name as c, r.key, e.pos, count(distinct case when r2.pos = e.pos then r.row_id end) as n, count(distinct case when r2.pos < e.pos then (r2.pos, r.row_id) end) as seen
  from refs r join ends r2 on r2.v = r.version_id join ends e on e.pos >= r2.pos group by 1, 2, 3, 4),
edge_all as (
  select s.t, s.c, e.v, s.pos, s.n, s.seen, coalesce(a.on_, 0) as on_, coalesce(b.on_, 0) as was
  from edge_seen s join ends e using (pos) left join live a on a.pos = s.pos and a.id = s.key left join live b on b.pos = s.pos - 1 and b.id = s.key),
made_v as (select version_id, max(run_id) as run from scan_runs where version_id is not null group by 1),
node_ends as (
  select n.version_id as v, m.run, row_number() over (order by m.run nulls first, n.version_id) as pos
  from (select distinct version_id from cgdb_nodes where version_id is not null) n left join made_v m using (version_id)),
node_seen as (
  select r.file_id as key, e.pos, count(distinct case when r2.pos = e.pos then r.id end) as n, count(distinct case when r2.pos < e.pos then (r2.pos, r.id) end) as seen
  from cgdb_nodes r join node_ends r2 on r2.v = r.version_id join node_ends e on e.pos >= r2.pos where r.file_id is not null group by 1, 2),
node_live as (
  select e.pos, f.id, 1 - max(case when f.is_deleted then 1 else 0 end) as on_ from node_ends e join cgdb_files f on f.scan_run <= e.run
  where (f.scan_run, f.delivery_id) = (select max((g.scan_run, g.delivery_id)) from cgdb_files g where g.id = f.id and g.scan_run <= e.run) group by 1, 2),
node_all as (
  select 'cgdb_nodes' as t, 'file_id' as c, e.v, s.pos, s.n, s.seen, coalesce(a.on_, 0) as on_, coalesce(b.on_, 0) as was
  from node_seen s join node_ends e using (pos) left join node_live a on a.pos = s.pos and a.id = s.key left join node_live b on b.pos = s.pos - 1 and b.id = s.key),
all_keys as (select * from edge_all union all select * from node_all)
"""

SQL = {
    "p1_counts": f"""with {_ALIVE}, {_COUNTS}
        select t as table_name, c as column_name, v as version_id, sum(case when on_ = 0 then n else 0 end) as opened, sum(case when was = 0 and on_ = 1 then seen else 0 end) as resolved,
          sum(case when was = 1 and on_ = 0 then seen else 0 end) as reopened, sum(case when on_ = 0 then n + seen else 0 end) as pending
        from all_keys group by 1, 2, 3""",
    "p1_found": f"with {_ALIVE} select table_name, column_name, row_id, version_id from orphan_rows",
    "p2_found": f"""with {_CHANGES}
        select vs.version_id, p.fqn, case when is_new then 'added' when is_gone then 'removed' else 'changed' end as change
        from pairs p join vs on vs.r = p.r where p.r > 1 and (is_new or is_gone or differs)""",
    "p2_changes": f"""with {_CHANGES},
        raw as (select version_id, fqn, kind, type_spelling, signature, attrs, row_number() over (partition by version_id, fqn order by loaded_at desc nulls last) as rn from cgdb_nodes where fqn is not null and version_id is not null)
        select n.version_id, p.fqn, case when is_new then 'added' when is_gone then 'removed' else 'changed' end as change,
          a.kind as old_kind, a.type_spelling as old_type_spelling, a.signature as old_signature, a.attrs as old_attrs, b.kind as new_kind, b.type_spelling as new_type_spelling, b.signature as new_signature, b.attrs as new_attrs
        from pairs p join vs n on n.r = p.r join vs o on o.r = p.r - 1
        left join raw a on a.fqn = p.fqn and a.version_id = o.version_id and a.rn = 1 left join raw b on b.fqn = p.fqn and b.version_id = n.version_id and b.rn = 1
        where p.r > 1 and (is_new or is_gone or differs)""",
    "p3_found": """
        with k as (select 'invoker_id' as column_name, invoker_id as func_id from edges union all select 'invoked_id', invoked_id from edges)
        select column_name, func_id from k where func_id is not null group by 1, 2 having count(*) >= 0.02 * (select count(*) from edges)""",
    "p3_edge_counts": """
        with k as (select 'invoker_id' as column_name, invoker_id as func_id, relation from edges union all select 'invoked_id', invoked_id, relation from edges)
        select column_name, func_id, relation, count(*) as n_edges from k where func_id is not null group by 1, 2, 3""",
    "p6_found": """
        with ok as (select distinct run_id as r from scan_runs where status = 'ok'),
        pr as (select r, lag(r) over (order by r) as p from ok),
        f as (select id, scan_run, delivery_id, coalesce(is_deleted, false) as gone, coalesce(lower(nullif(content_hash, '')), lower(nullif(sha256, ''))) as content from cgdb_files where id is not null and scan_run is not null),
        now as (select pr.r, f.id, arg_max({'g': f.gone, 'c': f.content}, (f.scan_run, f.delivery_id)) as v from pr join f on f.scan_run <= pr.r and (pr.p is null or f.scan_run > pr.p) group by 1, 2),
        was as (select pr.r, f.id, arg_max({'g': f.gone, 'c': f.content}, (f.scan_run, f.delivery_id)) as v from pr join f on f.scan_run <= pr.p group by 1, 2)
        select now.r as run_id, now.id as file_id from now left join was on was.r = now.r and was.id = now.id
        where not now.v.g and (was.id is null or was.v.g or was.v.c is distinct from now.v.c)""",
}
