"""Queries over accesses, versions, texts, facts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import infer, text
from weftgraph.operators import access, graph, versions
from weftgraph.sources.tables import table

# accesses: a line of an order is an access of the order (the function) to a part of a supplier (the field)


def _accesses(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("model")), "l_orderkey")
    return rows.select(
        F.col("l_orderkey").alias("fn"), F.concat_ws(":", "l_partkey", "l_suppkey").alias("res"), (F.col("l_returnflag") == "R").alias("is_write"),
        "model", F.col("l_linestatus").alias("lock"), F.col("l_linenumber").alias("line"),
    )


def _by_part(spark, d):
    return _accesses(spark, d).withColumn("res", F.split("res", ":")[0])


def field_access(spark, d):
    """Accesses by field's owner (the supplier) and kind."""
    rows = _accesses(spark, d).select(F.split("res", ":")[1].alias("struct"), "fn", F.when(F.col("is_write"), "write").otherwise("read").alias("access_type"), "res")
    return rows.groupBy("struct", "access_type").agg(F.count("*").alias("n"), F.countDistinct("res").alias("n_fields"))


def data_dep_counts(spark, d):
    return access.dependency_counts(access.reads_and_writes(_accesses(spark, d)))


def dead_writers(spark, d):
    return access.dead_writes(_accesses(spark, d))


def _longest_order(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("fn")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fn").limit(1).select("fn")


def forward_dep(spark, d):
    return access.forward_impact(_by_part(spark, d), _longest_order(spark, d))


def reverse_dep_uninit(spark, d):
    return access.uninitialized_reads(_accesses(spark, d), _longest_order(spark, d))


def races_pairwise(spark, d):
    return access.race_summary(access.accessors(_by_part(spark, d))).where("n_races > 0")


def race_partners(spark, d):
    return access.race_partners(access.accessors(_by_part(spark, d))).where("n_partners > 0").select("res", "fn", "n_partners")


# ordered events: a user's events in order; view takes a lock, click releases it, purchase is an access


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("props"))


def lock_regions(spark, d):
    """Purchases per user, inside and outside of a held lock."""
    e = F.col("event_type")
    rows = access.held_regions(_events(spark, d), "user_id", ["us", "event_id"], e == "view", e == "click").where(e == "purchase")
    return rows.groupBy("user_id").agg(F.sum(F.col("held").cast("bigint")).alias("n_protected"), F.sum((~F.col("held")).cast("bigint")).alias("n_unprotected"))


def alloc_free_balance(spark, d):
    e = F.col("event_type")
    return access.balance(_events(spark, d), "user_id", e == "view", e == "click")


def state_transitions(spark, d):
    """How often one event follows another in a user's events."""
    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    return _events(spark, d).withColumn("was", was).where("was is not null").groupBy(F.col("was").alias("from_state"), F.col("event_type").alias("to_state")).agg(F.count("*").alias("n"))


def happens_before_flags(spark, d):
    """Per user whether a view, an error and a purchase come in this order at all."""
    first = lambda t: F.min(F.when(F.col("event_type") == t, F.col("us")))
    last = lambda t: F.max(F.when(F.col("event_type") == t, F.col("us")))
    rows = _events(spark, d).groupBy("user_id").agg(first("view").alias("v"), last("purchase").alias("p"), first("error").alias("e"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("user_id", flag(F.col("v") < F.col("p")).alias("view_before_purchase"), flag(F.col("v") < F.col("e")).alias("view_before_error"), flag(F.col("e") < F.col("p")).alias("error_before_purchase"))


MINUTE = 60_000_000


def tumbling_events(spark, d):
    """Events by type in windows of an hour."""
    return _events(spark, d).groupBy(F.floor(F.col("us") / (60 * MINUTE)).alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding_breaker(spark, d):
    """For each minute with events whether the breaker is open: more than 12 events in it and the 59 minutes before."""
    per = _events(spark, d).groupBy(F.floor(F.col("us") / MINUTE).alias("minute")).agg(F.count("*").alias("n"))
    # an hour's window needs no more than this hour's and the last hour's minutes: hours are partitions, their borders joined
    spread = per.select("minute", "n", F.explode(F.array(F.floor(F.col("minute") / 60), F.floor(F.col("minute") / 60) + 1)).alias("hour"))
    w = Window.partitionBy("hour").orderBy("minute").rangeBetween(-59, 0)
    rows = spread.withColumn("load", F.sum("n").over(w)).where(F.floor(F.col("minute") / 60) == F.col("hour"))
    return rows.select("minute", "n", "load", (F.col("load") > 12).alias("open"))


def adaptive_window(spark, d):
    """The batch window of each minute in ms: 200 below a load of 0.3, 5000 above 0.8, linear between."""
    per = _events(spark, d).groupBy(F.floor(F.col("us") / MINUTE).alias("minute")).agg(F.count("*").alias("n"))
    load = F.col("n") / 5
    ms = F.when(load < 0.3, 200.0).when(load > 0.8, 5000.0).otherwise(200 + (load - 0.3) / 0.5 * 4800)
    return per.select("minute", "n", F.round(ms, 3).alias("window_ms"))


def debounce_sessions(spark, d):
    """Sessions of a user: events less than six hours apart."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    gap = (F.col("us") - F.lag("us").over(w)) > 360 * MINUTE
    rows = _events(spark, d).withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("length_us")).select("user_id", "session", "n", "length_us")


def dedup_pending(spark, d):
    """The pending set: users with an event in each quarter of an hour, once each, with their first event."""
    return _events(spark, d).groupBy(F.floor(F.col("us") / (15 * MINUTE)).alias("slot"), "user_id").agg(F.min("event_id").alias("first_event"))


def props_values(spark, d):
    """JSON properties of events, by key value."""
    return _events(spark, d).groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


# versions


def _versions(spark, d):
    """All versions, which are metadata; a store without any counts as one at version 0."""
    return sorted(r[0] for r in table(spark, d, "graph_versions").where("version_id is not null").select("version_id").collect()) or [0]


def time_travel(spark, d):
    """Functions alive at the middle version."""
    v = _versions(spark, d)
    return versions.alive_at(table(spark, d, "functions"), v[len(v) // 2], v[-1]).select("id", "name").distinct()


def alive_counts(spark, d):
    v = _versions(spark, d)
    return versions.alive_counts(table(spark, d, "functions"), v, v[-1])


def version_diff(spark, d):
    v = _versions(spark, d)
    return versions.version_diff(table(spark, d, "functions"), v[min(2, len(v) - 1)], v[max(-2, -len(v))])


def _snapshot(spark, d, version):
    rows = table(spark, d, "cgdb_nodes").where((F.col("version_id") == version) & F.col("fqn").isNotNull())
    cols = ["kind", "type_spelling", "signature", "attrs"]
    return rows.groupBy("fqn").agg(F.max(F.struct("loaded_at", *cols)).alias("r")).select("fqn", *[f"r.{c}" for c in cols])


def _ends(spark, d):
    v = sorted(r[0] for r in table(spark, d, "cgdb_nodes").where("version_id is not null").select("version_id").distinct().collect()) or [0]
    return v[0], v[-1]


def graph_diff(spark, d):
    """The first and the last snapshot by fqn: kind and signature."""
    a, b = _ends(spark, d)
    value = F.struct(F.coalesce("kind", F.lit("")), F.coalesce("signature", F.lit("")))
    return versions.keyed_diff(_snapshot(spark, d, a), _snapshot(spark, d, b), ["fqn"], value)


def graph_compare_names(spark, d):
    """Names of the first and the last snapshot: only in one, or with other signatures."""
    a, b = _ends(spark, d)
    of = lambda v: table(spark, d, "cgdb_nodes").where((F.col("version_id") == v) & F.col("name").isNotNull()).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("signature", F.lit("")))), "|").alias("s"))
    out = versions.keyed_diff(of(a), of(b), ["name"], F.col("s"))
    change = F.when(F.col("change") == "added", "only_in_target").when(F.col("change") == "removed", "only_in_source").otherwise("signature_changed")
    return out.select("name", change.alias("change"))


def merge_local_wins(spark, d):
    """The last snapshot merged over the first: counts by kind."""
    a, b = _ends(spark, d)
    return versions.merge_local_wins(_snapshot(spark, d, b), _snapshot(spark, d, a), "fqn").groupBy("kind").agg(F.count("*").alias("n"))


def prune_by_source(spark, d):
    """Functions left when files that were deleted last are pruned."""
    last = table(spark, d, "cgdb_files").where("id is not null").groupBy("id").agg(F.max(F.struct("scan_run", "delivery_id", "is_deleted", "path")).alias("r"))
    gone = last.where("r.is_deleted").select("r.path")
    return versions.prune_by_source(graph.function_nodes(table(spark, d, "functions")), gone, "source_file").groupBy("domain").agg(F.count("*").alias("n"))


def manifest_diff(spark, d):
    """Files by content between the states after the first and after the last run."""
    runs = sorted(r[0] for r in table(spark, d, "scan_runs").where("run_id is not null").select("run_id").collect()) or [0]

    def state(run):
        rows = table(spark, d, "cgdb_files").where((F.col("scan_run") <= run) & F.col("id").isNotNull())
        last = rows.groupBy("id").agg(F.max(F.struct("scan_run", "delivery_id", F.coalesce("is_deleted", F.lit(False)).alias("gone"), F.lower("sha256").alias("h"))).alias("r"))
        return last.where("not r.gone").select("id", F.coalesce("r.h", F.lit("")).alias("h"))

    return versions.keyed_diff(state(runs[0]), state(runs[-1]), ["id"], F.col("h"))


def node_history(spark, d):
    """Per fqn the snapshots that have it, and in how many its signature differs from the snapshot before."""
    rows = table(spark, d, "cgdb_nodes").where("fqn is not null and version_id is not null").groupBy("fqn", "version_id").agg(F.max(F.struct("loaded_at", F.coalesce("signature", F.lit("")).alias("s"))).alias("r"))
    was = F.lag("r.s").over(Window.partitionBy("fqn").orderBy("version_id"))
    rows = rows.withColumn("was", was)
    return rows.groupBy("fqn").agg(F.count("*").alias("n_versions"), F.min("version_id").alias("first_version"), F.max("version_id").alias("last_version"), F.sum((F.col("was") != F.col("r.s")).cast("bigint")).alias("n_changes")).na.fill(0, ["n_changes"])


def commit_first_touch(spark, d):
    """By the version that introduced them, how many fqn there are."""
    first = table(spark, d, "cgdb_nodes").where("fqn is not null and version_id is not null").groupBy("fqn").agg(F.min("version_id").alias("version_id"))
    return first.groupBy("version_id").agg(F.count("*").alias("n")).join(F.broadcast(table(spark, d, "graph_versions").select("version_id", "commit_hash")), "version_id", "left").select("version_id", "commit_hash", "n")


def audit_page(spark, d):
    """The second page of recorded edges, newest first."""
    rows = graph.all_edges(table(spark, d, "edges")).join(table(spark, d, "edges").select("id", F.unix_micros("recorded_at").alias("us")).dropDuplicates(["id"]), "id")
    return rows.where("relation = 'ALLOCATES'").select("id", "src", "dst", "us").orderBy(F.desc("us"), "id").offset(50).limit(50)


# files and nodes


def layer_counts(spark, d):
    """Snapshot rows by version, by layer and by both."""
    n = table(spark, d, "cgdb_nodes")
    sets = n.groupingSets([["version_id", "source_layer"], ["version_id"], ["source_layer"], []], "version_id", "source_layer")
    return sets.agg(F.count("*").alias("n"))


def coverage(spark, d):
    """Files and languages per repository."""
    f = table(spark, d, "cgdb_files").select(F.split("path", "/")[0].alias("subsystem"), "path", F.lower("language").alias("language"))
    return f.groupBy("subsystem").agg(F.countDistinct("path").alias("n_files"), F.countDistinct("language").alias("n_languages"))


def range_annotation(spark, d):
    """For each node with a byte range the smallest other range of its file and version that holds it."""
    n = table(spark, d, "cgdb_nodes").where("file_id is not null and fqn is not null and byte_start is not null and byte_end is not null")
    n = n.select("version_id", "file_id", F.col("fqn").alias("name"), "byte_start", "byte_end").distinct()
    return infer.annotate_ranges(n, ["version_id", "file_id"])


def abi_types(spark, d):
    t = table(spark, d, "cgdb_nodes")
    return t.groupBy(infer.abi_loss(F.col("type_spelling")).alias("abi")).agg(F.count("*").alias("n"))


def attrs_values(spark, d):
    """The JSON attributes of nodes: storage class and mean complexity."""
    v = F.try_parse_json("attrs")
    rows = table(spark, d, "cgdb_nodes").select(F.variant_get(v, "$.storage", "string").alias("storage"), F.variant_get(v, "$.complexity", "int").alias("complexity"))
    return rows.groupBy("storage").agg(F.count("*").alias("n"), F.round(F.avg("complexity"), 6).alias("avg_complexity"))


# facts from bodies


def _bodies(spark, d):
    return table(spark, d, "functions").where("body_text_compressed is not null").select("id", "domain", F.col("body_text_compressed").alias("body")).distinct()


def return_exprs(spark, d):
    rows = _bodies(spark, d).select(F.explode(infer.return_expressions(F.col("body"))).alias("expr"))
    return rows.groupBy("expr").agg(F.count("*").alias("n"), F.max(infer.null_like(F.col("expr"))).alias("null_like"))


def preconditions(spark, d):
    return _bodies(spark, d).select("id", F.explode(infer.guarded_names(F.col("body"))).alias("guard")).distinct()


def semantic_edges(spark, d):
    return infer.lock_edges(_bodies(spark, d)).groupBy("relation", "resource").agg(F.countDistinct("id").alias("n"))


def unbalanced_locks(spark, d):
    return infer.unbalanced_locks(infer.lock_edges(_bodies(spark, d)))


def doc_coverage(spark, d):
    flag = infer.documented(F.col("body"))
    return _bodies(spark, d).groupBy("domain").agg(F.count("*").alias("n"), F.round(100 * F.avg(flag.cast("double")), 2).alias("percent"))


def doc_return_mismatch(spark, d):
    return _bodies(spark, d).select("id", infer.return_mismatch(F.col("body")).alias("mismatch")).where("mismatch = 'documented_but_missing'").distinct()


def condition_liveness(spark, d):
    """Call conditions, and whether ctx->ready bound to nothing and such leave them alive."""
    e = table(spark, d, "edges").where("call_condition is not null")
    return e.groupBy("call_condition").agg(F.count("*").alias("n")).withColumn("alive", infer.condition_alive(F.col("call_condition"), {"CONFIG_DEBUG": "0", "CONFIG_SMP": ""}))


def config_macros(spark, d):
    e = table(spark, d, "edges").where("call_condition is not null").select("id", F.explode(infer.macros_of(F.col("call_condition"))).alias("macro"))
    return e.groupBy("macro").agg(F.countDistinct("id").alias("n"))


def dispatch_join(spark, d):
    """Calls through a table resolved to its implementations: caller -> table owner -> what OPS_BIND binds to it."""
    e = graph.all_edges(table(spark, d, "edges"))
    calls = e.where("concurrency = 'vtable_dispatch'").select("src", F.col("dst").alias("via")).distinct()
    binds = e.where("relation = 'OPS_BIND'").select(F.col("src").alias("via"), F.col("dst").alias("impl")).distinct()
    counted = calls.groupBy("via").agg(F.count("*").alias("n_callers")).join(binds.groupBy("via").agg(F.count("*").alias("n_impls")), "via")
    return counted.withColumn("n_edges", F.col("n_callers") * F.col("n_impls"))


# texts and vectors


def token_estimate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def inverted_index_search(spark, d):
    return text.all_terms(table(spark, d, "documents").where("text is not null"), "doc_id", "text", ["snapshot", "lock", "worker"])


def jaccard_names(spark, d):
    """Functions whose name is like a query: Jaccard similarity of the words, at least 0.3."""
    q = F.array(F.lit("flush"), F.lit("page"))
    rows = graph.function_nodes(table(spark, d, "functions")).where("name is not null").select("id", F.round(text.jaccard(text.name_parts(F.col("name")), q), 6).alias("score"))
    return rows.where("score >= 0.3")


def ngram_tfidf_topk(spark, d):
    return text.tfidf_search(graph.function_nodes(table(spark, d, "functions")).where("name is not null"), "id", "name", "flush dirty page")


def cosine_topk(spark, d):
    """The five vectors most like each vector whose id is divisible by 100."""
    v = table(spark, d, "embeddings")
    return text.cosine_topk(spark, v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)


def memory_weight(spark, d):
    docs = table(spark, d, "documents").where("created_at is not null and text is not null")
    now = docs.agg(F.max("created_at").alias("now"))  # one row
    days = F.datediff("now", "created_at")
    w = text.memory_weight(days, F.lit(0), F.length("text"), F.lit(0))
    return docs.crossJoin(F.broadcast(now)).select("doc_id", F.round(w, 6).alias("weight"))


def security_flags(spark, d):
    """String constants of sources with what they may be dangerous for."""
    rows = table(spark, d, "documents").where("file_id is not null and text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('"([^"\\\\\n]*)"'), 1)).alias("s"))
    return rows.select("doc_id", F.explode(infer.security_flags(F.col("s"))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def includes(spark, d):
    """Included files by how many sources include them."""
    rows = table(spark, d, "documents").where("file_id is not null and text is not null").select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r'(?m)^#include\s*[<"]([^>"\n]+)[>"]'), 1))).alias("target"))
    return rows.groupBy("target").agg(F.countDistinct("file_id").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        field_access, data_dep_counts, dead_writers, forward_dep, reverse_dep_uninit, races_pairwise, race_partners, lock_regions, alloc_free_balance, state_transitions, happens_before_flags, tumbling_events, sliding_breaker,
        adaptive_window, debounce_sessions, dedup_pending, props_values, time_travel, alive_counts, version_diff, graph_diff, graph_compare_names, merge_local_wins, prune_by_source, manifest_diff, node_history,
        commit_first_touch, audit_page, layer_counts, coverage, range_annotation, abi_types, attrs_values, return_exprs, preconditions, semantic_edges, unbalanced_locks, doc_coverage, doc_return_mismatch, condition_liveness,
        config_macros, dispatch_join, token_estimate, inverted_index_search, jaccard_names, ngram_tfidf_topk, cosine_topk, memory_weight, security_flags, includes,
    )
}

_A = """acc as (select l_orderkey as fn, l_partkey || ':' || l_suppkey as res, cast(l_partkey as varchar) as part, cast(l_suppkey as varchar) as struct, l_returnflag = 'R' as w, o_orderpriority as model, l_linestatus as lock from lineitem join orders on o_orderkey = l_orderkey),
long as (select l_orderkey as fn from lineitem group by 1 order by count(*) desc, 1 limit 1),
one as (select part as res, fn, bool_or(w) as w, max(model) as model, max(lock) as lock from acc group by 1, 2)"""
_E = "ev as (select *, epoch_us(ts) as us from events)"
_V = "vv as (select version_id as v, row_number() over (order by version_id) - 1 as k, count(*) over () as c from graph_versions)"
_N = """snap as (select * from (select *, row_number() over (partition by version_id, fqn order by loaded_at desc nulls last, kind desc nulls last, type_spelling desc nulls last, signature desc nulls last, attrs desc nulls last) as rn from cgdb_nodes where fqn is not null and version_id is not null) where rn = 1),
lo as (select * from snap where version_id = (select min(version_id) from cgdb_nodes)), hi as (select * from snap where version_id = (select max(version_id) from cgdb_nodes))"""
_B = "bodies as (select distinct id, domain, body_text_compressed as body from functions where body_text_compressed is not null)"
_NODES = "nodes as (select * from (select *, row_number() over (partition by id order by first_seen_version desc nulls last, last_seen_version desc nulls last, name desc nulls last, domain desc nulls last, source_file desc nulls last, line_number desc nulls last, signature desc nulls last) as rn from functions where id is not null) where rn = 1)"
_EDGES = "e as (select distinct on (id) id, invoker_id as src, invoked_id as dst, relation, concurrency, epoch_us(recorded_at) as us from edges where invoker_id is not null and invoked_id is not null)"

SQL = {
    "field_access": f"with {_A} select struct, case when w then 'write' else 'read' end as access_type, count(*) as n, count(distinct res) as n_fields from acc group by 1, 2",
    "data_dep_counts": f"with {_A}, rw as (select res, fn, bool_or(w) as w, bool_or(not w) as r from acc group by 1, 2) select res, count(*) filter (where w) as n_writers, count(*) filter (where r) as n_readers, (select count(*) from rw a join rw b on a.res = b.res and a.fn <> b.fn and a.w and b.r where a.res = x.res) as n_edges from rw x group by 1",
    "dead_writers": f"with {_A} select res, count(distinct fn) as n_writers from acc where w and res not in (select res from acc where not w) group by 1",
    "forward_dep": f"with {_A} select distinct part as res, fn from acc where not w and part in (select part from acc where w and fn in (select fn from long)) and fn not in (select fn from long)",
    "reverse_dep_uninit": f"with {_A} select distinct res from acc where not w and fn in (select fn from long) and res not in (select res from acc where w and fn not in (select fn from long))",
    "races_pairwise": f"with {_A} select a.res, (select count(*) from one o where o.res = a.res) as n_fns, (select count(*) from one o where o.res = a.res and w) as n_writers, count(*) as n_races from one a join one b on a.res = b.res and a.fn < b.fn and a.model <> b.model and a.lock <> b.lock and (a.w or b.w) group by 1",
    "race_partners": f"with {_A} select a.res, a.fn, count(*) as n_partners from one a join one b on a.res = b.res and a.fn <> b.fn and a.model <> b.model and a.lock <> b.lock and (a.w or b.w) group by 1, 2",
    "lock_regions": f"with {_E}, h as (select *, last_value(case event_type when 'view' then 1 when 'click' then 0 end ignore nulls) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) as held from ev) select user_id, count(*) filter (where coalesce(held, 0) = 1) as n_protected, count(*) filter (where coalesce(held, 0) = 0) as n_unprotected from h where event_type = 'purchase' group by 1",
    "alloc_free_balance": f"with {_E}, b as (select user_id, count(*) filter (where event_type = 'view') as n_acquire, count(*) filter (where event_type = 'click') as n_release from ev group by 1) select *, case when n_acquire > n_release then 'leak' when n_acquire < n_release then 'double_release' else 'balanced' end as bucket from b",
    "state_transitions": f"with {_E}, s as (select event_type as to_state, lag(event_type) over (partition by user_id order by us, event_id) as from_state from ev) select from_state, to_state, count(*) as n from s where from_state is not null group by 1, 2",
    "happens_before_flags": f"with {_E}, x as (select user_id, min(us) filter (where event_type = 'view') as v, max(us) filter (where event_type = 'purchase') as p, min(us) filter (where event_type = 'error') as e from ev group by 1) select user_id, coalesce(v < p, false) as view_before_purchase, coalesce(v < e, false) as view_before_error, coalesce(e < p, false) as error_before_purchase from x",
    "tumbling_events": f"with {_E} select us // 3600000000 as hour, event_type, count(*) as n, round(sum(value), 4) as total from ev group by 1, 2",
    "sliding_breaker": f"with {_E}, p as (select us // 60000000 as minute, count(*) as n from ev group by 1) select minute, n, l as load, l > 12 as open from (select *, (sum(n) over (order by minute range between 59 preceding and current row))::bigint as l from p)",
    "adaptive_window": f"with {_E}, p as (select us // 60000000 as minute, count(*) as n from ev group by 1) select minute, n, round(case when n / 5 < 0.3 then 200.0 when n / 5 > 0.8 then 5000.0 else 200 + (n / 5 - 0.3) / 0.5 * 4800 end, 3) as window_ms from p",
    "debounce_sessions": f"with {_E}, g as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) <= 21600000000 then 0 else 1 end as new from ev), s as (select *, (sum(new) over (partition by user_id order by us, event_id rows unbounded preceding))::bigint as session from g) select user_id, session, count(*) as n, max(us) - min(us) as length_us from s group by 1, 2",
    "dedup_pending": f"with {_E} select us // 900000000 as slot, user_id, min(event_id) as first_event from ev group by 1, 2",
    "props_values": "select cast(json_extract_string(props, '$.k') as int) as k, count(*) as n from events group by 1",
    "time_travel": f"with {_V} select distinct id, name from functions where first_seen_version <= (select v from vv where k = c // 2) and (last_seen_version > (select v from vv where k = c // 2) or last_seen_version = (select max(v) from vv))",
    "alive_counts": f"with {_V} select v as version, count(distinct id) as n from functions join vv on first_seen_version <= v and (last_seen_version > v or last_seen_version = (select max(v) from vv)) where id is not null group by 1",
    "version_diff": f"with {_V}, a as (select v from vv where k = 2), b as (select v from vv where k = c - 2) select distinct id, 'added' as change from functions where first_seen_version > (select v from a) and first_seen_version <= (select v from b) union select distinct id, 'removed' from functions where last_seen_version > (select v from a) and last_seen_version <= (select v from b)",
    "graph_diff": f"with {_N} select coalesce(lo.fqn, hi.fqn) as fqn, case when lo.fqn is null then 'added' when hi.fqn is null then 'removed' else 'changed' end as change from lo full outer join hi on lo.fqn = hi.fqn where lo.fqn is null or hi.fqn is null or coalesce(lo.kind, '') <> coalesce(hi.kind, '') or coalesce(lo.signature, '') <> coalesce(hi.signature, '')",
    "graph_compare_names": "with s as (select version_id, name, string_agg(distinct coalesce(signature, ''), '|' order by coalesce(signature, '')) as s from cgdb_nodes where name is not null group by 1, 2), lo as (select * from s where version_id = (select min(version_id) from cgdb_nodes)), hi as (select * from s where version_id = (select max(version_id) from cgdb_nodes)) select coalesce(lo.name, hi.name) as name, case when lo.name is null then 'only_in_target' when hi.name is null then 'only_in_source' else 'signature_changed' end as change from lo full outer join hi on lo.name = hi.name where lo.name is null or hi.name is null or lo.s <> hi.s",
    "merge_local_wins": f"with {_N} select kind, count(*) as n from (select fqn, kind from hi union all select fqn, kind from lo where fqn not in (select fqn from hi)) group by 1",
    "prune_by_source": f"with {_NODES}, gone as (select path from (select id, arg_max({{'d': is_deleted, 'p': path}}, (scan_run, delivery_id)) as r, any_value(path) as path from cgdb_files where id is not null group by 1) where r.d) select domain, count(*) as n from nodes where not exists (select 1 from gone where source_file = gone.path or source_file like '%/' || gone.path) or source_file is null group by 1",
    "manifest_diff": "with l as (select id, arg_max({'g': coalesce(is_deleted, false), 'h': coalesce(lower(sha256), '')}, (scan_run, delivery_id)) as r from cgdb_files where id is not null group by 1), f as (select id, arg_max({'g': coalesce(is_deleted, false), 'h': coalesce(lower(sha256), '')}, (scan_run, delivery_id)) as r from cgdb_files where id is not null and scan_run <= (select min(run_id) from scan_runs) group by 1), a as (select id, r.h as h from f where not r.g), b as (select id, r.h as h from l where not r.g) select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end as change from a full outer join b on a.id = b.id where a.id is null or b.id is null or a.h <> b.h",
    "node_history": "with s as (select fqn, version_id, arg_max(coalesce(signature, ''), (loaded_at, coalesce(signature, ''))) as s from cgdb_nodes where fqn is not null and version_id is not null group by 1, 2), l as (select *, lag(s) over (partition by fqn order by version_id) as was from s) select fqn, count(*) as n_versions, min(version_id) as first_version, max(version_id) as last_version, count(*) filter (where was <> s) as n_changes from l group by 1",
    "commit_first_touch": "with f as (select fqn, min(version_id) as version_id from cgdb_nodes where fqn is not null and version_id is not null group by 1) select f.version_id, v.commit_hash, count(*) as n from f left join graph_versions v using (version_id) group by 1, 2",
    "audit_page": f"with {_EDGES} select id, src, dst, us from e where relation = 'ALLOCATES' order by us desc, id limit 50 offset 50",
    "layer_counts": "select version_id, source_layer, count(*) as n from cgdb_nodes group by grouping sets ((version_id, source_layer), (version_id), (source_layer), ())",
    "coverage": "select split_part(path, '/', 1) as subsystem, count(distinct path) as n_files, count(distinct lower(language)) as n_languages from cgdb_files group by 1",
    "range_annotation": "with n as (select distinct version_id, file_id, fqn as name, byte_start, byte_end from cgdb_nodes where file_id is not null and fqn is not null and byte_start is not null and byte_end is not null), h as (select i.*, o.name as holder, row_number() over (partition by i.version_id, i.file_id, i.name, i.byte_start, i.byte_end order by o.byte_end - o.byte_start, o.name) as rn from n i join n o on i.version_id = o.version_id and i.file_id = o.file_id and i.name <> o.name and o.byte_start <= i.byte_start and o.byte_end >= i.byte_end) select version_id, file_id, name, byte_start, byte_end, holder from h where rn = 1",
    "abi_types": "with t as (select trim(regexp_replace(type_spelling, '\\b(const|volatile|struct|unsigned|signed)\\b', '', 'g')) as t from cgdb_nodes) select case when t is null or t = '' then 'unknown' when t like '%*' then 'pointer' when t in ('long') then 'lossy' when t in ('char', 'short', 'int', 'size_t', 'ssize_t', 'float', 'double') then 'portable' else 'unknown' end as abi, count(*) as n from t group by 1",
    "attrs_values": "select json_extract_string(attrs, '$.storage') as storage, count(*) as n, round(avg(cast(json_extract_string(attrs, '$.complexity') as int)), 6) as avg_complexity from cgdb_nodes group by 1",
    "return_exprs": f"with {_B}, r as (select trim(unnest(regexp_extract_all(body, '\\breturn\\b[ \\t]*([^;\\n{{}}]*)', 1)), ' ') as expr from bodies) select expr, count(*) as n, bool_or(regexp_matches(expr, '^(NULL|nullptr|None|nil|null|0|-\\d+|false|False)$')) as null_like from r group by 1",
    "preconditions": f"with {_B} select distinct id, unnest(regexp_extract_all(body, 'if\\s*\\(\\s*!?\\s*([\\w.>-]+)\\s*(?:==\\s*(?:NULL|nullptr|nil|null|None))?\\s*\\)\\s*\\{{?\\s*return', 1)) as guard from bodies",
    "semantic_edges": f"with {_B}, l as (select id, 'LOCKS' as relation, unnest(regexp_extract_all(body, '(\\w+)_lock\\(&?([\\w.>-]+)\\)', 2)) as r from bodies union all select id, 'UNLOCKS', unnest(regexp_extract_all(body, '(\\w+)_unlock\\(&?([\\w.>-]+)\\)', 2)) from bodies) select relation, 'resource::' || r as resource, count(distinct id) as n from l group by 1, 2",
    "unbalanced_locks": f"with {_B}, l as (select id, body, 'LOCKS' as relation, unnest(list_distinct(regexp_extract_all(body, '(\\w+)_lock\\(&?([\\w.>-]+)\\)', 2))) as r from bodies union all select id, body, 'UNLOCKS', unnest(list_distinct(regexp_extract_all(body, '(\\w+)_unlock\\(&?([\\w.>-]+)\\)', 2))) from bodies) select id, count(*) filter (where relation = 'LOCKS') as n_lock, count(*) filter (where relation = 'UNLOCKS') as n_unlock from l group by 1 having count(*) filter (where relation = 'LOCKS') <> count(*) filter (where relation = 'UNLOCKS')",
    "doc_coverage": f"with {_B} select domain, count(*) as n, round(100 * avg(case when regexp_matches(body, '(?s)^\\s*(?:/\\*|//|#[ #]|(?:async )?def [^\\n]*\\n\\s*r?(?:\"\"\"|\'\'\'\'\'\'))') then 1.0 else 0.0 end), 2) as percent from bodies group by 1",
    "doc_return_mismatch": f"with {_B} select distinct id, 'documented_but_missing' as mismatch from bodies where regexp_matches(body, '[@\\\\]returns?\\b|:returns?:') and not list_bool_or(list_transform(regexp_extract_all(body, '\\breturn\\b[ \\t]*([^;\\n{{}}]*)', 1), lambda x: trim(x, ' ') <> '')) is true",
    "condition_liveness": "select call_condition, count(*) as n, not regexp_matches(call_condition, '^\\s*#\\s*if\\s+0\\s*$') and not regexp_matches(call_condition, '^\\s*#\\s*ifndef\\s+CONFIG_DEBUG\\s*$') and not regexp_matches(call_condition, '^\\s*#\\s*ifdef\\s+CONFIG_SMP\\s*$') and regexp_extract(call_condition, '\\bCONFIG_DEBUG\\s*==\\s*(\\w+)', 1) in ('', '0') and regexp_extract(call_condition, '\\bCONFIG_DEBUG\\s*!=\\s*(\\w+)', 1) <> '0' as alive from edges where call_condition is not null group by 1",
    "config_macros": "select macro, count(distinct id) as n from (select id, unnest(regexp_extract_all(call_condition, '\\b([A-Z][A-Z0-9_]{2,})\\b', 1)) as macro from edges where call_condition is not null) group by 1",
    "dispatch_join": f"with {_EDGES}, c as (select distinct src, dst as via from e where concurrency = 'vtable_dispatch'), b as (select distinct src as via, dst as impl from e where relation = 'OPS_BIND') select via, count(distinct c.src) as n_callers, count(distinct impl) as n_impls, count(*) as n_edges from c join b using (via) group by 1",
    "inverted_index_search": "select doc_id from documents where len(list_intersect(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)), ['snapshot', 'lock', 'worker'])) = 3",
    "token_estimate": "with t as (select doc_id, length(text) as n, length(regexp_replace(text, '[^\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{ac00}-\\x{d7af}]', '', 'g')) as c from documents where text is not null) select doc_id, (n - c) // 4 + c // 2 + 1 as tokens from t",
    "jaccard_names": f"with {_NODES}, t as (select id, list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '([a-z0-9]+)', 1)) as w from nodes where name is not null), s as (select id, round(len(list_intersect(w, ['flush', 'page'])) / len(list_distinct(list_concat(w, ['flush', 'page']))), 6) as score from t) select id, score from s where score >= 0.3",
    "security_flags": """with s as (select doc_id, unnest(regexp_extract_all(text, '"([^"\\\\\n]*)"', 1)) as s from documents where file_id is not null and text is not null),
        f as (select doc_id, unnest([case when regexp_matches(s, '%[-+#0]*\\d*[a-zA-Z]') then 'format_string' end, case when regexp_matches(s, '(?i)\\b(?:select|insert|update|delete)\\b.*(?:%s|\\+|\\{\\w*\\})') then 'sql_injection_risk' end,
          case when regexp_matches(s, '(?i)\\b(?:sh -c|system|exec|popen)\\b|[;|&]\\s*rm\\s|\\$\\(') then 'shell_injection_risk' end, case when regexp_matches(s, '\\.\\./') then 'path_traversal_risk' end]) as flag from s)
        select flag, count(*) as n, count(distinct doc_id) as n_docs from f where flag is not null group by 1""",
    "ngram_tfidf_topk": f"""with {_NODES}, d as (select id, name as t from nodes where name is not null union all select null, 'flush dirty page'),
        w as (select id, unnest(list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '')) as w from d),
        g as (select id, g, count(*) as n from (select id, unnest(case when length(w) + 2 < 4 then ['$' || w || '$'] else list_transform(range(1, length(w) + 1), lambda i: substr('$' || w || '$', i, 3)) end) as g from w) group by 1, 2),
        t as (select *, sum(n) over (partition by id) as total from g), nn as (select count(*) as N from nodes where name is not null),
        idf as (select g, ln(((select N from nn) + 1) / (df + 1)) + 1 as idf from (select g, count(*) as df from g where id is not null group by 1 order by 2 desc, 1 limit 5000)),
        x as (select id, g, n / total * idf as w from t join idf using (g)), q as (select g, w as q from x where id is null),
        norm as (select id, sqrt(sum(w * w)) as nd from x where id is not null group by 1),
        dot as (select id, sum(w * q) as dot from x join q using (g) where id is not null group by 1)
        select id, round(dot / (nd * (select sqrt(sum(q * q)) from q)), 6) as score from dot join norm using (id) order by 2 desc, 1 limit 10""",
    "cosine_topk": "with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null), s as (select q.vec_id as query, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) as score from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id), r as (select *, row_number() over (partition by query order by score desc, vec_id) as rank from s) select query, vec_id, score, rank::int as rank from r where rank <= 5",
    "memory_weight": "select doc_id, round(least(10.0, exp(-0.05 * date_diff('day', created_at, (select max(created_at) from documents where text is not null))) * (1 + 0.05 * length(text) / 1000)), 6) as weight from documents where created_at is not null and text is not null",
    "includes": """select target, count(distinct file_id) as n from (select file_id, unnest(regexp_extract_all(text, '(?m)^#include\\s*[<"]([^>"\\n]+)[>"]', 1)) as target from documents where file_id is not null and text is not null) group by 1""",
}
