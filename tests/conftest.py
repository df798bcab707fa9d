from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCHEMAS = {
    "graph_versions": "version_id int, commit_hash string, commit_short string, commit_subject string, compiled_at timestamp, parent_version_id int, diff_summary string",
    "scan_runs": "run_id int, version_id int, status string, started_at timestamp, finished_at timestamp",
    "cgdb_files": "delivery_id bigint, scan_run int, id bigint, path string, is_system boolean, language string, sha256 string, line_count int, byte_count bigint, commit_hash string, last_modified timestamp, content_hash string, is_deleted boolean, delivered_at timestamp",
    "cgdb_nodes": "version_id int, id bigint, kind string, name string, fqn string, file_id bigint, line int, col int, byte_start int, byte_end int, type_spelling string, signature string, attrs string, source_layer string, confidence double, first_seen_version int, last_seen_version int, commit_hash string, legacy_function_id string, loaded_at timestamp",
    "functions": "id string, name string, domain string, source_file string, line_number int, signature string, labels array<string>, body_text_compressed string, extra_json string, first_seen_version int, last_seen_version int",
    "edges": "id bigint, invoker_id string, invoked_id string, relation string, call_order int, call_condition string, concurrency string, confidence string, confidence_score double, source string, vtable_type string, version_id int, recorded_at timestamp",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, repo string, file_id bigint, created_at timestamp",
    "toxicity_labels": "doc_id bigint, annotator string, toxic int, labelled_at timestamp",
    "pack_plans": "plan_id int, plan_name string, capacity_tokens int, doc_source string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}

#: Extra columns whose names the operators use inside.
CLASHING = ["ref", "key", "alive", "n", "hash", "part", "salt", "content", "deleted", "rows", "chunk", "start", "label", "tokens", "piece", "folder", "errors", "description", "ids", "toxic_", "version", "path_", "change"]


@pytest.fixture(scope="session")
def spark():
    from weftgraph.session import local_session

    return local_session(4, 4, "4g")


@pytest.fixture(scope="session")
def testdata():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def empty_store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture
def make_store(spark, tmp_path):
    """make_store(edges=[{...}], ...) writes a store; tables not given are empty. clashing=True adds columns whose names the
    operators use themselves."""
    from pyspark.sql import functions as F

    count = iter(range(1000))

    def make(clashing: bool = False, **tables):
        root = f"{tmp_path}/store{next(count)}"
        for name, schema in SCHEMAS.items():
            parsed = spark.createDataFrame([], schema).schema
            rows = [tuple(r.get(f.name) for f in parsed.fields) for r in tables.get(name, [])]
            df = spark.createDataFrame(rows, parsed)
            if clashing:
                df = df.withColumns({c: F.lit(7) for c in CLASHING if c not in df.columns})
            df.write.parquet(f"{root}/{name}.parquet")
        return root

    return make


@pytest.fixture(scope="session")
def oracle():
    """Runs SQL over a store's tables, and gives rows as sorted tuples of columns in order of their names."""
    import duckdb

    def run(root: str, sql: str):
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for f in os.listdir(root):
            p = f"{root}/{f}"
            con.execute(f"create view {f[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        return [dict(zip(names, r)) for r in got.fetchall()]

    return run


def normal(rows) -> list[tuple]:
    """Rows to compare: columns by name, numbers to six digits."""

    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, int):
            return str(v)
        if isinstance(v, float):
            return "NULL" if v != v else f"{v:.6g}" if v != int(v) else str(int(v))
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(one, v)) + "]"
        return str(v)

    out = []
    for r in rows:
        d = r.asDict() if hasattr(r, "asDict") else r
        out.append(tuple((k, one(d[k])) for k in sorted(d)))
    return sorted(out)
