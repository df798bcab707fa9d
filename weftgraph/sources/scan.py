"""Source trees as tables of facts, and facts as sources.

``scan_tree`` reads files as whole texts and takes facts from them by patterns: functions with their extent, calls, includes,
macros and conditions. It is the part of a scanner that needs no compiler; facts that need one are read from tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.shipping import ship

# fixed values: languages by the ending of a file's name
ENDINGS = {"c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "go": "go", "py": "python", "java": "java", "rs": "rust", "s": "asm", "js": "javascript"}

_FACT = "path string, language string, kind string, name string, line int, detail string"
_NOT_CALLS = frozenset("if for while switch return sizeof catch elif and or not in def func fn match with assert print lambda new delete throw defined".split())
_DEFINES = {
    "c": re.compile(r"^(?:[A-Za-z_][\w ]*[ *]+)([A-Za-z_]\w*)\s*\(([^;{}]*)\)\s*\{", re.M),
    "java": re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\(([^;{}]*)\)[^;{}]*\{", re.M),
    "go": re.compile(r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(([^)]*)\)", re.M),
    "python": re.compile(r"^[ \t]*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)(?:<[^>]*>)?\s*\(([^)]*)\)", re.M),
    "javascript": re.compile(r"^[ \t]*(?:export\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(([^)]*)\)", re.M),
    "asm": re.compile(r"^([A-Za-z_.$][\w.$]*):()", re.M),
}
_DEFINES["cpp"] = re.compile(r"^(?:[A-Za-z_][\w:<>,&* ]*[ *&]+)((?:\w+::)*~?\w+)\s*\(([^;{}]*)\)[^;{}]*\{", re.M)
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_BL = re.compile(r"^\s*(?:bl|call|callq|jal)\s+([A-Za-z_.$][\w.$]*)", re.M)
_INCLUDE = re.compile(r'^\s*#\s*include\s*[<"]([^>"\n]+)[>"]|^\s*(?:import|from|use)\s+"?([\w./:]+)', re.M)
_MACRO = re.compile(r"^\s*#\s*define\s+(\w+)(?:\([^)]*\))?[ \t]*(.*)$", re.M)
_CONDITION = re.compile(r"^\s*#\s*(if|ifdef|ifndef|elif)\b[ \t]*(.*)$", re.M)
_TEXTS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.){0,8}'", re.S)


def facts(path: str, text: str) -> list[tuple]:
    """(path, language, kind, name, line, detail) of function, call, include, macro and condition facts. A call's detail is
    the function that it stands in; the last function that began before it."""
    ending = path.rpartition(".")[2].lower()
    language = ENDINGS.get(ending)
    if language is None:
        return []
    bare = text if language in ("python", "asm") else _TEXTS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    ends = [m.start() for m in re.finditer("\n", text)]
    from bisect import bisect_left

    line = lambda at: bisect_left(ends, at) + 1
    out, begins = [], []
    for m in _DEFINES[language].finditer(bare):
        if m[1] not in _NOT_CALLS and m[1] not in ("else", "do"):
            begins.append((m.start(1), m[1]))
            out.append((path, language, "function", m[1], line(m.start(1)), " ".join(m[2].split())))
    starts = [b for b, _ in begins]
    for m in (_BL if language == "asm" else _CALL).finditer(bare):
        k = bisect_left(starts, m.start(1)) - 1
        if k >= 0 and m[1] not in _NOT_CALLS and m.start(1) not in starts:
            out.append((path, language, "call", m[1], line(m.start(1)), begins[k][1]))
    for m in _INCLUDE.finditer(text):
        out.append((path, language, "include", m[1] or m[2], line(m.start()), None))
    if language in ("c", "cpp", "asm"):
        out += [(path, language, "macro", m[1], line(m.start(1)), m[2].strip()) for m in _MACRO.finditer(text)]
        out += [(path, language, "condition", m[1], line(m.start(1)), m[2].strip()) for m in _CONDITION.finditer(text)]
    return out


def scan_texts(texts: DataFrame) -> DataFrame:
    """texts: path, text. A failing task is tried again by itself, so a scan needs no checkpoint of its own."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
        names = ["path", "language", "kind", "name", "line", "detail"]
        for b in batches:
            found = [f for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if p and t for f in facts(p, t)]
            cols = list(zip(*found)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return texts.select("path", "text").mapInArrow(run, _FACT)


def scan_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return scan_texts(texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    texts = spark.read.text(paths, wholetext=True)
    return scan_texts(texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def domain_of(path):
    """The dotted folder path of a file."""
    return F.regexp_replace(F.regexp_replace(path, "/[^/]*$", ""), "/", ".")


def graph_from_facts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes: id, name, domain, source_file, line_number, signature; edges: src, dst, relation, call_order. A call goes to the
    function of that name in the same file, else in the same folder, else to the only one of that name, else to the bare name."""
    from pyspark.sql import Window

    f = found.where("kind = 'function'")
    ident = lambda p, n: F.regexp_replace(F.concat_ws("_", domain_of(p), n), r"[^\w]+", "_")
    nodes = f.select(ident(F.col("path"), F.col("name")).alias("id"), "name", domain_of(F.col("path")).alias("domain"), F.col("path").alias("source_file"), F.col("line").alias("line_number"), F.col("detail").alias("signature")).dropDuplicates(["id"])
    calls = found.where("kind = 'call'").select("path", domain_of(F.col("path")).alias("domain"), F.col("detail").alias("caller"), F.col("name").alias("callee"), "line")
    order = F.row_number().over(Window.partitionBy("path", "caller").orderBy("line", "callee"))
    calls = calls.withColumn("call_order", order).withColumn("src", ident(F.col("path"), F.col("caller")))
    many = nodes.groupBy("name").agg(F.count("*").alias("n"))
    cand = calls.join(nodes.select(F.col("name").alias("callee"), "id", "source_file", F.col("domain").alias("d")), "callee", "left").join(many.withColumnRenamed("name", "callee"), "callee", "left")
    rank = F.when(F.col("path") == F.col("source_file"), 1).when(F.col("domain") == F.col("d"), 2).when(F.col("n") == 1, 3).otherwise(9)
    best = cand.withColumn("rank", rank).groupBy("src", "callee", "call_order").agg(F.min(F.struct("rank", "id")).alias("b"))
    return nodes, best.select("src", F.when(F.col("b.rank") < 9, F.col("b.id")).otherwise(F.col("callee")).alias("dst"), F.lit("INVOKES").alias("relation"), "call_order")


def read_domain_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A graph as JSON files with nodes and edges in arrays, one file a domain."""
    schema = "domain string, nodes array<struct<id:string,name:string,source_file:string,line_number:int,signature:string,labels:array<string>>>, edges array<struct<src:string,dst:string,relation:string,call_order:int>>"
    docs = spark.read.schema(schema).option("multiLine", "true").json(path)
    return docs.select("domain", F.explode("nodes").alias("n")).select("n.*", "domain"), docs.select(F.explode("edges").alias("e")).select("e.*")


def write_domains(nodes: DataFrame, path: str) -> None:
    """Nodes in a folder for each domain, for readers that want one domain."""
    nodes.repartition("domain").write.mode("overwrite").partitionBy("domain").parquet(path)


def write_index(edges: DataFrame, path: str) -> None:
    """The reverse index as JSON lines: for each function its distinct callers, in order."""
    edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("callers")).write.mode("overwrite").json(path)


def render_tokens(tokens: DataFrame) -> DataFrame:
    """tokens: file_id, seq, preceding_whitespace, spelling. The text of each file and its SHA-256."""
    one = F.struct("seq", F.concat(F.coalesce("preceding_whitespace", F.lit("")), F.coalesce("spelling", F.lit(""))).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), "")
    return tokens.groupBy("file_id").agg(text.alias("text")).withColumn("sha256", F.sha2("text", 256))
