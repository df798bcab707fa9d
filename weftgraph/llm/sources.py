"""Spark operators over source files: validity, provenance, and functions with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.provenance import LABELS
from weftgraph.workspace import Workspace


def latest_files(files: DataFrame) -> DataFrame:
    """id, path, language, is_system: of each file its last record; ids that are null are left out."""
    last = F.max(F.struct("scan_run", "delivery_id", "path", "language", "is_system")).alias("last")
    return files.where("id is not null").groupBy(F.col("id").alias("file_id")).agg(last).select("file_id", "last.path", "last.language", "last.is_system")


# syntax

_CHECKED = "doc_id bigint, file_id bigint, path string, stated string, language string, errors int, line int, cause string, lines array<int>, causes array<string>"


def check_syntax(docs: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each document of a known file with a text. ``language`` is the one checked, null for a file whose language
    isn't known here, which then has no errors. Lines and causes hold all errors, ``errors`` is their number."""
    source = docs.where("file_id is not null and text is not null").select("doc_id", "file_id", "text")
    rows = source.join(latest_files(files).select("file_id", "path", "language"), "file_id").select("doc_id", "file_id", "path", "language", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftgraph.llm.syntax import check, language_of

        for batch in batches:
            paths, stated = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            names = [language_of(p, s) for p, s in zip(paths, stated)]
            found = [check(t, n) if n else None for t, n in zip(batch.column(4).to_pylist(), names)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(names, pa.string()),
                    pa.array([v.errors if v else 0 for v in found], pa.int32()), pa.array([v.line if v and v.errors else None for v in found], pa.int32()), pa.array([v.cause if v and v.errors else None for v in found], pa.string()),
                    pa.array([v.lines if v else [] for v in found], pa.list_(pa.int32())), pa.array([v.causes if v else [] for v in found], pa.list_(pa.string())),
                ],
                names=["doc_id", "file_id", "path", "stated", "language", "errors", "line", "cause", "lines", "causes"],
            )

    return rows.mapInArrow(run, _CHECKED)


def syntax_rates(checked: DataFrame) -> DataFrame:
    """Acceptance per repository (the first component of the path) and language."""
    rows = checked.where("language is not null").groupBy(F.split("path", "/")[0].alias("repo"), "language").agg(F.count("*").alias("n_files"), F.sum((F.col("errors") > 0).cast("bigint")).alias("n_invalid"))
    return rows.withColumn("accepted", 1 - F.col("n_invalid") / F.col("n_files"))


# provenance

_FEATURES = "file_id bigint, tool boolean, about boolean, copy boolean, platform boolean, owner string, guard boolean, marks int, family int, data double, squeezed double, chars int"


def text_evidence(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftgraph.llm.provenance import evidence

        for batch in batches:
            found = [evidence(t) for t in batch.column(1).to_pylist()]
            cols = list(zip(*found)) if found else [[] for _ in range(11)]
            kinds = [pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]
            arrays = [pa.array(list(c), k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["file_id", "tool", "about", "copy", "platform", "owner", "guard", "marks", "family", "data", "squeezed", "chars"])

    return docs.where("file_id is not null and text is not null").select("file_id", "text").mapInArrow(run, _FEATURES)


# fixed values: what the names of folders and files suggest
_COPIES = "third_party|3rdparty|thirdparty|third-party|vendor|vendors|_?vendored|external|externals|extern|deps|contrib|node_modules|bower_components"
_PLATFORMS = "usr|sysroot|toolchains?|sdk|cross|arm-none|bits|x86_64-linux-gnu"
_GENERATED = "gen|_?autogen|generated|codegen|generated-sources|generated-src|cc-out|gen-src|autogenerated|target|out|stubs"
_SQUEEZED = "dist|assets|static|public|bundles?|min"
_BLOBS = "fixtures|data|resources|blobs?|testdata"

# log-potentials over LABELS: the more negative, the less two labels go together


def _child(parent: str, child: str) -> float:
    """Folder in folder."""
    return 0.0 if parent == child else -3.0 if parent == "handwritten" else -200.0 if parent == "vendored" else -2.5


def _file(folder: str, label: str) -> float:
    """File in folder: also how alike siblings are."""
    if folder == label:
        return 0.0
    return -2.5 if folder == "handwritten" else -4.0 if folder == "vendored" else -2.0


def _matrix(compat) -> list[list[float]]:
    """[label of the outer folder][label inside]"""
    return [[compat(o, i) for i in LABELS] for o in LABELS]


def send(rows: DataFrame, belief: str, out: str, matrix: list[list[float]], minus: str | None = None) -> DataFrame:
    """Adds the columns out0, out1, ...: log-sum-exp messages over one kind of edge, in batches of columns. ``belief`` and
    ``minus`` are column prefixes; what ``minus`` brought is taken off first, nulls count as 0. matrix: [from][to]."""
    n = len(LABELS)
    kept = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(matrix)

        def columns(batch, prefix):
            return np.column_stack([np.nan_to_num(batch.column(kept.index(f"{prefix}{k}")).to_numpy(zero_copy_only=False).astype(float)) for k in range(n)])

        for batch in batches:
            b = columns(batch, belief)
            if minus:
                b = b - columns(batch, minus)
            terms = b[:, :, None] + table[None, :, :]
            top = terms.max(axis=1) if len(b) else np.zeros((0, n))
            got = top + np.log(np.exp(terms - top[:, None, :]).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(got[:, k]) for k in range(n)]], names=[*kept, *[f"{out}{k}" for k in range(n)]])

    return rows.mapInArrow(run, fields + "".join(f", {out}{k} double" for k in range(n)))


def _cols(prefix: str) -> list[Column]:
    return [F.coalesce(F.col(f"{prefix}{k}"), F.lit(0.0)) for k in range(len(LABELS))]


def _named(cols: list[Column], prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{k}") for k, c in enumerate(cols)]


def _sums(prefix: str, out: str) -> list[Column]:
    return [F.sum(f"{prefix}{k}").alias(f"{out}{k}") for k in range(len(LABELS))]


def file_potentials(rows: DataFrame) -> list[Column]:
    """Evidence of text, name and record for each label."""
    repo = F.lower(F.split("path", "/")[0])
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    on = lambda c, w: F.when(F.coalesce(c, F.lit(False)), float(w)).otherwise(0.0)
    col = F.col
    own, other = col("owner") == repo, col("owner").isNotNull() & (col("owner") != repo)
    hand = 0.8 + on(col("about"), 3) + on(own, 2)
    generated = on(col("tool"), 7) + on(col("family") > 0, 6) + on((col("marks") > 0) & (col("squeezed") < 0.5), 6) + on(name.rlike(r"_pb2|\.pb[.-]|^moc_|\.tab\.|^zz_generated|\.g\.|\.gen\.|stub\.|_string\.|bindings\."), 1.5)
    squeezed = on(col("squeezed") >= 0.5, 8) + on(name.rlike(r"[.-]min\.|bundle\.[0-9a-f]{4,}|\.bundle\."), 1.5)
    vendored = on(col("copy"), 7) + on(other, 6) + on(col("platform"), 4) + on(col("guard"), 3.5) + on(col("is_system"), 0.7)
    blob = on(col("data") > 0.6, 7) + on((col("data") > 0.4) & (col("data") <= 0.6), 1.0) + on(name.rlike(r"_data\.|_blob\."), 0.7)
    return [hand, generated, squeezed, vendored, blob]


def folder_potentials() -> list[Column]:
    """What a folder's own name says. A folder of copies holds each in a folder of its own, so one without folders is
    taken for an ordinary one."""
    name = F.lower("name")
    on = lambda p, w: F.when(name.rlike(f"^(?:{p})$"), float(w)).otherwise(0.0)
    copies = F.when(name.rlike(f"^(?:{_COPIES})$") & F.col("nested"), 30.0).otherwise(0.0)
    special = name.rlike(f"^(?:{_COPIES}|{_PLATFORMS}|{_GENERATED}|{_SQUEEZED}|{_BLOBS})$")
    hand = F.when(special, 0.5).otherwise(1.5)
    return [hand, on(_GENERATED, 2.5), on(_SQUEEZED, 1.0), copies + on(_PLATFORMS, 4.0), on(_BLOBS, 1.0)]


def infer_labels(spark: SparkSession, work: Workspace, evidence: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, label, confidence by sum-product belief propagation over each repository's folders. The tree is exact: one
    sweep from the deepest folders up and one down. Messages of a folder's files are summed before they are shuffled, so
    a folder with a third of all files is no burden."""
    down_file, down_folder = _matrix(_file), _matrix(_child)
    up_file, up_folder = [list(r) for r in zip(*down_file)], [list(r) for r in zip(*down_folder)]
    known = latest_files(files).where("path is not null").join(evidence, "file_id", "left").withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))
    known = known.select("file_id", "folder", F.col("chars").isNotNull().alias("has_text"), *_named(file_potentials(known), "e"))
    files_at = work.save(send(known, "e", "f", up_file), "files")
    messages = files_at.groupBy("folder").agg(*_sums("f", "f"))
    # all folders above, once each; nested: has a folder inside
    chain = files_at.select("folder").distinct().withColumn("parts", F.split("folder", "/"))
    above = chain.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("folder")).distinct()
    above = above.select("folder", F.size(F.split("folder", "/")).alias("depth"), F.element_at(F.split("folder", "/"), -1).alias("name"), F.regexp_replace("folder", "/?[^/]*$", "").alias("parent"))
    has = above.where("depth > 1").select(F.col("parent").alias("folder")).distinct().withColumn("nested", F.lit(True))
    folders = above.join(has, "folder", "left").withColumn("nested", F.coalesce("nested", F.lit(False)))
    folders = folders.select("folder", "parent", "depth", *_named(folder_potentials(), "n")).join(messages, "folder", "left")
    folders = work.save(folders.select("folder", "parent", "depth", *_named([a + b for a, b in zip(_cols("n"), _cols("f"))], "b")), "folders")
    deepest = folders.agg(F.max("depth")).first()[0] or 0
    ups: dict[int, DataFrame] = {}
    for depth in range(deepest, 0, -1):
        here = folders.where(F.col("depth") == depth)
        if depth < deepest:
            inner = ups[depth + 1].groupBy(F.col("parent").alias("folder")).agg(*_sums("s", "m"))
            here = here.join(inner, "folder", "left").select("folder", "parent", *_named([a + b for a, b in zip(_cols("b"), _cols("m"))], "u"))
        else:
            here = here.select("folder", "parent", *_named(_cols("b"), "u"))
        ups[depth] = work.save(send(here, "u", "s", up_folder), f"up={depth}")
    beliefs = spark.createDataFrame([], "folder string, " + ", ".join(f"t{k} double" for k in range(len(LABELS))))
    outer = None
    for depth in range(1, deepest + 1):
        if outer is None:
            now = ups[depth].select("folder", *_named(_cols("u"), "t"))
        else:
            joined = ups[depth].join(outer.select(F.col("folder").alias("parent"), *_named(_cols("t"), "p")), "parent")
            got = send(joined, "p", "g", down_folder, minus="s")
            now = got.select("folder", *_named([u + g for u, g in zip(_cols("u"), _cols("g"))], "t"))
        outer = work.save(now, f"down={depth}")
        beliefs = beliefs.unionByName(outer)
    placed = send(files_at.join(beliefs, "folder"), "t", "g", down_file, minus="f")
    scored = placed.select("file_id", "has_text", *_named([e + g for e, g in zip(_cols("e"), _cols("g"))], "x"))
    x = [F.col(f"x{k}") for k in range(len(LABELS))]
    scored = scored.withColumn("best", F.greatest(*x))
    label = F.coalesce(*[F.when(c == F.col("best"), F.lit(name)) for c, name in zip(x, LABELS)])
    odds = sum((F.exp(c - F.col("best")) for c in x[1:]), F.exp(x[0] - F.col("best")))
    return scored.select("file_id", "has_text", label.alias("label"), (1 / odds).alias("confidence"))


# functions with their documentation

_PAIRS = "id string, name string, signature string, code string, description string, inherits boolean, has_body boolean, path string, repo string, owner string"


def extract_pairs(functions: DataFrame) -> DataFrame:
    """A row for each distinct captured text with a definition that has a body. Description is empty where the documentation
    is missing or trivial; ``inherits`` where it refers to the overridden method's."""
    rows = functions.where("id is not null and body_text_compressed is not null").select("id", "name", "signature", "source_file", F.col("body_text_compressed").alias("body")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftgraph.llm.docpairs import extract
        from weftgraph.llm.hierarchy import owner
        from weftgraph.llm.syntax import language_of

        for batch in batches:
            ids, names, signatures, paths, bodies = (c.to_pylist() for c in batch.columns)
            out = [
                (i, n, s, p.code, p.description, p.inherits, True, f, (f or "").partition("/")[0], owner(b, language_of(f, None), n))
                for i, n, s, f, b in zip(ids, names, signatures, paths, bodies) if (p := extract(b, f, n)) is not None
            ]
            cols = list(zip(*out)) if out else [[] for _ in range(10)]
            kinds = [pa.string()] * 5 + [pa.bool_()] * 2 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["id", "name", "signature", "code", "description", "inherits", "has_body", "path", "repo", "owner"])

    return rows.mapInArrow(run, _PAIRS)


def class_table(docs: DataFrame, files: DataFrame) -> DataFrame:
    """repo, path, class, bases, methods: the classes of all source texts."""
    source = docs.where("file_id is not null and text is not null").select("file_id", "text")
    # most texts have none of the words that a class begins with
    source = source.where(F.col("text").rlike(r"\b(?:class|interface|struct|trait|impl|enum|record)\b"))
    rows = source.join(latest_files(files).where("path is not null").select("file_id", "path", "language"), "file_id").select("path", "language", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftgraph.llm.hierarchy import classes
        from weftgraph.llm.syntax import language_of

        for batch in batches:
            out = [(p.partition("/")[0], p, *c) for p, s, t in zip(*(c.to_pylist() for c in batch.columns)) for c in classes(t, language_of(p, s))]
            cols = list(zip(*out)) if out else [[] for _ in range(5)]
            kinds = [pa.string()] * 3 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["repo", "path", "class", "bases", "methods"])

    return rows.mapInArrow(run, "repo string, path string, class string, bases array<string>, methods array<string>")


def class_bases(table: DataFrame) -> DataFrame:
    """repo, class, base: a class of that name anywhere in the repository."""
    return table.select("repo", "class", F.explode("bases").alias("base")).where("base <> class").distinct()


def class_members(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """id, repo, class, name: methods by what they themselves name as their class, else by the class of their file that
    declares a method of their name. Functions outside of classes are missing."""
    own = pairs.where("owner is not null").select("id", "repo", F.col("owner").alias("class"), "name")
    declared = table.select("path", "class", F.explode("methods").alias("name")).distinct()
    by_file = pairs.where("owner is null").join(declared, ["path", "name"]).select("id", "repo", "class", "name")
    return own.unionByName(by_file).distinct()


def resolve_inherited(spark: SparkSession, work: Workspace, pairs: DataFrame, overrides: DataFrame, members: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """Descriptions of overridden methods for those that refer to them.

    overrides: id, overridden. members: id, repo, class, name; bases: repo, class, base: a method overrides that of the same
    name in the bases of its class. Null and repeated rows count once. Each step joins what waits with what it overrides,
    without the places where it has been, and takes the nearest level that has a description, of several there the least.
    It ends when nothing waits: what ends on a cycle or above the hierarchy stays without."""
    pairs = work.save(pairs.withColumn("depth", F.when(F.col("description") != "", 0)), "pairs")
    solved = spark.createDataFrame([], "id string, found string, levels int")
    slot = ["repo", "class", "name"]
    start = work.save(pairs.where("inherits and description = ''").select("id").distinct(), "start")
    if not start.isEmpty():
        edges = work.save(overrides.where("id is not null and overridden is not null and id <> overridden").select("id", "overridden").distinct(), "overrides")
        members = work.save(members if members is not None else spark.createDataFrame([], "id string, repo string, class string, name string"), "members")
        bases = work.save(bases if bases is not None else spark.createDataFrame([], "repo string, class string, base string"), "bases")
        told = pairs.where("description <> ''").groupBy("id").agg(F.min("description").alias("found"))
        key = F.to_json(F.struct(*slot))
        known = told.withColumnRenamed("id", "at").unionByName(members.join(told, "id").groupBy(key.alias("at")).agg(F.min("found").alias("found")))
        known = work.save(known, "known")
        waiting = start.join(members, "id", "left").select("id", F.col("id").alias("at"), *slot)
        waiting.select("id", "at").distinct().write.mode("overwrite").parquet(work.at("visited"))
        waiting, step = work.save(waiting, "waiting=0"), 0
        while not waiting.isEmpty():
            step += 1
            by_edge = waiting.join(edges.withColumnRenamed("id", "at"), "at").select("id", F.col("overridden").alias("over")).join(members.withColumnRenamed("id", "over"), "over", "left").select("id", F.col("over").alias("at"), *slot)
            by_class = waiting.where("class is not null").join(bases, ["repo", "class"]).select("id", "repo", F.col("base").alias("class"), "name").select("id", key.alias("at"), *slot)
            visited = work.load("visited", "id string, at string")
            next_up = by_edge.unionByName(by_class).distinct().join(visited, ["id", "at"], "left_anti")
            looked = work.save(next_up.join(known, "at", "left"), f"looked={step}")
            looked.select("id", "at").distinct().write.mode("append").parquet(work.at("visited"))
            hit = looked.where("found is not null").groupBy("id").agg(F.min("found").alias("found")).withColumn("levels", F.lit(step))
            solved = solved.unionByName(hit)
            waiting = work.save(looked.where("found is null").select("id", "at", *slot).join(hit.select("id"), "id", "left_anti"), f"waiting={step}")
    out = pairs.join(solved, "id", "left")
    text = F.when(F.col("description") != "", F.col("description")).otherwise(F.when(F.col("inherits"), F.col("found")))
    return out.withColumn("description", text).withColumn("levels", F.coalesce("depth", "levels")).where("description is not null").drop("found", "depth")
