"""Named queries over documents, source files and functions, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import moderation, packing, sources, tokenize
from weftgraph.sources.tables import table
from weftgraph.workspace import Workspace


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return sources.check_syntax(table(spark, d, "documents"), table(spark, d, "cgdb_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).where("errors > 0").select("file_id").distinct()


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """Every checked file with its errors."""
    return _checked(spark, d)


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return sources.syntax_rates(_checked(spark, d))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    """The inferred label of every file, with or without a text."""
    work = Workspace(spark, "provenance")
    evidence = work.save(sources.text_evidence(table(spark, d, "documents")), "evidence")
    return sources.infer_labels(spark, work, evidence.dropDuplicates(["file_id"]), table(spark, d, "cgdb_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_labels(spark, d).where("has_text and label <> 'handwritten'").select("file_id").distinct()


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Functions with their documentation, their own (level 0) or that of the method they override. Classes come from the
    source texts of the functions' repositories."""
    work = Workspace(spark, "pairs")
    pairs = work.save(sources.extract_pairs(table(spark, d, "functions")), "extracted")
    classes = work.save(sources.class_table(table(spark, d, "documents"), table(spark, d, "cgdb_files")), "classes")
    edges = table(spark, d, "edges").where("relation in ('OVERRIDES', 'IMPLEMENTS')").select(F.col("invoker_id").alias("id"), F.col("invoked_id").alias("overridden"))
    return sources.resolve_inherited(spark, work, pairs, edges, sources.class_members(pairs, classes), sources.class_bases(classes))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("levels = 0").select("id").distinct()


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description, inherited documentation resolved."""
    return _pairs(spark, d).select("id", "name", "signature", "code", "description", "levels")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """container, doc_id, piece and tokens for each plan."""
    work = Workspace(spark, "packing")
    tokens = work.save(tokenize.token_counts(table(spark, d, "documents"), "text", ["doc_id", "source"]), "tokens")
    plans = [r.asDict() for r in table(spark, d, "pack_plans").collect()]  # plans, not data: a handful of rows
    return packing.fill_containers(spark, work, packing.pieces(tokens, plans))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    """Scores of all documents, and the score from which one is flagged."""
    docs = table(spark, d, "documents")
    chain = moderation.fit(spark, Workspace(spark, "moderation"), docs, table(spark, d, "toxicity_labels"))
    return moderation.score(docs, chain, ["doc_id", "source"]), chain.threshold if chain else 1.0


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    scored, threshold = _scored(spark, d)
    return scored.where(F.col("toxic") > threshold).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0]


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return moderation.rates(*_scored(spark, d))


QUERIES = {f.__name__: f for f in (p4_found, p4_files, p4_rates, p5_found, p5_labels, p7_found, p7_pairs, p8_ids, p9_packed, p10_found, p10_scores, p10_rates)}
SQL: dict[str, str] = {}
