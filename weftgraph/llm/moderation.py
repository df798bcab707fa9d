"""Scoring a table of documents for abusive, hateful or sexual content.

The chain is fitted on the driver to a bounded sample of labelled documents; everything else covers all documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.toxicity import CATEGORIES, Chain, train
from weftgraph.workspace import Workspace

#: Labelled documents that the chain is fitted to at most, taken in the order of a hash of their ids, and characters that
#: their texts have together at most. Texts are used as a whole or not at all.
MAX_LABELLED, MAX_CHARACTERS = 8000, 64_000_000

_SCORERS: dict[str, object] = {}


def majority(labels: DataFrame) -> DataFrame:
    """doc_id, label: what most annotators said. Ties and null judgements tell nothing."""
    votes = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("share"))
    return votes.where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"))


def fit(spark: SparkSession, work: Workspace, docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, characters: int = MAX_CHARACTERS) -> Chain | None:
    """A chain from the labelled documents; none without labels of both kinds. A document whose id occurs with several texts
    is taken once, with the least of them."""
    sample = majority(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most ``most`` rows, so it may be broadcast
    labelled = docs.where("text <> ''").select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    labelled = work.save(labelled, "labelled")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over the sample's sizes, at most ``most`` rows
    kept = labelled.select("doc_id", F.sum(F.length("text")).over(order).alias("upto")).where(F.col("upto") <= characters).select("doc_id")
    return train([tuple(r) for r in labelled.join(F.broadcast(kept), "doc_id").select("doc_id", "label", "text").collect()])


def score(docs: DataFrame, chain: Chain | None, keep: list[str]) -> DataFrame:
    """The columns of ``keep``, a probability for each category, and the most toxic segment; a row for each document. A null
    or empty text has probability 0, and so has every text without a chain."""
    shared = docs.sparkSession.sparkContext.broadcast(chain and tuple(chain))
    name = uuid.uuid4().hex
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftgraph.llm.toxicity import Chain, Scorer

        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value and Chain(*shared.value))
        scorer = _SCORERS[name]
        for batch in batches:
            found = scorer.texts(batch.column(0).to_pylist())
            probs = [pa.array([float(p[k]) for p, _ in found], pa.float64()) for k in range(len(CATEGORIES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *probs, pa.array([s for _, s in found], pa.string())], names=[*keep, *CATEGORIES, "sentence"])

    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, f"{fields}, {', '.join(f'{c} double' for c in CATEGORIES)}, sentence string")


def rates(scored: DataFrame, threshold: float) -> DataFrame:
    """Per source: documents, toxic ones, their share, and how many of each category."""
    over = lambda c: F.sum((F.col(c) > threshold).cast("bigint"))
    rows = scored.groupBy("source").agg(F.count("*").alias("n_docs"), over("toxic").alias("n_toxic"), *[over(c).alias(f"n_{c}") for c in CATEGORIES[:-1]])
    return rows.withColumn("rate", F.col("n_toxic") / F.col("n_docs"))
