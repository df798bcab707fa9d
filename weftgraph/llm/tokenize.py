"""Encoding a table of texts with a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every operator here.
VOCABULARIES = os.environ.get("WEFTGRAPH_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

_ENCODERS: dict[int, object] = {}


def _shared(spark: SparkSession, path: str):
    """The vocabulary file, below 1 MB, for all executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoder(vocabulary):
    """One encoder for each process, kept from task to task."""
    from weftgraph.llm.bpe import Encoder, load_ranks

    data = vocabulary.value
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(data))
    return _ENCODERS[key]


def encode(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key, ids: the ids of each text. An empty and a null text give the empty list; a row each, repeated keys included."""
    vocabulary = _shared(docs.sparkSession, path or f"{VOCABULARIES}/{VOCABULARY}")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            ends, parts = [0], []
            for t in batch.column(1).to_pylist():
                ids = encoder.encode(t)
                parts.append(np.array(ids, dtype=np.int32))
                ends.append(ends[-1] + len(ids))
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(docs: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns of ``keep``, and tokens: how many ids the text has; 0 for an empty or null one."""
    vocabulary = _shared(docs.sparkSession, path or f"{VOCABULARIES}/{VOCABULARY}")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            tokens = pa.array([encoder.count(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], tokens], names=[*keep, "tokens"])

    return docs.select(F.col(text).alias("_text"), *keep).mapInArrow(run, f"{fields}, tokens bigint")
