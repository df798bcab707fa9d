"""Text functions as columns, and searches over texts and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the n-gram vocabulary at most, by document frequency.
VOCABULARY = 5000


def tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), 1))


def name_parts(c: Column) -> Column:
    """Parts of camel-case and snake-case names, lower case, in order, each once."""
    split = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.regexp_extract_all(F.lower(split), F.lit("([a-z0-9]+)"), 1))


def token_estimate(c: Column) -> Column:
    """A quarter of the other characters plus half of the CJK ones, each rounded down, plus one."""
    cjk = F.length(F.regexp_replace(c, "[^\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af]", ""))
    return (F.floor((F.length(c) - cjk) / 4) + F.floor(cjk / 2) + 1).cast("bigint")


def char_ngrams(c: Column, n: int = 3) -> Column:
    """n-grams of $word$ for each word of a lower-case text, repetitions kept; a word too short for one is kept whole."""
    clean = F.regexp_replace(F.lower(c), "[^a-z0-9_]+", " ")
    words = F.filter(F.split(clean, " "), lambda w: w != "")
    of = lambda w: F.when(F.length(w) + 2 < n + 1, F.array(F.concat(F.lit("$"), w, F.lit("$")))).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(w) + 3 - n), lambda i: F.substr(F.concat(F.lit("$"), w, F.lit("$")), i, F.lit(n)))
    )
    return F.flatten(F.transform(words, of))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def tfidf_search(docs: DataFrame, key: str, text: str, query: str, k: int = 10) -> DataFrame:
    """key, score: cosine of n-gram TF-IDF vectors with the query's; tf is count over total, idf = ln((N + 1) / (df + 1)) + 1.
    Only postings of the query's n-grams meet it; norms come from all of a text's n-grams in the vocabulary."""
    grams = docs.select(key, F.explode(char_ngrams(F.col(text))).alias("g")).groupBy(key, "g").agg(F.count("*").alias("n"))
    grams = grams.withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    n_docs = docs.agg(F.count("*").alias("N"))  # one row
    vocabulary = grams.groupBy("g").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "g").limit(VOCABULARY)
    idf = vocabulary.crossJoin(F.broadcast(n_docs)).select("g", (F.log((F.col("N") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weights = grams.join(idf, "g").select(key, "g", (F.col("n") / F.col("total") * F.col("idf")).alias("w"))
    spark = docs.sparkSession
    q = spark.createDataFrame([(query,)], "t string").select(F.explode(char_ngrams(F.col("t"))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    q = q.withColumn("total", F.sum("n").over(Window.partitionBy())).join(idf, "g").select("g", (F.col("n") / F.col("total") * F.col("idf")).alias("q"))
    norm_q = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("nq"))  # one row
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nd"))
    dots = weights.join(q, "g").groupBy(key).agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    return dots.join(norms, key).crossJoin(F.broadcast(norm_q)).select(key, F.round(F.col("dot") / (F.col("nd") * F.col("nq")), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def all_terms(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Keys of the texts that have all terms as words."""
    return docs.where(F.size(F.array_intersect(tokens(F.col(text)), F.array(*map(F.lit, terms)))) == len(set(terms))).select(key)


#: Queries that are held against all vectors at once; bounds what each task is sent.
BLOCK = 1000


def cosine_topk(spark: SparkSession, vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query, key, score: the k vectors most like each query, itself left out; equal scores by key. Exact: queries go in
    blocks, each task keeps its k best for each query, and those are merged. Zero and null vectors have no neighbours."""
    out = None
    block: list = []

    def against(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        m = np.array([r[1] for r in rows], dtype=np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            best_s, best_k = np.full((len(qid), 0), -np.inf), np.zeros((len(qid), 0), dtype=np.int64)
            for b in batches:
                keys = b.column(0).to_numpy(zero_copy_only=False)
                if not len(keys):
                    continue
                v = np.array(b.column(1).to_pylist(), dtype=np.float64)
                length = np.linalg.norm(v, axis=1)
                s = np.round(q @ (v / np.where(length > 0, length, 1)[:, None]).T, 6)
                s[:, length == 0] = -np.inf
                s[qid[:, None] == keys[None, :]] = -np.inf
                best_s, best_k = np.hstack([best_s, s]), np.hstack([best_k, np.broadcast_to(keys, s.shape)])
                if best_s.shape[1] > k:
                    order = np.lexsort((best_k, -best_s), axis=1)[:, :k]
                    best_s, best_k = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_k, order, 1)
            ok = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, ok.sum(axis=1))), pa.array(best_k[ok]), pa.array(best_s[ok])], names=["query", key, "score"])

        part = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), vector).mapInArrow(run, f"query bigint, {key} bigint, score double")
        ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key)))
        return ranked.where(F.col("rank") <= k)

    for r in queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector).orderBy(key).toLocalIterator():
        if any(r[1]):
            block.append((r[0], r[1]))
        if len(block) == BLOCK:
            out = against(block) if out is None else out.unionByName(against(block))
            block = []
    if block:
        out = against(block) if out is None else out.unionByName(against(block))
    return out if out is not None else spark.createDataFrame([], f"query bigint, {key} bigint, score double, rank int")


def memory_weight(days: Column, merged: Column, length: Column, accessed: Column) -> Column:
    """exp(-0.05 days) (1 + 0.1 merged + 0.05 length / 1000) (1 + 0.1 accessed), at most 10."""
    return F.least(F.lit(10.0), F.exp(-0.05 * days) * (1 + 0.1 * merged + 0.05 * length / 1000) * (1 + 0.1 * accessed))
