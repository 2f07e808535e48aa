"""Lexical search (BM25) and text vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bounded import collect_bounded, spread

TERM_BREAK = r"[^\p{L}\p{N}]+"
QUERY_BLOCK = 256
MAX_BLOCK_TERMS = 1_000_000
DIGITS = 6


def terms(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), TERM_BREAK, -1), lambda t: t != "")


def _scorer(query_ids: list[int], vocabulary: list[str], shared, k: int, k1: float, b: float, mean: float):
    """Task function: score the documents of its partition, keep the k best per query.

    `shared` holds the weights (terms x queries).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = shared.value, pa.array(vocabulary)
        best = [(np.empty(0), np.empty(0, dtype=np.int64))] * len(query_ids)
        for batch in batches:
            words = batch.column("words")
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(docs)), lengths)
            term = pc.fill_null(pc.index_in(words.flatten(), known), -1).to_numpy(zero_copy_only=False)
            owner, term = owner[term >= 0], term[term >= 0].astype(np.int64)
            cells, n = np.unique(owner * len(vocabulary) + term, return_counts=True)
            owner, term = np.divmod(cells, len(vocabulary))
            gain = n * (k1 + 1) / (n + k1 * (1 - b + b * lengths[owner] / mean))
            present, starts = np.unique(owner, return_index=True)
            ends = [*starts[1:], len(owner)]
            scores = np.zeros((len(present), len(query_ids)))
            for i, (s, e) in enumerate(zip(starts, ends)):
                scores[i] = gain[s:e] @ weights[term[s:e]]
            scores = np.round(scores, DIGITS)
            for q in range(len(query_ids)):
                hit = scores[:, q] > 0
                score = np.concatenate([best[q][0], scores[hit, q]])
                who = np.concatenate([best[q][1], docs[present[hit]]])
                keep = np.lexsort((who, -score))[:k]
                best[q] = (score[keep], who[keep])
        sizes = [len(x[0]) for x in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(query_ids, dtype=np.int64), sizes)),
                    pa.array(np.concatenate([x[1] for x in best]).astype(np.int64)),
                    pa.array(np.concatenate([x[0] for x in best])),
                ],
                names=["query_id", "doc_id", "score"],
            )

    return run


def bm25_topk(
    queries: DataFrame,
    documents: DataFrame,
    k: int,
    query_id: str,
    query_text: str,
    doc_id: str,
    doc_text: str,
    k1: float = 1.2,
    b: float = 0.75,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, doc_id, score, place): the k best documents of each query.

    Two passes over the documents whatever the query terms: one counts in how many
    documents each query term occurs, one scores. No posting list is ever gathered by
    term, so a word found in every document costs no more than its occurrences; each
    task keeps k rows per query. A large query set is taken in blocks, one pass each.
    """
    spark = documents.sparkSession
    asked = queries.select(
        F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms(query_text))).alias("term")
    )
    texts = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")))
    corpus = texts.filter(F.col("text").isNotNull()).select("doc_id", terms("text").alias("words"))
    n_queries = queries.count()
    blocks = 1 if n_queries <= block else -(-n_queries * 2 // block)
    results = None
    for i in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        wanted: dict[int, list[str]] = {}
        for row in collect_bounded(part, MAX_BLOCK_TERMS):
            wanted.setdefault(row["query_id"], []).append(row["term"])
        # `wanted` has just been measured, so the distinct terms are safe to broadcast. The
        # empty term stands for the document itself and brings along its length.
        known = part.select("term").distinct().unionByName(spark.sql("SELECT '' AS term"))
        frequency = (
            corpus.select(F.size("words").alias("length"), "words")
            .select("length", F.explode(F.array_append(F.array_distinct("words"), F.lit(""))).alias("term"))
            .join(F.broadcast(known), "term", "left_semi")
            .groupBy("term")
            .agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("length"))
        )
        found_in = {r["term"]: r for r in collect_bounded(frequency, MAX_BLOCK_TERMS)}
        corpus_row = found_in.pop("", None)
        if not found_in:
            continue
        total, mean = corpus_row["docs"], corpus_row["length"] / corpus_row["docs"]
        vocabulary, ids = sorted(found_in), sorted(wanted)
        row_of = {t: i for i, t in enumerate(vocabulary)}
        weights = np.zeros((len(vocabulary), len(ids)))
        for q, qid in enumerate(ids):
            for term in wanted[qid]:
                if term in row_of:
                    n = found_in[term]["docs"]
                    weights[row_of[term], q] = math.log(1 + (total - n + 0.5) / (n + 0.5))
        shared = spark.sparkContext.broadcast(weights)
        found = corpus.mapInArrow(
            _scorer(ids, vocabulary, shared, k, k1, b, mean), "query_id bigint, doc_id bigint, score double"
        )
        results = found if results is None else results.unionByName(found)
    if results is None:
        results = spark.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return results.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def tfidf_vectors(df: DataFrame, text: str, out: str = "features", size: int = 1 << 18) -> DataFrame:
    """Hashed term frequencies weighted by inverse document frequency (sparse vectors).

    With n distinct terms, a term shares its slot with a share 1 - exp(-n / size) of the others.
    """
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size).transform(
        df.withColumn("_words", terms(F.coalesce(text, F.lit(""))))
    )
    return IDF(inputCol="_tf", outputCol=out).fit(counted).transform(counted).drop("_words", "_tf")


def embed(df: DataFrame, text: str, model: Callable[[pd.Series], list], out: str = "embedding") -> DataFrame:
    """Vectors from a model of the caller's, one call per Arrow batch on the executors."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: list(model(batch[text]))})

    return df.mapInPandas(run, f"{schema}, `{out}` array<float>")
