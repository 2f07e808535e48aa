"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Documents that are toxic go, then copies, near copies and documents with benchmark passages; what is
left is packed into sequences. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.decontaminate import remove_documents
from lakeloom.llm.exact_dedup import deduplicate
from lakeloom.llm.minhash_dedup import remove_near_duplicates
from lakeloom.llm.packing import pack
from lakeloom.llm.toxicity import learn, remove_toxic
from lakeloom.session import prepare, settle
from lakeloom.sources.tables import Tables

TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled rows of `docs`."""
    return remove_toxic(docs, learn(docs, Tables(prepare(spark), sf_dir).labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles."""
    prepare(spark)
    return remove_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return remove_documents(docs, Tables(prepare(spark), sf_dir).benchmark)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in sequences of 2048 tokens."""
    prepare(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER), limit=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages learn, hash and plan, which SQL does not express; the tests rebuild the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    out = Tables(prepare(spark), sf_dir).documents
    for name, stage in STAGES[:-1]:
        out = settle(stage(spark, out, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, out, sf_dir)
