"""Labelled examples for the classifiers."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from .common import slim

#: Labelled rows a model is trained on at most, the longest text among them, and the characters of all of them.
MAX_EXAMPLES = 6000
LONGEST = 200_000
MAX_CHARACTERS = 24_000_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def held_out(doc_id: Column, modulus: int, value: int) -> Column:
    """Whether a row's label must not be learned from; a null id has no fold and counts as held out."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(True))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    modulus: int,
    value: int,
    limit: int = MAX_EXAMPLES,
    longest: int = LONGEST,
    most: int = MAX_CHARACTERS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, text, label): at most `limit` whole texts of `most` characters in all, none held out, chosen by a hash
    of the id.

    Rows without a label or an id, and texts over `longest` characters, are not learned from.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .filter(~held_out(F.col("doc_id"), modulus, value))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(limit)
    )
    texts = slim(docs, id_col, text_col).filter(F.length("text") <= longest)
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("size", F.length("text"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("size"), F.xxhash64("text"), F.col("label")]
    sizes = [r["size"] for r in rows.select("doc_id", "size", "label", "text").orderBy(*order).limit(limit).select("size").collect()]
    fits = sum(total <= most for total in accumulate(sizes))
    return rows.orderBy(*order).limit(fits).select("doc_id", "text", "label")


def examples(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, value: int, limit: int = MAX_EXAMPLES, **how: object) -> list[tuple[str, int]]:
    """The texts and labels of `sample`, whose bounds make them fit the driver."""
    rows = sample(docs, labels, label_col, modulus, value, limit, **how)
    return [(r["text"], r["label"]) for r in rows.select("text", "label").collect()]
