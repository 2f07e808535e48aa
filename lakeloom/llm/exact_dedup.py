"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical after white space (space, tab to carriage return) is
deleted. Equal texts are combined in three steps, each of which compares the whole normalised text
next to its digest: inside a task (the partial aggregate in front of the shuffle), among the rows of
one digest and salt, and among the winners of the salts. A text that fills a third of the table so
reaches any task as one row per task before it. The documents then find their group by the digest;
groups of more than a thousandth of the rows, of which there are at most a thousand, are broadcast,
so no task gathers the members of one.

Null text counts as empty and all empty texts are equal. Of equal texts the one with the most code
points stays, then the smallest doc_id, a null doc_id last. Rows that repeat both doc_id and text
all count in group_size, and one of them is kept. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .common import slim

SPACE = " \t\n\x0b\x0c\r"
#: Salts of a digest.
SALTS = 16
#: A group of more than one in so many rows is hot, so there are fewer hot groups than this.
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = lambda sha: sha,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    `digest` may shorten the digest; the result does not depend on it.
    """
    base = (
        slim(docs, id_col, text_col)
        .select("doc_id", F.length("text").alias("size"), normalised(F.col("text")).alias("plain"))
        .withColumn("sha", F.unhex(F.sha2("plain", 256)))
        .withColumn("digest", digest(F.col("sha")))
    )
    salted = (
        base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "plain", "size")
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    )
    # One exchange by the digest serves both aggregates and the window.
    groups = (
        salted.repartition("digest")
        .groupBy("digest", "plain", "size")
        .agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n"))
        .groupBy("digest", "plain")
        .agg(F.max_by("doc_id", "size").alias("keep_id"), F.max("size").alias("keep_size"), F.sum("n").alias("group_size"))
        .withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("digest")))
    )
    winners = settle(groups.withColumn("plain", F.when(F.col("texts") > 1, F.col("plain"))), "exact-groups")
    members = base.select("doc_id", "size", "sha", "digest")
    found = of_group(members, winners.filter("texts = 1").drop("plain", "texts"))
    mixed = winners.filter("texts > 1").drop("texts")
    if not mixed.isEmpty():  # different texts of one digest: their members are told apart by the text
        found = found.unionByName(
            base.join(mixed, ["digest", "plain"]).drop("plain").withColumn("key", F.col("digest"))
        )
    repeat = F.row_number().over(Window.partitionBy("key", "digest", "doc_id", "size").orderBy("size"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size")) & (repeat == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def of_group(members: DataFrame, winners: DataFrame) -> DataFrame:
    """Each member with its group; the few groups that can be hot meet theirs without a shuffle."""
    total = winners.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = winners.filter(F.col("group_size") * HOT_SHARE > total)
    values = ["keep_id", "keep_size", "group_size"]
    first = members.join(
        F.broadcast(hot.select("digest", *(F.col(v).alias(f"hot_{v}") for v in values))), "digest", "left"
    )
    is_hot = F.col("hot_group_size").isNotNull()
    # A row that has its group takes a key of its own, which meets nothing and spreads evenly.
    first = first.withColumn(
        "key", F.when(is_hot, F.encode(F.concat(F.lit("own-"), F.xxhash64("doc_id", "size").cast("string")), "utf-8")).otherwise(F.col("digest"))
    )
    cold = winners.filter(F.col("group_size") * HOT_SHARE <= total).withColumnRenamed("digest", "key")
    both = first.join(cold, "key", "left")
    either = [F.when(is_hot, F.col(f"hot_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    return both.filter(is_hot | F.col("group_size").isNotNull()).select("doc_id", "size", "sha", "digest", "key", *either)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that are not kept; the columns stay as they are."""
    drop = settle(
        exact_groups(docs, id_col, text_col)
        .groupBy("doc_id", "text_sha256")
        .agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows"))
        .filter("not _kept or _rows > 1")
        .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "_kept"),
        "exact-drop",
    )
    text = normalised(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.sha2(text, 256) == F.col("_sha"))
    rest = docs.join(drop, same, "left_anti")
    repeats = drop.filter("_kept")
    if repeats.isEmpty():
        return rest
    # Rows that repeat a kept document: the longest of the equal texts stays, once.
    rows = docs.join(repeats, same).withColumn("_size", F.length(F.coalesce(F.col(text_col), F.lit(""))))
    once = Window.partitionBy("_id", "_sha").orderBy(F.desc("_size"))
    return rest.unionByName(rows.withColumn("_once", F.row_number().over(once)).filter("_once = 1").select(*docs.columns))
