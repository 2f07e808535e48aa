"""Places of rows in the order of their group, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .bounded import broadcast_if_small


def in_order(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows dealt by ranges of (group, order, where they come from) and sorted so; nulls come first.

    A group of a third of all rows, or as many equal rows, spreads over tasks.
    """
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order, F.col("_from")]
    spread = df.withColumn("_from", F.monotonically_increasing_id())
    return spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_from")


def placed(rows: DataFrame, group: list[str], weight: str | None = None) -> DataFrame:
    """`rows` in order, written with their place `_at`, get `idx` (place in the group) and `n` (rows of it).

    With `weight`, a column of weights, also `before`, the weights of the earlier partitions, and
    `total`. A row per group and partition gives the offsets; a group has one for each task at most.
    """
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    sums = [F.sum(weight).alias("_w")] if weight else []
    parts = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), *sums)
    of = Window.partitionBy(*group)
    earlier = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    columns = {
        "_base": F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"),
        "n": F.sum("_n").over(of),
    }
    if weight:
        columns |= {"before": F.coalesce(F.sum("_w").over(earlier), F.lit(0)), "total": F.sum("_w").over(of)}
    at = parts.withColumns(columns).drop("_n", "_first", "_w").withColumnsRenamed({g: f"_g_{g}" for g in group})
    at = settle(at.withColumnRenamed("_part", "_p"), "offsets")
    on = F.col("_part") == F.col("_p")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = rows.join(broadcast_if_small(at), on)
    return joined.withColumn("idx", F.col("_at") + F.col("_base")).drop("_p", "_part", "_base", "_at", *(f"_g_{g}" for g in group))


def ranked(df: DataFrame, group: list[str], order: list[Column], label: str) -> DataFrame:
    """`df` with `idx`, a row's place in its group from 0 by `order`, and `n`, the rows of its group."""
    rows = in_order(df, group, order).withColumn("_at", F.monotonically_increasing_id())
    return placed(settle(rows, label), group)
