"""Band and interval joins as equi joins on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import micros
from .bounded import broadcast_if_small


def band_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join on low <= value < high.

    Each band is listed under the buckets of `width` it touches, each left row under its
    one bucket, so the join is a hash join and compares within a bucket only.
    """
    buckets = F.sequence(
        F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long")
    )
    bands = right.filter(F.col(high) > F.col(low)).withColumn("_bucket", F.explode(buckets))
    placed = left.withColumn("_bucket", F.floor(F.col(value) / width).cast("long"))
    inside = (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))
    return placed.join(broadcast_if_small(bands), "_bucket").filter(inside).drop("_bucket")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_at: str,
    right_at: str,
    within_seconds: int,
    how: str = "left",
) -> DataFrame:
    """Join equal keys with left_at <= right_at <= left_at + within.

    The time bucket joins the key in the equi condition: a hot key is spread over its time
    range, and rows far apart in time never meet. Column names of both sides must differ.
    """
    span = within_seconds * 1_000_000
    width = max(span, 1)
    slot = F.floor(micros(left_at) / width)
    # A left row at a slot's start reaches the end of that slot and, at most, the next one.
    reach = left.withColumn("_slot", slot)
    near = right.withColumn("_t", micros(right_at)).withColumn(
        "_slot_r", F.explode(F.array(F.floor(F.col("_t") / width), F.floor(F.col("_t") / width) - 1))
    )
    cond = (
        (F.col(left_key) == F.col(right_key))
        & (F.col("_slot") == F.col("_slot_r"))
        & (F.col("_t") >= micros(left_at))
        & (F.col("_t") <= micros(left_at) + span)
    )
    return reach.join(near, cond, how).drop("_slot", "_slot_r", "_t")
