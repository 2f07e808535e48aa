"""Broadcast only what has been measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when `df` has at most `max_rows` rows, else leave the plain shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


class TooLarge(ValueError):
    """A driver-side list would exceed its stated bound."""


def collect_bounded(df: DataFrame, max_rows: int) -> list:
    """Rows of a frame that is small by contract (metadata, per-dimension ranges, ...)."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooLarge(f"more than {max_rows} rows")
    return rows


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan with fewer partitions than cores before work that is heavy per row.

    A large input has more partitions than cores and is left alone, so at scale this adds
    no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
