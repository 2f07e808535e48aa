"""Windows, joins, de-duplication and side outputs on streams.

Event times are `timestamp` columns; every stateful step is bounded by a watermark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..sinks.tables import read_table
from .run import each_batch


def tumbling_window(df: DataFrame, at: str, keys: list[str], size: str, aggs: list[Column], delay: str) -> DataFrame:
    """Aggregates per key and window; appended once the watermark passes the window."""
    return sliding_window(df, at, keys, size, size, aggs, delay)


def sliding_window(
    df: DataFrame, at: str, keys: list[str], size: str, slide: str, aggs: list[Column], delay: str
) -> DataFrame:
    grouped = df.withWatermark(at, delay).groupBy(*keys, F.window(at, size, slide).alias("_w")).agg(*aggs)
    return _flat(grouped)


def session_window(df: DataFrame, at: str, keys: list[str], gap: str, aggs: list[Column], delay: str) -> DataFrame:
    """Aggregates per key and session; a session ends after `gap` without a row."""
    grouped = df.withWatermark(at, delay).groupBy(*keys, F.session_window(at, gap).alias("_w")).agg(*aggs)
    return _flat(grouped)


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "_w"]
    return df.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *rest)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_at: str,
    right_at: str,
    within: str,
    left_delay: str,
    right_delay: str,
    how: str = "leftOuter",
) -> DataFrame:
    """Rows of equal keys with left_at <= right_at <= left_at + within.

    Both watermarks and the time bound limit the state; an unmatched left row comes out
    with NULLs once no partner can arrive any more.
    """
    bound = F.expr(f"INTERVAL {within}")
    cond = (
        (F.col(left_key) == F.col(right_key))
        & (F.col(right_at) >= F.col(left_at))
        & (F.col(right_at) <= F.col(left_at) + bound)
    )
    return left.withWatermark(left_at, left_delay).join(right.withWatermark(right_at, right_delay), cond, how)


@dataclass(frozen=True)
class Leg:
    """A stream that joins a chain: its key, its time, how long after the first stream's row it may come, its delay."""

    df: DataFrame
    key: str
    at: str
    within: str
    delay: str


def interval_chain(first: DataFrame, key: str, at: str, delay: str, legs: list[Leg], how: str = "inner") -> DataFrame:
    """The first stream joined with any number of others, each within a time after the first one's row.

    The joins are chained. Every leg is bounded by the first stream's time, which stays the event time of what a join
    hands on, so that each join drops from its state what its own time bound has passed, by the watermark that the join
    before it lets through. With `leftOuter` a row without a partner comes out with NULLs once none can arrive.
    """
    out = first.withWatermark(at, delay)
    for leg in legs:
        on_time = F.col(leg.at).between(F.col(at), F.col(at) + F.expr(f"INTERVAL {leg.within}"))
        other = leg.df.withWatermark(leg.at, leg.delay)
        joined = out.join(other, (F.col(key) == F.col(leg.key)) & on_time, how).drop(leg.key)
        # A plain value from here on: the next join follows one event time.
        out = joined.withColumn(leg.at, F.timestamp_micros(F.unix_micros(leg.at)))
    return out


def deduplicate(df: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """First row per key; a replay is recognised within the watermark delay."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def split_late(df: DataFrame, at: str, delay: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) as tables.

    A row is late when its time lies before the latest time of all earlier micro-batches
    minus `delay`. The latest time of each batch is kept next to the rows it wrote.
    """
    spark = df.sparkSession
    peak_schema = "peak timestamp"

    def write(batch: DataFrame, batch_id: int, out: str) -> None:
        session = batch.sparkSession
        seen = None
        if batch_id > 0:
            seen = session.read.schema(peak_schema).parquet(f"{out}/peak/batch={batch_id - 1}").first()[0]
        limit = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(at) < limit, F.lit(False))
        marked = batch.withColumn("_late", late)
        marked.write.mode("overwrite").partitionBy("_late").parquet(f"{out}/rows/batch={batch_id}")
        # The peak is cumulative, so the next batch needs this one row only.
        top = batch.agg(F.greatest(F.max(at), F.lit(seen).cast("timestamp")).alias("peak"))
        top.write.mode("overwrite").parquet(f"{out}/peak/batch={batch_id}")

    out = each_batch(df, label, write)
    rows = read_table(spark, f"{out}/rows")
    rows = rows.select(*df.columns, F.col("_late").cast("boolean").alias("_late"))
    return rows.filter(~F.col("_late")).drop("_late"), rows.filter("_late").drop("_late")


def deliver(df: DataFrame, label: str, subscriber: str = "subscriber") -> str:
    """Write a fanned-out stream to one folder per subscriber."""

    def write(batch: DataFrame, batch_id: int, out: str) -> None:
        batch.write.mode("overwrite").partitionBy(subscriber).parquet(f"{out}/rows/batch={batch_id}")

    return each_batch(df, label, write) + "/rows"


def topic_window(df: DataFrame, topic: str, value: str, size: str = "1 minute") -> DataFrame:
    """Count, sum and mean per topic over processing-time windows."""
    now = df.withColumn("_now", F.current_timestamp())
    return _flat(
        now.withWatermark("_now", "0 seconds")
        .groupBy(topic, F.window("_now", size).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(value).alias("total"),
            F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        )
    )
