"""Ordered per-key jobs on streams: each micro-batch runs the batch operator on what is open.

A sequential rule (close a batch after a gap, find the next burst) needs the rows of a key
in time order. Instead of buffering a key in one task's state, each trigger runs the
skew-safe batch operator on the rows carried over plus the new ones, emits what the
watermark has made final and carries on only what is still open. Carry, result and
watermark are stored per batch id, so a replayed batch overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed as fx
from ..functions.columns import micros
from ..operators.bursts import burst_match
from ..operators.events import batch_files, batch_totals
from ..sinks.tables import read_table
from .run import each_batch

Step = Callable[[DataFrame, datetime], tuple[DataFrame, DataFrame]]


def run_with_carry(df: DataFrame, at: str, delay: str, label: str, step: Step) -> DataFrame:
    """Run `step(rows, watermark) -> (final results, rows to carry)` on every micro-batch.

    The watermark is the latest time seen minus `delay`; rows before it are late and dropped.
    """
    fields = df.schema

    def write(batch: DataFrame, batch_id: int, out: str) -> None:
        session = batch.sparkSession
        rows, before = batch, None
        if batch_id > 0:
            last = session.read.schema("peak timestamp").parquet(f"{out}/peak/batch={batch_id - 1}")
            before = last.first()[0]
            if before is not None:
                limit = F.lit(before) - F.expr(f"INTERVAL {delay}")
                rows = rows.filter(F.col(at) >= limit)
            rows = rows.unionByName(session.read.schema(fields).parquet(f"{out}/carry/batch={batch_id - 1}"))
        peak = batch.agg(F.greatest(F.max(at), F.lit(before).cast("timestamp")).alias("peak"))
        peak.write.mode("overwrite").parquet(f"{out}/peak/batch={batch_id}")
        peak = session.read.schema("peak timestamp").parquet(f"{out}/peak/batch={batch_id}")
        watermark = peak.select(F.col("peak") - F.expr(f"INTERVAL {delay}")).first()[0]
        rows = rows.filter(F.col(at).isNotNull()).persist()
        try:
            done, carry = step(rows, watermark)
            done.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
            carry.select(*fields.fieldNames()).write.mode("overwrite").parquet(
                f"{out}/carry/batch={batch_id}"
            )
        finally:
            rows.unpersist()

    out = each_batch(df, label, write)
    return read_table(df.sparkSession, f"{out}/rows").drop("batch")


def batch_stream(
    df: DataFrame,
    keys: list[str],
    at: str,
    size: str,
    ties: list[str],
    label: str = "batches",
    delay: str = "0 seconds",
    max_files: int = fx.BATCH_FILES,
    timeout_seconds: int = fx.BATCH_TIMEOUT_SECONDS,
) -> DataFrame:
    """Ingest batches that are full or whose timeout the watermark has passed."""

    def step(rows: DataFrame, watermark: datetime) -> tuple[DataFrame, DataFrame]:
        numbered = batch_files(rows, keys, at, size, ties, max_files, timeout_seconds)
        totals = batch_totals(numbered, keys, at, size)
        quiet = micros("last_at") + timeout_seconds * 1_000_000 <= micros(F.lit(watermark))
        # A full batch may still change its files until the watermark has passed its last one.
        full = (F.col("file_count") >= max_files) & (micros("last_at") <= micros(F.lit(watermark)))
        still_open = totals.filter(~(quiet | full)).select(*keys, "batch_start")
        cond = F.col("a.batch_start") == F.col("b.batch_start")
        for key in keys:
            cond = cond & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
        carry = numbered.alias("a").join(still_open.alias("b"), cond, "left_semi")
        return totals.filter(quiet | full).drop("batch_start"), carry.drop("batch_start")

    return run_with_carry(df, at, delay, label, step)


def burst_stream(
    df: DataFrame,
    keys: list[str],
    at: str,
    ties: list[str],
    label: str = "bursts",
    delay: str = "0 seconds",
    min_events: int = 3,
    span_seconds: int = 600,
) -> DataFrame:
    """Bursts whose time span the watermark has passed."""

    def step(rows: DataFrame, watermark: datetime) -> tuple[DataFrame, DataFrame]:
        found = burst_match(rows, keys, at, ties, min_events, span_seconds)
        moment = micros(F.lit(watermark))
        span = span_seconds * 1_000_000
        final = found.filter(micros("first_at") + span <= moment)
        # Behind its last final burst, a row counts as long as its own span is still open.
        used = final.groupBy(*keys).agg(F.max(micros("last_at")).alias("_used"))
        cond = F.lit(True)
        for key in keys:
            cond = cond & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
        live = rows.filter(micros(at) + span > moment)
        carry = (
            live.alias("a")
            .join(used.alias("b"), cond, "left")
            .filter(F.col("_used").isNull() | (micros(at) > F.col("_used")))
            .select("a.*")
        )
        return final, carry

    return run_with_carry(df, at, delay, label, step)
