"""Event rules, trigger fan-out, ingest batching and routing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as fx
from ..functions.columns import micros
from .ordered import ROWS_PER_SLICE, order_by_key


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for part in parts:
        out = out & part
    return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class NotificationRule:
    """Every given condition must hold; a rule without event types takes all of them."""

    name: str
    events: tuple[str, ...] = ()
    prefix: str | None = None
    suffix: str | None = None
    regex: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)

    def condition(self) -> Column:
        event, key = F.col("event_name"), F.col("key")
        parts = []
        if self.events:
            names = [
                event.startswith(e[:-1]) if e.endswith("*") else event == e for e in self.events
            ]
            any_of = names[0]
            for name in names[1:]:
                any_of = any_of | name
            parts.append(any_of)
        if self.prefix is not None:
            parts.append(key.startswith(self.prefix))
        if self.suffix is not None:
            parts.append(key.endswith(self.suffix))
        if self.regex is not None:
            parts.append(key.rlike(self.regex))
        parts += [F.col("metadata")[k] == v for k, v in self.metadata.items()]
        parts += [F.col("tags")[k] == v for k, v in self.tags.items()]
        return _all(parts)


def match_notifications(objects: DataFrame, rules: list[NotificationRule]) -> DataFrame:
    """One row per (object event, matching rule), with the rule's name in `rule`.

    The rules are a short configured list, so they become one projection: no join,
    no shuffle.
    """
    hits = F.array_compact(F.array(*[F.when(r.condition(), F.lit(r.name)) for r in rules]))
    return objects.withColumn("rule", F.explode(hits))


@dataclass(frozen=True)
class Trigger:
    """Attributes an event must carry; NULL or absent means any."""

    subscriber: str
    type: str | None = None
    source: str | None = None
    extensions: dict[str, str] = field(default_factory=dict)

    def condition(self) -> Column:
        parts = []
        if self.type is not None:
            parts.append(F.col("type") == self.type)
        if self.source is not None:
            parts.append(F.col("source") == self.source)
        parts += [F.col("extensions")[k] == v for k, v in self.extensions.items()]
        return _all(parts)


def fan_out(events: DataFrame, triggers: list[Trigger]) -> DataFrame:
    """Each event once per matching trigger, with the receiver in `subscriber`."""
    hits = F.array_compact(F.array(*[F.when(t.condition(), F.lit(t.subscriber)) for t in triggers]))
    return events.withColumn("subscriber", F.explode(hits))


def route(
    batches: DataFrame,
    light_bytes: int = fx.LIGHT_BYTES,
    light_files: int = fx.LIGHT_FILES,
) -> DataFrame:
    """`route` is light below the byte limit and up to the file limit, else heavy."""
    light = (F.col("total_bytes") < light_bytes) & (F.col("file_count") <= light_files)
    return batches.withColumn("route", F.when(light, F.lit("light")).otherwise(F.lit("heavy")))


def batch_files(
    files: DataFrame,
    keys: list[str],
    at: str,
    size: str,
    ties: list[str],
    max_files: int = fx.BATCH_FILES,
    timeout_seconds: int = fx.BATCH_TIMEOUT_SECONDS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Number the ingest batches of each key: `batch_start` (position of the batch's first file).

    A batch closes after `max_files` files or when no file arrives for `timeout_seconds`.
    """
    rows = order_by_key(files.withColumn("_at", micros(at)), keys, "_at", ties, rows_per_slice)
    rows = rows.position("_pos").lag("_at", "_prev")
    opens = F.col("_prev").isNull() | (F.col("_at") - F.col("_prev") >= timeout_seconds * 1_000_000)
    rows = rows.fill_forward(F.when(opens, F.col("_pos")), "_run")
    in_run = F.col("_pos") - F.col("_run")
    start = F.col("_run") + F.floor(in_run / max_files) * max_files
    return rows.result().withColumn("batch_start", start).drop("_at", "_pos", "_prev", "_run")


def batch_totals(batched: DataFrame, keys: list[str], at: str, size: str) -> DataFrame:
    """One row per batch with its time span, file count and bytes."""
    return batched.groupBy(*keys, "batch_start").agg(
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.count(F.lit(1)).alias("file_count"),
        F.sum(size).alias("total_bytes"),
    )


def batch_files_by_size(
    files: DataFrame,
    keys: list[str],
    at: str,
    size: str,
    ties: list[str],
    target_bytes: int,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The other closing rule: a batch ends once the running bytes pass the next multiple of the target."""
    rows = order_by_key(files.withColumn("_at", micros(at)), keys, "_at", ties, rows_per_slice)
    rows = rows.running_sum(size, "_upto")
    before = F.col("_upto") - F.coalesce(F.col(size), F.lit(0))
    batch = F.floor(before / target_bytes)
    return rows.result().withColumn("batch_no", batch).drop("_at", "_upto")


def sessionize(
    df: DataFrame,
    keys: list[str],
    at: str,
    ties: list[str],
    gap_seconds: int,
    aggs: list[Column],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Aggregates per key and session; rows at most `gap_seconds` apart share one.

    Equals grouping by Spark's session window, but a hot key is processed in slices and
    its sessions are pre-aggregated before the shuffle.
    """
    rows = df.filter(F.col(at).isNotNull()).withColumn("_at", micros(at))
    ordered = order_by_key(rows, keys, "_at", ties, rows_per_slice).lag("_at", "_prev")
    opens = F.col("_prev").isNull() | (F.col("_at") - F.col("_prev") > gap_seconds * 1_000_000)
    named = ordered.fill_forward(F.when(opens, F.col("_at")), "_session").result()
    return (
        named.groupBy(*keys, "_session")
        .agg(
            F.min(at).alias("window_start"),
            (F.max(at) + F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("window_end"),
            *aggs,
        )
        .drop("_session")
    )
