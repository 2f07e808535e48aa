"""Burst detection: at least `min_events` events of a key within a time span.

A match starts at an event and takes every event less than `span` after it; with enough
events it is reported and the search goes on behind its last event, otherwise it starts
again at the next event. Matches are greedy and never overlap.

The plan finds for every event, in parallel, the end of the match it would open. Only
events that can open one remain, and picking the non-overlapping ones is a single pass
with one number of state over each sorted partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import micros
from ..session import settle
from .bounded import broadcast_if_small
from .ordered import ROWS_PER_SLICE, SLICE, Ordered, _as_side, _on_keys, order_by_key

MAX_CHOICE_SLICES = 256

_POS, _END, _END_AT, _REACH = "_pos", "_end", "_end_at", "_reach"


def _asked(rows: Ordered, span_us: int) -> DataFrame:
    """Every event twice: as itself, and as a probe one span later.

    A probe asks for the latest event before its moment, so it sorts in front of events of
    equal time. Two sorted passes answer all probes, however many events a span holds; a
    sliding range frame would go through the span again for every row.
    """
    rows = rows.position(_POS)
    moments = F.array(
        F.struct(F.col(rows.at).alias("t"), F.lit(1).alias("side")),
        F.struct((F.col(rows.at) + span_us).alias("t"), F.lit(0).alias("side")),
    )
    return rows.df.select("*", F.inline(moments).alias("_t", "_side"))


def _openers(rows: Ordered, span_us: int) -> DataFrame:
    """Every event with the position and time of the last event less than `span_us` after it."""
    upto = Window.partitionBy(*rows.keys, SLICE).orderBy("_t", "_side", _POS)
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lambda c: F.max(F.when(F.col("_side") == 1, F.col(c))).over(upto)
    found = _asked(rows, span_us).withColumn(_END, seen(_POS)).withColumn(_END_AT, seen(rows.at))
    return found.filter(F.col("_side") == 0).drop("_t", "_side")


def _openers_across_slices(rows: Ordered, span_us: int, rows_per_slice: int) -> DataFrame:
    """The same for hot keys: events and probes are sliced together by their moments."""
    both = _asked(rows, span_us).withColumnRenamed(SLICE, "_home")
    event = F.when(F.col("_side") == 1, F.struct(F.col(_POS).alias("pos"), F.col(rows.at).alias("at")))
    ordered = order_by_key(both, rows.keys, "_t", ("_side", _POS), rows_per_slice)
    found = ordered.fill_forward(event, "_last").result().filter(F.col("_side") == 0)
    return (
        found.withColumn(_END, F.col("_last.pos"))
        .withColumn(_END_AT, F.col("_last.at"))
        .drop("_t", "_side", "_last")
        .withColumnRenamed("_home", SLICE)
    )


def _pick(keys: list[str]):
    """First opener whose position lies behind everything taken before it, repeatedly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, reach = None, -1
        for batch in batches:
            taken = []
            columns = [batch.column(c).to_pylist() for c in [*keys, SLICE, _POS, _END, _REACH]]
            for i, row in enumerate(zip(*columns)):
                if row[:-3] != group:
                    group, reach = row[:-3], row[-1]
                if row[-3] > reach:
                    taken.append(i)
                    reach = row[-2]
            yield batch.take(pa.array(taken, pa.int64()))

    return run


def _choose(openers: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy choice within each (key, slice), given what earlier slices already cover."""
    ready = openers.repartition(*keys, SLICE).sortWithinPartitions(*keys, SLICE, _POS)
    return ready.mapInArrow(_pick(keys), ready.schema)


def burst_match(
    df: DataFrame,
    keys: list[str],
    at: str,
    ties: list[str],
    min_events: int = 3,
    span_seconds: int = 600,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """(keys, first_at, last_at, n) per match; times as timestamps without zone."""
    rows = df.select(*keys, micros(at).alias("_at"), *ties)
    rows = rows.filter(F.col("_at").isNotNull())
    ordered = order_by_key(rows, keys, "_at", ties, rows_per_slice)
    span_us = span_seconds * 1_000_000

    def enough(openers: DataFrame) -> DataFrame:
        counted = openers.withColumn("_n", F.col(_END) - F.col(_POS) + 1)
        return counted.filter(F.col("_n") >= min_events).select(*keys, SLICE, "_at", _POS, _END, _END_AT, "_n")

    def choose_cold(cold: Ordered) -> DataFrame:
        return _choose(enough(_openers(cold, span_us)).withColumn(_REACH, F.lit(-1).cast("long")), keys)

    if ordered.hot is None:
        chosen = choose_cold(ordered)
    else:
        side = broadcast_if_small(_as_side(ordered.hot.select(*keys), keys))
        cold = ordered.df.join(side, _on_keys(keys), "left_anti")
        hot = ordered.with_df(ordered.df.join(side, _on_keys(keys), "left_semi"))
        openers = settle(enough(_openers_across_slices(hot, span_us, rows_per_slice)), "openers")
        chosen = choose_cold(Ordered(cold, keys, "_at", tuple(ties), None)).unionByName(
            _choose_across_slices(openers, keys)
        )
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return chosen.select(
        *keys,
        moment("_at").alias("first_at"),
        moment(_END_AT).alias("last_at"),
        F.col("_n").alias("n"),
    )


def _choose_across_slices(openers: DataFrame, group: list[str]) -> DataFrame:
    """Slices choose in parallel, then learn how far the slices before them reach, until stable.

    Once the reach entering every slice no longer changes, the choice equals that of one
    pass over the whole key: the first slice is right from the start and each round makes
    at least one more slice final.
    """
    before = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    reach_of = lambda chosen, slices: (
        slices.join(
            _renamed(chosen.groupBy(*group, SLICE).agg(F.max(_END).alias("_far")), group),
            _on_keys([*group, SLICE]),
            "left",
        ).select(*group, SLICE, F.coalesce(F.max("_far").over(before), F.lit(-1)).alias(_REACH))
    )
    openers = _coarser(openers, group)
    slices = settle(openers.select(*group, SLICE).distinct(), "slices")
    reach = settle(slices.withColumn(_REACH, F.lit(-1).cast("long")), "reach")
    while True:
        side = _renamed(reach, group)
        entering = openers.join(broadcast_if_small(side), _on_keys([*group, SLICE]), "left")
        chosen = _choose(entering.drop(*[f"_k_{c}" for c in [*group, SLICE]]), group)
        after = settle(reach_of(chosen, slices), "reach")
        if after.exceptAll(reach).isEmpty():
            return chosen
        reach = after


def _coarser(openers: DataFrame, group: list[str]) -> DataFrame:
    """Join neighbouring slices so that a key has at most MAX_CHOICE_SLICES.

    A choosing task needs no memory, and fewer slices mean fewer rounds in the worst case.
    """
    tops = openers.groupBy(*group).agg((F.max(SLICE) + 1).alias("_top"))
    side = _as_side(settle(tops, "tops"), group)
    joined = openers.join(broadcast_if_small(side), _on_keys(group))
    whole = F.floor(F.col(SLICE) * MAX_CHOICE_SLICES / F.col("_top"))
    merged = F.when(F.col("_top") > MAX_CHOICE_SLICES, whole).otherwise(F.col(SLICE))
    return joined.withColumn(SLICE, merged).drop("_top", *[f"_k_{k}" for k in group])


def _renamed(df: DataFrame, group: list[str]) -> DataFrame:
    return _as_side(df, [*group, SLICE])
