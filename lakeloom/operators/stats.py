"""Profiles, percentiles, leaderboards, latest values, late rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .bounded import broadcast_if_small
from .ordered import _as_side, _on_keys


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, rows): NULLs per column in one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"_n{i}") for i, c in enumerate(df.columns)],
    )
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("nulls"))
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.explode(F.array(*pairs)).alias("p"), "_rows").select(
        "p.column", "p.nulls", F.col("_rows").alias("rows")
    )


#: Rows of a key whose values are sorted by one task, and cells that the values of a larger key are counted in.
ROWS_PER_SORT, CELLS = 1_000_000, 4096


def percentiles(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], most: int = ROWS_PER_SORT, cells: int = CELLS
) -> DataFrame:
    """Exact percentiles per key: the smallest value that at least the share `p` of rows does not exceed.

    A key of up to `most` rows has its distinct values counted and sorted. A larger one is never sorted as a
    whole: its values are counted in cells, which combines inside the tasks, and only the cells that hold a
    percentile are looked into, again by cells while they have more rows than that.
    """
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sizes = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.filter(F.col("n") > most)
    if hot.isEmpty():
        return _by_sorting(present, keys, points)
    hot = settle(hot, "hot-percentiles")
    side = broadcast_if_small(_as_side(hot.select(*keys), keys))
    cold = present.join(side, _on_keys(keys), "left_anti")
    rows = present.join(side, _on_keys(keys), "left_semi")
    return _by_sorting(cold, keys, points).unionByName(_by_selection(rows, hot, keys, points, most, cells))


def _by_sorting(present: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    counted = present.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_all", F.sum("_c").over(per_key))
    found = [F.min(F.when(F.col("_upto") >= F.lit(p) * F.col("_all"), F.col("_v"))).alias(name) for name, p in points.items()]
    return ranked.groupBy(*keys).agg(F.sum("_c").alias("n"), *found)


def _scale(x: Column) -> Column:
    """A scale on which the cells of an area are of equal width: logarithmic on both sides of zero, and linear where
    the area spans no more than a factor of four. Larger values have no smaller place on it."""
    narrow = ((F.col("_lo") > 0) & (F.col("_hi") <= 4 * F.col("_lo"))) | ((F.col("_hi") < 0) & (F.col("_lo") >= 4 * F.col("_hi")))
    # The least positive double has a logarithm above -746. Halves, whose differences can't overflow.
    return F.when(narrow, x / 2).when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 746))


def _cell(v: Column, cells: int) -> Column:
    """The cell of a value between _lo and _hi; infinities and NaN have cells of their own."""
    x = v.cast("double")
    low, width = _scale(F.col("_lo")), _scale(F.col("_hi")) - _scale(F.col("_lo"))
    inside = F.when(width > 0, F.least(F.floor((_scale(x) - low) / width * cells), F.lit(cells - 1))).otherwise(0)
    return F.when(F.isnan(x), cells + 1).when(x == float("inf"), cells).when(x == -float("inf"), -1).otherwise(inside).cast("long")


def _span(v: Column) -> list[Column]:
    """Least and greatest finite value, as the bounds of the cells."""
    x = v.cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return [F.coalesce(F.min(finite), F.lit(0.0)).alias("_lo"), F.coalesce(F.max(finite), F.lit(0.0)).alias("_hi")]


def _by_selection(rows: DataFrame, hot: DataFrame, keys: list[str], points: dict[str, float], most: int, cells: int) -> DataFrame:
    """Percentiles of keys of many rows. An area is a range of a key's values; at first it has them all."""
    area = [*keys, "_area"]
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), F.ceil(F.lit(p) * F.col("n")).alias("rank")) for name, p in points.items()))
    targets = hot.select(*keys, F.lit("").alias("_area"), F.inline(ranks).alias("_name", "_rank"))
    targets = settle(targets.withColumn("_rank", F.greatest("_rank", F.lit(1))), "percentile-ranks")
    rows = rows.withColumn("_area", F.lit(""))
    while True:
        spans = settle(rows.groupBy(*area).agg(F.count(F.lit(1)).alias("_n"), *_span(F.col("_v"))), "percentile-spans")
        wide = spans.filter((F.col("_n") > most) & (F.col("_hi") > F.col("_lo")))
        if wide.isEmpty():
            break
        placed = rows.join(broadcast_if_small(_as_side(spans, area)), _on_keys(area)).drop(*(f"_k_{c}" for c in area))
        # An area that is small enough stays as it is, in one cell.
        open_ = (F.col("_n") > most) & (F.col("_hi") > F.col("_lo"))
        placed = placed.withColumn("_cell", F.when(open_, _cell(F.col("_v"), cells)).otherwise(F.lit(0).cast("long")))
        counted = settle(placed.groupBy(*area, "_cell").agg(F.count(F.lit(1)).alias("_c")), "percentile-cells")
        # At most `cells` and three rows of an area.
        upto = Window.partitionBy(*area).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = _as_side(counted.withColumn("_upto", F.sum("_c").over(upto)), area)
        inside = _on_keys(area) & (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c"))
        below = F.col("_upto") - F.col("_c")
        name = F.concat("_area", F.lit("/"), "_cell")
        found = targets.join(summed, inside).select(*area, "_cell", "_name", (F.col("_rank") - below).alias("_rank"))
        found = settle(found, "percentile-targets")
        wanted = _as_side(found.select(*area, "_cell").distinct(), [*area, "_cell"])
        rows = placed.join(broadcast_if_small(wanted), _on_keys([*area, "_cell"]), "left_semi")
        rows = settle(rows.select(*keys, "_v", name.alias("_area")), "percentile-rows")
        targets = found.select(*keys, name.alias("_area"), "_name", "_rank")
    values = rows.groupBy(*area, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*area).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = _as_side(values.withColumn("_upto", F.sum("_c").over(upto)), area)
    inside = _on_keys(area) & (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c"))
    each = targets.join(summed, inside).groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in points))
    sizes = _as_side(hot, keys)
    return each.join(sizes, _on_keys(keys)).select(*keys, "n", *points)


def latency_rollup(
    log: DataFrame,
    keys: list[str],
    at: str,
    latency: str,
    failed: Column,
    window: str = "1 hour",
    window_seconds: int = 3600,
    alert_above: float = 500.0,
) -> DataFrame:
    """Request count and rate, error rate and latency percentiles per window and key.

    Requests without a latency count, and a window that has none is kept with NULL
    percentiles: that is what an outage looks like. `failed` counts as false where NULL.
    """
    placed = log.withColumn("window_start", F.window(at, window)["start"])
    group = ["window_start", *keys]
    share = F.avg(F.coalesce(failed, F.lit(False)).cast("double"))
    requests = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), share.alias("error_rate"))
    tails = percentiles(placed, group, latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
    tails = tails.withColumnsRenamed({k: f"_{k}" for k in group})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in group]
    return (
        requests.join(tails, reduce(Column.__and__, same), "left")
        .drop(*(f"_{k}" for k in group))
        .withColumn("per_second", F.col("n") / window_seconds)
        .withColumn("alert", F.col("p99") > alert_above)
    )


def leaderboard(df: DataFrame, window_key: str, member: str, score: Column, top: int) -> DataFrame:
    """The `top` members by total score in each window; equal scores rank by member."""
    totals = df.groupBy(window_key, member).agg(score.alias("score"))
    best = Window.partitionBy(window_key).orderBy(F.col("score").desc(), F.col(member))
    return totals.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)


def latest_by_key(df: DataFrame, keys: list[str], order: list[str], *more: Column) -> DataFrame:
    """The last row of each key by `order`: an aggregate, so hot keys shrink before the shuffle.

    `more` are named aggregates over all rows of the key, computed in the same pass and put behind the row.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    both = [last, F.struct(*more).alias("_more")] if more else [last]
    columns = [F.col(f"_row.`{c}`").alias(c) for c in rest] + ([F.col("_more.*")] if more else [])
    return df.groupBy(*keys).agg(*both).select(*keys, *columns)


def changelog_table(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Latest value per key; a latest value of NULL deletes the key."""
    return latest_by_key(df, keys, order).filter(F.col(value).isNotNull())


def mark_late(df: DataFrame, batch: str, at: str, delay: str) -> DataFrame:
    """Add `late`: the time lies before the latest time of all earlier batches minus `delay`.

    One row per batch decides, so no row-level window is needed.
    """
    peaks = df.groupBy(batch).agg(F.max(at).alias("_peak"))
    earlier = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    limits = peaks.select(
        F.col(batch).alias("_batch"),
        (F.max("_peak").over(earlier) - F.expr(f"INTERVAL {delay}")).alias("_limit"),
    )
    limits = settle(limits, "late-limits")
    return (
        df.join(broadcast_if_small(limits), F.col(batch) == F.col("_batch"), "left")
        .withColumn("late", F.coalesce(F.col(at) < F.col("_limit"), F.lit(False)))
        .drop("_batch", "_limit")
    )
