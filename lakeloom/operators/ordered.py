"""Per-key ordered processing that does not put one hot key into one task.

A window over `partitionBy(key)` sorts each key in a single task, which fails when
one key owns a third of the table. Here keys above `rows_per_slice` rows are cut into
time slices of about that size; every window then runs per (key, slice), and what has
to cross a slice border (one row per slice) travels in a small side table. Keys below
the limit keep slice 0 and cost nothing extra.

Slices come from exact counts on a grid that is refined where it is too full, so recomputing a
lost task assigns every row to the same slice, and far-off times do no harm. A row finds its slice by
equality on (key, cell), so the work grows with the rows and not with rows times slices. Rows of equal
time share a slice, unless one instant has more rows than a slice; those are cut in the order of their
ties.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from ..session import settle
from .bounded import broadcast_if_small
from .ranks import ranked

ROWS_PER_SLICE = 1_000_000
GRID_PER_SLICE = 8
SLICE = "_slice"


def _on_keys(keys: list[str]) -> Column:
    """NULL-safe equality of the keys with those of a side renamed by `_as_side`."""
    cond = F.col(keys[0]).eqNullSafe(F.col(f"_k_{keys[0]}"))
    for key in keys[1:]:
        cond = cond & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return cond


def _as_side(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rename the key columns so that a join on them stays unambiguous and NULL-safe."""
    for key in keys:
        df = df.withColumnRenamed(key, f"_k_{key}")
    return df


@dataclass(frozen=True)
class Ordered:
    """Rows per key in time order. `at` is a BIGINT column, `ties` break equal times."""

    df: DataFrame
    keys: list[str]
    at: str
    ties: tuple[str, ...]
    hot: DataFrame | None

    @property
    def order(self) -> list[str]:
        return [self.at, *self.ties]

    @property
    def by_slice(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)

    def result(self) -> DataFrame:
        return self.df.drop(SLICE)

    def with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def _hot_rows(self) -> DataFrame:
        keys = _as_side(self.hot.select(*self.keys), self.keys)
        return self.df.join(broadcast_if_small(keys), _on_keys(self.keys), "left_semi")

    def _borders(self, *aggs: Column) -> DataFrame:
        """One row per (hot key, slice)."""
        return self._hot_rows().groupBy(*self.keys, SLICE).agg(*aggs)

    def _attach(self, df: DataFrame, side: DataFrame) -> DataFrame:
        # Written first: measuring it and joining it must not compute the borders twice.
        side = settle(_as_side(side, self.keys).withColumnRenamed(SLICE, "_k_slice"), "borders")
        names = [f"_k_{k}" for k in self.keys] + ["_k_slice"]
        cond = _on_keys(self.keys) & (F.col(SLICE) == F.col("_k_slice"))
        return df.join(broadcast_if_small(side), cond, "left").drop(*names)

    def _neighbour(self, value: str | Column, out: str, forward: bool) -> Ordered:
        value = F.col(value) if isinstance(value, str) else value
        step = F.lead if forward else F.lag
        if self.hot is None:
            return self.with_df(self.df.withColumn(out, step(value).over(self.by_slice)))
        pick = F.min_by if forward else F.max_by
        edge = self._borders(pick(F.struct(value.alias("v")), F.struct(*self.order)).alias("_edge"))
        across = Window.partitionBy(*self.keys).orderBy(SLICE)
        side = edge.select(*self.keys, SLICE, step("_edge").over(across).alias("_across"))
        df = self.df.withColumn(out, step(F.struct(value.alias("v"))).over(self.by_slice))
        df = self._attach(df, side)
        return self.with_df(
            df.withColumn(out, F.coalesce(F.col(out), F.col("_across"))["v"]).drop("_across")
        )

    def lead(self, value: str | Column, out: str) -> Ordered:
        """`value` of the next row of the key, NULL on its last row."""
        return self._neighbour(value, out, True)

    def lag(self, value: str | Column, out: str) -> Ordered:
        """`value` of the previous row of the key, NULL on its first row."""
        return self._neighbour(value, out, False)

    def _running(self, total: Column, out: str) -> Ordered:
        inside = self.by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = self.df.withColumn(out, total.over(inside))
        if self.hot is None:
            return self.with_df(df)
        before = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(
            Window.unboundedPreceding, -1
        )
        sums = self._borders(total.alias("_total"))
        side = sums.select(*self.keys, SLICE, F.sum("_total").over(before).alias("_before"))
        df = self._attach(df, side)
        return self.with_df(
            df.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_before")
        )

    def position(self, out: str) -> Ordered:
        """1-based position of the row within its key."""
        return self._running(F.count(F.lit(1)), out)

    def running_sum(self, value: str, out: str) -> Ordered:
        return self._running(F.sum(F.coalesce(F.col(value), F.lit(0))), out)

    def fill_forward(self, value: str | Column, out: str) -> Ordered:
        """The latest non-NULL `value` up to and including the row."""
        value = F.col(value) if isinstance(value, str) else value
        inside = self.by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = self.df.withColumn(out, F.last(value, ignorenulls=True).over(inside))
        if self.hot is None:
            return self.with_df(df)
        last = F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
        before = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(
            Window.unboundedPreceding, -1
        )
        side = self._borders(last.alias("_last")).select(
            *self.keys, SLICE, F.last("_last", ignorenulls=True).over(before).alias("_carried")
        )
        df = self._attach(df, side)
        return self.with_df(
            df.withColumn(out, F.coalesce(F.col(out), F.col("_carried"))).drop("_carried")
        )


def order_by_key(
    df: DataFrame,
    keys: list[str],
    at: str,
    ties: tuple[str, ...] | list[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> Ordered:
    """Measure the keys of `df` and slice the hot ones."""
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi")
    )
    hot = sizes.filter(F.col("_n") > rows_per_slice)
    if hot.isEmpty():
        return Ordered(df.withColumn(SLICE, F.lit(0).cast("long")), keys, at, tuple(ties), None)
    hot = settle(hot, "hot-keys")
    grids, cells = _grids(df, keys, at, hot, rows_per_slice)
    cuts = settle(_cuts(cells, keys, rows_per_slice), "cuts")
    # Written once: every pass over the ordered rows reads the slices, none finds them again.
    sliced = settle(_in_slices(df, keys, at, grids, cuts), "sliced")
    crowded = cuts.filter("_before is not null")
    if not crowded.isEmpty():
        sliced = _split_instants(sliced, keys, at, ties, rows_per_slice)
    return Ordered(sliced.drop("_before"), keys, at, tuple(ties), hot)


def _widths(ranges: DataFrame, rows_per_slice: int) -> DataFrame:
    """The grid over each range (_lo to _hi, _n rows): the width of its cells."""
    grid = F.ceil(F.col("_n") / rows_per_slice) * GRID_PER_SLICE
    return ranges.withColumn("_width", F.floor((F.col("_hi") - F.col("_lo")) / grid) + 1).drop("_n", "_hi")


def _cell(time: Column) -> Column:
    """Where the grid cell of a time begins; NULL where there is no grid."""
    return F.col("_lo") + F.floor((time - F.col("_lo")) / F.col("_width")) * F.col("_width")


def _grids(
    df: DataFrame, keys: list[str], at: str, hot: DataFrame, rows_per_slice: int
) -> tuple[list[DataFrame], DataFrame]:
    """Grids from coarse to fine, and the cells (keys, _g, _n, _instant) in which no more is refined.

    Every hot key has a grid. A cell that is too full, as when one far-off time stretches the grid, gets one
    of its own between its least and greatest time. Only rows of such cells are read again.
    """
    grids = [settle(_widths(hot.select(*keys, "_n", "_lo", "_hi"), rows_per_slice), "grid")]
    side = _as_side(grids[0], keys)
    times = df.select(*keys, F.col(at).alias("_t")).join(broadcast_if_small(side), _on_keys(keys))
    fine = None
    while True:
        counted = times.withColumn("_g", _cell(F.col("_t"))).groupBy(*keys, "_g")
        cells = settle(counted.agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi")), "cells")
        full = (F.col("_n") > rows_per_slice / 2) & (F.col("_hi") > F.col("_lo"))
        good = cells.filter(~full).select(*keys, "_g", "_n", (F.col("_hi") == F.col("_lo")).alias("_instant"))
        fine = good if fine is None else fine.unionByName(good)
        open_ = cells.filter(full)
        if open_.isEmpty():
            return grids, fine
        grids.append(settle(_widths(open_.select(*keys, "_g", "_n", "_lo", "_hi"), rows_per_slice), "grid"))
        side = _as_side(grids[-1], keys).withColumnRenamed("_g", "_k_g")
        inside = times.withColumn("_g", _cell(F.col("_t"))).select(*keys, "_t", "_g")
        times = settle(
            inside.join(broadcast_if_small(side), _on_keys(keys) & (F.col("_g") == F.col("_k_g"))).select(*keys, "_t", "_lo", "_width"),
            "crowded",
        )


def _cuts(cells: DataFrame, keys: list[str], rows_per_slice: int) -> DataFrame:
    """(keys, _g, _cut, _before): the slice of each cell; `_before`, the rows in front, for an instant of too many rows."""
    upto = Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("_n").over(upto) - F.col("_n")
    crowded = F.col("_instant") & (F.col("_n") > rows_per_slice)
    return cells.select(
        *keys, "_g", F.floor(before / rows_per_slice).alias("_cut"), F.when(crowded, before).alias("_before")
    )


def _in_slices(df: DataFrame, keys: list[str], at: str, grids: list[DataFrame], cuts: DataFrame) -> DataFrame:
    """`df` with the slice of each row, found by equality on (key, cell), one row for a row in every step."""
    found = df.join(broadcast_if_small(_as_side(grids[0], keys)), _on_keys(keys), "left").withColumn("_g", _cell(F.col(at)))
    names = ["_lo", "_width", *(f"_k_{k}" for k in keys)]
    found = found.drop(*names)
    for grid in grids[1:]:
        side = _as_side(grid, keys).withColumnRenamed("_g", "_k_g")
        same = _on_keys(keys) & (F.col("_g") == F.col("_k_g"))
        found = found.join(broadcast_if_small(side), same, "left")
        found = found.withColumn("_g", F.coalesce(_cell(F.col(at)), F.col("_g"))).drop(*names, "_k_g")
    side = _as_side(cuts, keys).withColumnRenamed("_g", "_k_g")
    same = _on_keys(keys) & (F.col("_g") == F.col("_k_g"))
    found = found.join(broadcast_if_small(side), same, "left")
    return found.withColumn(SLICE, F.coalesce("_cut", F.lit(0)).cast("long")).drop("_cut", "_g", "_k_g", *names)


def _split_instants(
    sliced: DataFrame, keys: list[str], at: str, ties: tuple[str, ...] | list[str], rows_per_slice: int
) -> DataFrame:
    """Rows of an instant of too many rows in slices of their own, in the order of their ties."""
    crowded = sliced.filter("_before is not null")
    order = [F.col(c).asc_nulls_first() for c in ties]
    placed_ = ranked(crowded, [*keys, at], order, "instants")
    split = placed_.withColumn(SLICE, F.floor((F.col("_before") + F.col("idx")) / rows_per_slice)).drop("idx", "n")
    return sliced.filter("_before is null").unionByName(split)
