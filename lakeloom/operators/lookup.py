"""Calendar and period-in-day lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import GRAIN_TO_PERIOD
from .bounded import broadcast_if_small


class DuplicateKey(ValueError):
    """A dimension would multiply the rows joined to it."""


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().filter("count > 1")
    if not twice.isEmpty():
        raise DuplicateKey(f"dimension has several rows for one {keys}")
    return df


@dataclass(frozen=True)
class Calendar:
    """days(doba_utc, typ_doby_kod);
    periods(id, czas_do_utc 'HH:mm', typ_doby_kod, ziarno_czasu_kod, okres_rb_kod, zmiana_doby_lokalnej)."""

    days: DataFrame
    periods: DataFrame

    def checked(self) -> Calendar:
        require_unique(self.days, ["doba_utc"])
        require_unique(
            self.periods, ["czas_do_utc", "typ_doby_kod", "ziarno_czasu_kod", "okres_rb_kod"]
        )
        return self


def market_period(grain: Column) -> Column:
    """Market period of a grain code; an unknown grain has none."""
    codes = F.create_map(*[F.lit(x) for pair in GRAIN_TO_PERIOD.items() for x in pair])
    return codes[grain]


def period_lookup(
    src: DataFrame,
    at: str,
    grain: str,
    calendar: Calendar,
    period_out: str = "okres_w_dobie_id",
    day_out: str = "doba_pl",
) -> DataFrame:
    """Add the period id of a time and the local day it belongs to; no match gives NULL.

    A period that crosses local midnight belongs to the next day.
    """
    calendar = calendar.checked()
    days = calendar.days.select(
        F.col("doba_utc").alias("_day"), F.col("typ_doby_kod").alias("_day_kind")
    )
    periods = calendar.periods.select(
        F.col("id").alias(period_out),
        F.col("czas_do_utc").alias("_p_time"),
        F.col("typ_doby_kod").alias("_p_kind"),
        F.col("ziarno_czasu_kod").alias("_p_grain"),
        F.col("okres_rb_kod").alias("_p_market"),
        F.col("zmiana_doby_lokalnej").alias("_p_next"),
    )
    on_period = (
        (F.date_format(at, "HH:mm") == F.col("_p_time"))
        & (F.col("_day_kind") == F.col("_p_kind"))
        & (F.col(grain) == F.col("_p_grain"))
        & (market_period(F.col(grain)) == F.col("_p_market"))
    )
    joined = src.join(
        broadcast_if_small(days), F.col(at).cast("date") == F.col("_day"), "left"
    ).join(broadcast_if_small(periods), on_period, "left")
    local = F.when(F.col("_p_next") == 1, F.date_add("_day", 1)).otherwise(F.col("_day"))
    return joined.withColumn(day_out, local).drop(
        "_day", "_day_kind", "_p_time", "_p_kind", "_p_grain", "_p_market", "_p_next"
    )
