"""SCD type 2 history, its views, and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import micros
from ..functions.fixed import VALID_FROM, VALID_TO
from .ordered import ROWS_PER_SLICE, order_by_key


def with_validity(
    df: DataFrame,
    keys: list[str],
    at: str,
    ties: list[str] | tuple[str, ...] = (),
    valid_from: str = VALID_FROM,
    valid_to: str = VALID_TO,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Validity interval of each version: from its time to the next version of its key.

    Without keys every version stays open. `ties` order versions of equal time.
    """
    if not keys:
        no_end = F.lit(None).cast(df.schema[at].dataType)
        return df.withColumn(valid_from, F.col(at)).withColumn(valid_to, no_end)
    rows = order_by_key(df.withColumn("_at", micros(at)), keys, "_at", ties, rows_per_slice)
    return (
        rows.lead(at, valid_to).result().drop("_at").withColumn(valid_from, F.col(at))
    )


def current(history: DataFrame, valid_to: str = VALID_TO) -> DataFrame:
    return history.filter(F.col(valid_to).isNull())


def as_of(
    history: DataFrame,
    moment: Column,
    valid_from: str = VALID_FROM,
    valid_to: str = VALID_TO,
) -> DataFrame:
    """Versions valid at `moment`: from <= moment < to, an open end counts as forever."""
    return history.filter(
        (F.col(valid_from) <= moment) & (F.col(valid_to).isNull() | (F.col(valid_to) > moment))
    )


def as_of_join(
    facts: DataFrame,
    versions: DataFrame,
    keys: list[str],
    fact_at: str,
    version_at: str,
    take: list[str],
    version_ties: list[str] | tuple[str, ...] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Left join of each fact with the version of its key that was current at its time.

    One union and one ordered pass instead of a range join, so the work is linear in
    facts + versions whatever the number of versions per key. `take` are the version
    columns to bring along; a version at the very time of the fact counts. Keys of NULL
    match nothing.
    """
    tie_names = [f"_tie{i}" for i in range(len(version_ties))]
    payload = F.struct(*[F.col(c) for c in take])
    fact_rows = facts.select(
        *keys,
        micros(fact_at).alias("_at"),
        F.lit(1).alias("_side"),
        *[F.lit(None).cast(versions.schema[t].dataType).alias(n) for t, n in zip(version_ties, tie_names)],
        F.lit(None).cast(versions.select(payload.alias("p")).schema["p"].dataType).alias("_version"),
        F.struct(*[F.col(c) for c in facts.columns]).alias("_fact"),
    )
    version_rows = versions.select(
        *keys,
        micros(version_at).alias("_at"),
        F.lit(0).alias("_side"),
        *[F.col(t).alias(n) for t, n in zip(version_ties, tie_names)],
        payload.alias("_version"),
        F.lit(None).cast(fact_rows.schema["_fact"].dataType).alias("_fact"),
    )
    for key in keys:
        version_rows = version_rows.filter(F.col(key).isNotNull())
    rows = order_by_key(
        fact_rows.unionByName(version_rows), keys, "_at", ("_side", *tie_names), rows_per_slice
    )
    found = rows.fill_forward("_version", "_found").result().filter(F.col("_side") == 1)
    return found.select("_fact.*", *[F.col(f"_found.{c}").alias(c) for c in take])
