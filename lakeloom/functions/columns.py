"""Small column expressions used by several jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (session zone is UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def ntz(ts: str | Column) -> Column:
    """Wall-clock timestamp, so that results do not depend on the reader's zone."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def json_schema(df: DataFrame, column: str) -> DataFrame:
    """(schema, n): one schema for the JSON texts of all rows, and how many rows are JSON."""
    parsed = df.select(F.try_parse_json(column).alias("v"))
    return parsed.agg(F.schema_of_variant_agg("v").alias("schema"), F.count("v").alias("n"))
