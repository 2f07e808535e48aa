"""Delivery archive names: TABLE_YYYYMMDD_FLAG_VERSION.csv.zip."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Table name = shortest prefix before "_" and eight digits; then flag and a
# 17-digit version time (to the millisecond).
TABLE_PATTERN = r"^(.+?)_(\d{8})"
TAIL_PATTERN = r"^.+?_\d{8}_([^_.]*)_(\d{17})"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def archive_base(path: Column) -> Column:
    """File name without its .csv.zip ending (any case)."""
    return F.regexp_replace(file_name(path), r"(?i)\.csv\.zip$", "")


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def archive_table(path: Column) -> Column:
    return _found(file_name(path), TABLE_PATTERN, 1)


def business_date(path: Column) -> Column:
    return F.try_to_date(_found(file_name(path), TABLE_PATTERN, 2), "yyyyMMdd")


def delivery_flag(path: Column) -> Column:
    """Flag text, empty when the name leaves it out, NULL when the name has no such part."""
    name = file_name(path)
    return F.when(name.rlike(TAIL_PATTERN), F.regexp_extract(name, TAIL_PATTERN, 1))


def version_time(path: Column) -> Column:
    digits = _found(file_name(path), TAIL_PATTERN, 2)
    # The parser needs a mark between the seconds and their fraction.
    marked = F.concat(F.left(digits, F.lit(14)), F.lit("."), F.right(digits, F.lit(3)))
    return F.try_to_timestamp(marked, F.lit("yyyyMMddHHmmss.SSS"))
