"""Mapping-driven load of raw tables into one normalized history table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed as fx
from .bounded import collect_bounded
from .history import with_validity
from .lookup import Calendar, period_lookup
from .ordered import ROWS_PER_SLICE

MAX_MAPPING_ROWS = 200_000

SIMPLE_TYPES = {
    "": None,
    "STRING": T.StringType(),
    "VARCHAR": T.StringType(),
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}


@dataclass(frozen=True)
class MapRow:
    """One line of the mapping: source column to target column."""

    source_table: str
    target_table: str
    source_column: str
    target_column: str
    type: str = ""
    precision: int | None = None
    scale: int | None = None
    primary_key: bool = False
    condition: str = ""
    origin: str = "RAW"

    def data_type(self) -> T.DataType | None:
        name = self.type.strip().upper()
        if name in ("DECIMAL", "NUMERIC"):
            return T.DecimalType(self.precision or 38, self.scale or 0)
        if name not in SIMPLE_TYPES:
            raise ValueError(f"unknown mapping type {self.type!r} for {self.target_column}")
        return SIMPLE_TYPES[name]


def read_mapping(spark: SparkSession, path: str) -> list[MapRow]:
    """Mapping file (`;`, header). Lines without a target table or of another origin are left out."""
    lines = spark.read.csv(path, sep=";", header=True)

    def text(row, name: str) -> str:
        return (row[name] or "").strip() if name in row.__fields__ else ""

    def number(row, name: str) -> int | None:
        return int(text(row, name)) if text(row, name) else None

    rows = [
        MapRow(
            text(r, fx.MAP_SOURCE_TABLE),
            text(r, fx.MAP_TARGET_TABLE),
            text(r, fx.MAP_SOURCE_COLUMN),
            text(r, fx.MAP_TARGET_COLUMN),
            text(r, fx.MAP_TYPE),
            number(r, fx.MAP_PRECISION),
            number(r, fx.MAP_SCALE),
            text(r, fx.MAP_PRIMARY_KEY) == "1",
            text(r, fx.MAP_CONDITION),
            text(r, fx.MAP_ORIGIN).upper(),
        )
        for r in collect_bounded(lines, MAX_MAPPING_ROWS)
    ]
    return [r for r in rows if r.target_table and r.origin == "RAW"]


def by_source(mapping: list[MapRow], target: str) -> dict[str, list[MapRow]]:
    """Mapping rows of one target per source table, in mapping order."""
    groups: dict[str, list[MapRow]] = {}
    for row in mapping:
        if row.target_table == target and row.origin == "RAW":
            groups.setdefault(row.source_table, []).append(row)
    return groups


def conditions(rows: list[MapRow]) -> list[str]:
    """Distinct row conditions, sorted, without a leading `where`."""
    found = set()
    for row in rows:
        text = row.condition.strip()
        if text.lower().startswith("where "):
            text = text[len("where "):].strip()
        if text:
            found.add(text)
    return sorted(found)


def key_columns(rows: list[MapRow], extract_key: list[str] | None) -> list[str]:
    """Source columns that identify a row: the extract's key list if it names any, else the flags."""
    listed = [c for c in (extract_key or []) if c.strip()]
    return listed or [r.source_column for r in rows if r.primary_key]


def typed(column: Column, dtype: T.DataType | None) -> Column:
    """Cast that gives NULL where the text does not fit; `typed_projection` reports those rows."""
    return column if dtype is None else column.try_cast(dtype)


def first_per_target(rows: list[MapRow]) -> list[MapRow]:
    """Rows in projection order: by first appearance of the source column; first row wins a target."""
    sources: dict[str, list[MapRow]] = {}
    for row in rows:
        sources.setdefault(row.source_column, []).append(row)
    taken: set[str] = set()
    ordered = []
    for group in sources.values():
        for row in group:
            if row.target_column not in taken:
                taken.add(row.target_column)
                ordered.append(row)
    return ordered


def project_mapping(src: DataFrame, rows: list[MapRow]) -> DataFrame:
    """Renamed and typed columns of one source."""
    return src.select(
        *[
            typed(F.col(f"`{r.source_column}`"), r.data_type()).alias(r.target_column)
            for r in first_per_target(rows)
        ]
    )


def typed_projection(src: DataFrame, rows: list[MapRow]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected source rows). A row is rejected when a present value fails its cast.

    Empty text counts as absent, as it does in the CSV the rows come from.
    """
    rows = first_per_target(rows)
    values = {r.target_column: F.nullif(F.col(f"`{r.source_column}`"), F.lit("")) for r in rows}
    broken = [
        F.when(
            values[r.target_column].isNotNull()
            & typed(values[r.target_column], r.data_type()).isNull(),
            F.lit(r.source_column),
        )
        for r in rows
        if r.data_type() is not None
    ]
    checked = src.withColumn("_broken", F.array_compact(F.array(*broken)))
    good = checked.filter(F.size("_broken") == 0).select(
        *[typed(values[r.target_column], r.data_type()).alias(r.target_column) for r in rows]
    )
    return good, checked.filter(F.size("_broken") > 0)


def tech_columns(target: str, target_schemas: dict[str, set[str]] | None) -> list[str]:
    """Technical columns to emit: those in the known schema; all when no schemas are given;
    only the two times when schemas are given but not for this target."""
    everything = [fx.EXTRACT_TIME, fx.LOAD_TIME, fx.VALID_FROM, fx.VALID_TO]
    if target_schemas is None:
        return everything
    if target not in target_schemas:
        return [fx.EXTRACT_TIME, fx.LOAD_TIME]
    return [c for c in everything if c in target_schemas[target]]


def readable(src: DataFrame, rows: list[MapRow]) -> tuple[DataFrame, DataFrame]:
    """(rows to load, rejected rows) of a source, after the row conditions.

    A row is rejected if a present value does not fit the type its target asks for; `_broken`
    names the columns. Values that are computed on loading (period, local day) are not checked.
    """
    for condition in conditions(rows):
        src = src.filter(F.expr(f"({condition})"))
    computed = (fx.PERIOD_ID, fx.LOCAL_DAY, fx.UTC_TIME)
    broken = []
    for row in first_per_target(rows):
        if row.target_column in computed or row.data_type() is None:
            continue
        value = F.col(f"`{row.source_column}`")
        if isinstance(src.schema[row.source_column].dataType, T.StringType):
            value = F.nullif(value, F.lit(""))
        broken.append(F.when(value.isNotNull() & typed(value, row.data_type()).isNull(), F.lit(row.source_column)))
    if not broken:
        return src, src.withColumn("_broken", F.array().cast("array<string>")).limit(0)
    checked = src.withColumn("_broken", F.array_compact(F.array(*broken)))
    return checked.filter(F.size("_broken") == 0).drop("_broken"), checked.filter(F.size("_broken") > 0)


def load_rejects(sources: dict[str, DataFrame], mapping: list[MapRow], target: str) -> DataFrame:
    """(source_table, broken, row): what `load_target` leaves out, each row as JSON."""
    parts = []
    for name, rows in by_source(mapping, target).items():
        if name in sources:
            _, bad = readable(sources[name], rows)
            whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sources[name].columns]))
            parts.append(bad.select(F.lit(name).alias("source_table"), F.col("_broken").alias("broken"), whole.alias("row")))
    return reduce(DataFrame.unionByName, parts)


def load_source(
    src: DataFrame,
    rows: list[MapRow],
    extract_key: list[str] | None = None,
    tech: list[str] | None = None,
    calendar: Calendar | None = None,
    ties: list[str] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One source of a target: conditions, calendar lookup, projection and validity.

    The history runs over the key's *source* columns and after the conditions, so a
    rejected version does not close the one before it. Rows with an unreadable value are
    left out; `load_rejects` gives them.
    """
    tech = tech_columns("", None) if tech is None else tech
    # A row that loses its target to an earlier one still counts for conditions, keys and the calendar.
    every, rows = rows, first_per_target(rows)
    src, _ = readable(src, every)

    clock = next(
        (r.source_column for r in every
         if r.target_column == fx.PERIOD_ID and r.source_column in fx.TIME_SOURCES),
        None,
    )
    if clock is not None:
        if calendar is None:
            raise ValueError(f"{fx.PERIOD_ID} needs a calendar")
        mapped = {r.source_column for r in every}
        grain = next((g for g in fx.GRAIN_COLUMNS if g in mapped), fx.GRAIN_COLUMNS[0])
        src = period_lookup(src, clock, grain, calendar, "_period", "_local_day")

    def value(row: MapRow) -> Column:
        if row.target_column == fx.PERIOD_ID:
            return F.col("_period") if clock else F.lit(None).cast("string")
        if row.target_column == fx.LOCAL_DAY and row.source_column == "doba" and clock:
            return F.col("_local_day")
        column = F.col(f"`{row.source_column}`")
        if row.target_column == fx.UTC_TIME and row.source_column in fx.TIME_SOURCES:
            return column.try_cast("timestamp")
        return typed(column, row.data_type())

    keys = key_columns(every, extract_key)
    if fx.VALID_TO in tech or fx.VALID_FROM in tech:
        if fx.VALID_TO in tech:
            src = with_validity(src, keys, fx.EXTRACT_TIME, ties or (), rows_per_slice=rows_per_slice)
        else:
            src = src.withColumn(fx.VALID_FROM, F.col(fx.EXTRACT_TIME))
    src = src.withColumn(fx.LOAD_TIME, F.current_timestamp())
    return src.select(
        *[value(r).alias(r.target_column) for r in rows],
        *[F.col(c) for c in tech],
    )


def load_target(
    sources: dict[str, DataFrame],
    mapping: list[MapRow],
    target: str,
    extract_keys: dict[str, list[str]] | None = None,
    target_schemas: dict[str, set[str]] | None = None,
    calendar: Calendar | None = None,
    ties: dict[str, list[str]] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Full rebuild of a target from all its sources; absent columns are NULL.

    History runs within each source, not across them.
    """
    tech = tech_columns(target, target_schemas)
    loaded: DataFrame | None = None
    for name, rows in by_source(mapping, target).items():
        part = load_source(
            sources[name],
            rows,
            (extract_keys or {}).get(name),
            tech,
            calendar,
            (ties or {}).get(name),
            rows_per_slice,
        )
        loaded = part if loaded is None else loaded.unionByName(part, allowMissingColumns=True)
    if loaded is None:
        raise ValueError(f"no mapping rows for {target}")
    body = [c for c in loaded.columns if c not in tech]
    return loaded.select(*body, *tech)
