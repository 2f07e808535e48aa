"""Table writers, write checks and the schema gate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..session import delete_path


class SchemaMismatch(ValueError):
    """The rows to write do not fit the table."""


def is_path(target: str) -> bool:
    return "/" in target


def has_v2_catalog(spark: SparkSession, target: str) -> bool:
    """True when the first name part is a configured catalog, e.g. of a snapshotting table format."""
    parts = target.split(".")
    return len(parts) > 2 and spark.conf.get(f"spark.sql.catalog.{parts[0]}", None) is not None


def read_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target) if is_path(target) else spark.table(target)


def replace_table(df: DataFrame, target: str) -> None:
    """Create the table or replace schema and rows."""
    if is_path(target):
        df.write.mode("overwrite").parquet(target)
    elif has_v2_catalog(df.sparkSession, target):
        df.writeTo(target).createOrReplace()
    else:
        df.write.mode("overwrite").saveAsTable(target)


def append_table(df: DataFrame, target: str) -> None:
    """Append rows of exactly the table's columns and types; the order of columns is free."""
    table = read_table(df.sparkSession, target)
    problems = schema_differences(table.schema, df.schema)
    if problems:
        raise SchemaMismatch("; ".join(problems))
    rows = df.select(*table.columns)
    if is_path(target):
        rows.write.mode("append").parquet(target)
    elif has_v2_catalog(df.sparkSession, target):
        rows.writeTo(target).append()
    else:
        rows.write.mode("append").saveAsTable(target)


def write_bucketed(df: DataFrame, name: str, key: str, path: str, buckets: int | None = None) -> None:
    """Table bucketed and sorted by `key`, one bucket per shuffle partition unless given.

    Tables bucketed alike join on the key without a shuffle. Rows are brought together by
    key first, so a task writes few buckets and the number of files stays near the number
    of buckets; adaptive execution splits the writing of a hot key. Reading it back is one
    task per bucket, so a table with a dominating key is better joined unbucketed.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.hint("rebalance", key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def write_partitioned(df: DataFrame, key: str, path: str) -> None:
    """One folder per key. Rows are rebalanced by key: adaptive execution splits a hot key
    over several tasks and packs rare keys together."""
    df.hint("rebalance", key).write.partitionBy(key).parquet(path)


def replace_partitions(rows: DataFrame, path: str, keys: list[str], replaced: DataFrame) -> None:
    """Write `rows` in folders by `keys`, in place of the partitions named in `replaced`; all others stay as they are.

    A replaced partition that has no row any more is deleted. What is collected are the keys of such partitions.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for gone in replaced.select(*keys).exceptAll(rows.select(*keys).distinct()).collect():
        delete_path(spark, "/".join([path, *(f"{k}={escape(str(gone[k]))}" for k in keys)]))


def ingest_files(files: DataFrame, target: Callable[[str], str]) -> dict[str, int]:
    """Append requested Parquet files, (table, file) rows, to their tables; files per table.

    The schemas of all files of a table are merged, so no column of any file is lost, and all
    tables are checked before the first one is written to. A file that is asked for twice is read
    once. The lists of paths are metadata, which the scans hold on the driver as well.
    """
    spark = files.sparkSession
    asked = files.distinct().groupBy("table").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()
    ready, problems = [], []
    for row in sorted(asked, key=lambda r: r["table"]):
        rows, place = spark.read.option("mergeSchema", "true").parquet(*row["files"]), target(row["table"])
        known = table_exists(spark, place)
        if known:
            problems += [f"{row['table']}: {p}" for p in schema_differences(read_table(spark, place).schema, rows.schema)]
        ready.append((row["table"], rows, place, known, len(row["files"])))
    if problems:
        raise SchemaMismatch("; ".join(problems))
    for _, rows, place, known, _ in ready:
        (append_table if known else replace_table)(rows, place)
    return {table: n for table, _, _, _, n in ready}


def table_exists(spark: SparkSession, target: str) -> bool:
    if not is_path(target):
        return spark.catalog.tableExists(target)
    try:
        spark.read.parquet(target)
        return True
    except AnalysisException:
        return False


@dataclass(frozen=True)
class WriteCheck:
    written: int
    found: int

    @property
    def passed(self) -> bool:
        return self.written == self.found


def write_checked(df: DataFrame, target: str) -> WriteCheck:
    """Replace a table and compare the rows written with the rows read back.

    The written rows are counted while they pass, so the input is not computed twice. A
    task that ran again after a lost executor may have counted its rows twice; a mismatch
    is therefore settled by counting the input itself.
    """
    seen = Observation()
    replace_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), target)
    found = read_table(df.sparkSession, target).count()
    written = seen.get["rows"]
    return WriteCheck(written if written == found else df.count(), found)


def _types(schema: T.StructType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in schema.fields}


def schema_differences(old: T.StructType, new: T.StructType) -> list[str]:
    a, b = _types(old), _types(new)
    return (
        [f"{n} is missing" for n in a if n not in b]
        + [f"{n} is new" for n in b if n not in a]
        + [
            f"{n} is {b[n].simpleString()}, not {a[n].simpleString()}"
            for n in a
            if n in b and a[n] != b[n]
        ]
    )


# Type changes a reader of the wider type accepts.
WIDENS = {
    ("int", "bigint"),
    ("int", "float"),
    ("int", "double"),
    ("bigint", "float"),
    ("bigint", "double"),
    ("float", "double"),
}


def _reads(reader: T.StructType, writer: T.StructType) -> list[str]:
    """Why data of `writer` cannot be read with `reader`."""
    have = _types(writer)
    problems = []
    for f in reader.fields:
        if f.name not in have:
            if not f.nullable:
                problems.append(f"{f.name} is required but absent")
        elif have[f.name] != f.dataType:
            pair = (have[f.name].simpleString(), f.dataType.simpleString())
            if pair not in WIDENS:
                problems.append(f"{f.name}: {pair[0]} cannot be read as {pair[1]}")
    return problems


def check_compat(old: T.StructType, new: T.StructType, mode: str) -> list[str]:
    """Problems of moving from `old` to `new`; empty means compatible.

    STRICT: equal. BACKWARD: the new schema reads old data. FORWARD: the old schema reads
    new data. FULL: both. NONE: anything goes.
    """
    if mode == "NONE":
        return []
    if mode == "STRICT":
        return schema_differences(old, new)
    if mode == "BACKWARD":
        return _reads(new, old)
    if mode == "FORWARD":
        return _reads(old, new)
    if mode == "FULL":
        return _reads(new, old) + _reads(old, new)
    raise ValueError(f"unknown mode {mode!r}")
