"""CSV, Parquet and other file scans with schema union and provenance."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with header, every column text; `007` stays `007`."""
    return spark.read.csv(path, header=True, sep=sep)


def diagonal_union(frames: list[DataFrame]) -> DataFrame:
    """Union by name; absent columns are NULL, columns in order of first appearance. At least one frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def csv_headers(spark: SparkSession, paths: list[str]) -> list[tuple[str, list[str]]]:
    """(header line, files that start with it), by the first file's path; blank lines in front do not count, and
    files without any other line are left out.

    One distributed job over the first block of each file. What comes back is the list of files,
    which any scan of them holds on the driver as well.
    """
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    written = (F.col("block") == 0) & F.col("value").rlike(r"[^\x00-\x20]")
    first = lines.filter(written).groupBy("file").agg(F.min_by("value", "line").alias("header"))
    rows = first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()
    return [(r["header"], [unquote(f) for f in r["files"]]) for r in sorted(rows, key=lambda r: r["files"][0])]


def column_names(header: str, sep: str = ",") -> list[str]:
    """Names of a header line; blank ones are numbered, repeated ones get their place behind them."""
    cells = [c or f"_c{i}" for i, c in enumerate(next(csv.reader([header.removeprefix("\ufeff")], delimiter=sep)))]
    return [f"{c}{i}" if cells.count(c) > 1 else c for i, c in enumerate(cells)]


def read_csv_union(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """CSV files and folders, also of mixed headers, as one table of text columns.

    Every file is read by its own header, in one scan per distinct header. A header with a line break inside quotes
    is read by the parser that knows such records, which takes a file as a whole. Without any header the table has no
    columns and no rows.
    """
    frames = []
    for header, files in csv_headers(spark, sorted(paths)):
        if header.count('"') % 2:  # the record goes on in the next line
            for file in files:
                rows = spark.read.csv(file, header=True, sep=sep, multiLine=True)
                frames.append(rows.toDF(*(c.removeprefix("\ufeff") for c in rows.columns)))
            continue
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in column_names(header, sep))
        frames.append(spark.read.schema(schema).csv(files, header=True, sep=sep))
    return diagonal_union(frames) if frames else spark.createDataFrame([], T.StructType([]))


def scan_merged(spark: SparkSession, *paths: str, source: str = "source") -> DataFrame:
    """Parquet with the schemas of all files merged, plus the file each row came from."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.withColumn(source, F.col("_metadata.file_path"))


def batch_glob(root: str, batch: str, entity: str) -> str:
    """Folder of one batch, or of all of them, for an entity."""
    return f"{root.rstrip('/')}/{'*' if batch == 'all' else batch}/{entity}"


def file_profile(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_path, file_name, file_size, record_count) of Parquet files."""
    meta = spark.read.parquet(*paths).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
    )
    return meta.groupBy("file_path", "file_name", "file_size").agg(
        F.count(F.lit(1)).alias("record_count")
    )


def schema_profile(df: DataFrame) -> list[tuple[int, str, str, bool]]:
    """(position, name, type, nullable) per column."""
    return [
        (i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)
    ]


def metadata_table(spark: SparkSession, table: str, kind: str) -> DataFrame:
    """`snapshots`, `files`, ... of a table whose format offers them; needs such a catalog."""
    return spark.table(f"{table}.{kind}")
