"""Table maintenance: snapshots, orphans, upserts, deletes, compaction, tiers, rollups."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import delete_path, settle
from .bounded import broadcast_if_small
from .ordered import ROWS_PER_SLICE, order_by_key
from .stats import latest_by_key


def snapshots_to_expire(
    snapshots: DataFrame, retain: int, older_than: Column | None = None, table: str = "table_name"
) -> DataFrame:
    """Snapshots beyond the last `retain` of their table that were committed before `older_than`."""
    older_than = F.current_timestamp() if older_than is None else older_than
    newest = Window.partitionBy(table).orderBy(F.col("committed_at").desc(), F.col("snapshot_id").desc())
    kept = snapshots.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= retain)
    kept = kept.select(F.col(table).alias("_table"), "snapshot_id")
    # The kept ones are few (a row limit per table); everything else is decided without a sort.
    old = snapshots.filter(F.col("committed_at") < older_than)
    return old.join(
        kept.withColumnRenamed("snapshot_id", "_kept"),
        (F.col(table) == F.col("_table")) & (F.col("snapshot_id") == F.col("_kept")),
        "left_anti",
    )


def orphan_files(listing: DataFrame, referenced: DataFrame) -> DataFrame:
    """Listed files that no retained snapshot refers to."""
    return listing.join(referenced.select("file_path"), "file_path", "left_anti")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`base` with every changed key replaced by its last change."""
    last = latest_by_key(changes, keys, order).select(*base.columns)
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last)


def apply_deletes(base: DataFrame, deletes: DataFrame, keys: list[str], at: str, deleted_at: str) -> DataFrame:
    """Rows that no later delete of their key removes: only the latest delete of a key matters."""
    last = deletes.groupBy(*keys).agg(F.max(deleted_at).alias("_deleted"))
    return (
        base.join(last, keys, "left")
        .filter(F.col("_deleted").isNull() | (F.col("_deleted") <= F.col(at)))
        .select(*base.columns)
    )


def compaction_plan(
    files: DataFrame,
    table: str,
    at: str,
    path: str,
    size: str,
    target_bytes: int,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Assign each file of a table to an output of about `target_bytes` (`bin`).

    Files at or above the target are left as they are (`bin` NULL); the others are packed
    in order of `at` (a BIGINT such as the modification time), neighbours in time together.
    """
    small = files.filter(F.col(size) < target_bytes)
    rows = order_by_key(small, [table], at, (path,), rows_per_slice).running_sum(size, "_upto")
    packed = rows.result().withColumn("bin", F.floor((F.col("_upto") - F.col(size)) / target_bytes))
    large = files.filter(F.col(size) >= target_bytes).withColumn("bin", F.lit(None).cast("long"))
    return packed.drop("_upto").unionByName(large)


def compact(spark, source: str, target: str, target_bytes: int) -> int:
    """Rewrite a Parquet folder into files of about `target_bytes`; returns the number of files."""
    df = spark.read.option("mergeSchema", "true").parquet(source)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    total = listed.filter(F.col("path").endswith(".parquet")).agg(F.sum("length")).first()[0] or 0
    count = max(1, -(-total // target_bytes))
    df.repartition(int(count)).write.mode("overwrite").parquet(target)
    return int(count)


@dataclass(frozen=True)
class Compaction:
    """Files of a folder before and after, and the rows that were written anew."""

    files_before: int
    files_after: int
    rows: int


def compact_files(spark: SparkSession, folder: str, target_bytes: int, rows_per_slice: int = ROWS_PER_SLICE) -> Compaction:
    """Rewrite the small Parquet files of a folder, neighbours in time together, into files of about `target_bytes`.

    Sizes and times come from the listing; no content is read to decide. A file at or above the target, or alone in
    its bin, is not touched. Each bin is written once, next to the folder; only when its rows are all there do the new
    files move in and the old ones go. A run that ends before leaves the folder as it was. The driver holds the paths
    of the small files, as their scan does.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    files = listed.select(F.lit("").alias("table"), "path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("at"))
    plan = settle(compaction_plan(settle(files, "files"), "table", "at", "path", "size", target_bytes, rows_per_slice), "bins")
    shared = plan.filter("bin is not null").groupBy(F.col("bin").alias("_bin")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    small = settle(plan.join(shared, F.col("bin") == F.col("_bin")).select("path", "_bin"), "small-files")
    before, bins = plan.count(), shared.count()
    if not bins:
        return Compaction(before, before, 0)
    paths = [r["path"] for r in small.select("path").collect()]
    rows = spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("_file", F.col("_metadata.file_name"))
    of = small.select(F.element_at(F.split("path", "/"), -1).alias("_file"), "_bin")
    staging = f"{folder.rstrip('/')}-compact-{uuid.uuid4().hex}"
    rows.join(broadcast_if_small(of), "_file").drop("_file").repartition(bins, "_bin").write.partitionBy("_bin").parquet(staging)
    found, written = rows.count(), spark.read.option("mergeSchema", "true").parquet(staging).count()
    if found != written:
        delete_path(spark, staging)
        raise RuntimeError(f"{written} of {found} rows were written; {folder} is as it was")
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    made = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(staging).select("path").collect()
    for i, r in enumerate(made):
        if not store.rename(hadoop.Path(r["path"]), hadoop.Path(f"{folder}/compact-{uuid.uuid4().hex}-{i}.parquet")):
            raise RuntimeError(f"{r['path']} could not be moved into {folder}")
    for path in paths:
        delete_path(spark, path)
    delete_path(spark, staging)
    return Compaction(before, before - len(paths) + len(made), found)


def tier_by_age(df: DataFrame, at: str, now: Column, local: str, total: str) -> DataFrame:
    """`tier`: hot up to the age `local`, cold up to `total`, gone beyond."""
    tier = (
        F.when(F.col(at) >= now - F.expr(f"INTERVAL {local}"), F.lit("hot"))
        .when(F.col(at) >= now - F.expr(f"INTERVAL {total}"), F.lit("cold"))
        .otherwise(F.lit("gone"))
    )
    return df.withColumn("tier", tier)


def build_rollup(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable partial aggregates."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_values"),
        F.sum(value).alias("total"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )


def refresh_rollup(rollup: DataFrame, new_rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rollup after more rows: their partials are merged, the old rows are not read again."""
    return (
        rollup.unionByName(build_rollup(new_rows, keys, value))
        .groupBy(*keys)
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_values").alias("n_values"),
            F.sum("total").alias("total"),
            F.min("least").alias("least"),
            F.max("most").alias("most"),
        )
    )


def rollup_mean(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("mean", F.col("total") / F.nullif(F.col("n_values"), F.lit(0)))
