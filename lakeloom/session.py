"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_own_dirs: dict[str, str] = {}


def build_session(app: str = "lakeloom", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; `conf` adds or overrides keys."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on, in a session somebody else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in `spark.checkpoint.dir`.

    A session without the setting gets a folder of its own, which is only right in
    local mode; on a cluster the missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.applicationId not in _own_dirs:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="lakeloom-")
        sc.setCheckpointDir(_own_dirs[sc.applicationId])
    return _own_dirs[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; never handed out twice."""
    return f"{shared_dir(spark)}/lakeloom/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, partition_by: list[str] | None = None, drop_shuffles: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and continue from the written copy.

    Cuts the lineage like a checkpoint does, survives lost executors, and unlike
    a checkpoint keeps size statistics, so later joins are planned on real sizes.
    With `partition_by`, readers of one value skip the folders of the others. With `drop_shuffles`, the shuffle
    files of the writing are deleted when it is done, and not some time after nobody refers to them any more.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    try:
        spark.conf.set(DROP_SHUFFLES, str(drop_shuffles or before == "true").lower())
        df.write.partitionBy(*(partition_by or [])).parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store Spark reaches; nothing happens where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
