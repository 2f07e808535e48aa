"""Sources, sinks and runs of Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import new_path, prepare

NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
#: Rows of a file that a stream reads in time order, at most about.
FILE_ROWS = 1_000_000


def stream_table(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """A Parquet file or folder as a stream.

    By default a replay takes all files in one trigger, so no row is late because of the
    order of files. Pass `maxFilesPerTrigger` or `maxBytesPerTrigger` for sources whose
    files arrive in time order.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).options(**options)
    if _is_file(spark, path):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    """A path is a single file when the one file it lists is the path itself."""
    listed = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    return bool(listed) and listed[0]["path"].rstrip("/").endswith("/" + path.rstrip("/").rpartition("/")[2])


@dataclass(frozen=True)
class Trigger:
    """What one micro-batch read, and the rows that its stateful steps keep behind it."""

    batch_id: int
    input_rows: int
    state_rows: int
    late_rows: int


def _triggers(query: StreamingQuery) -> list[Trigger]:
    """The micro-batches of a run, as many of the last ones as Spark keeps reports of (100 by default)."""
    out = []
    for p in query.recentProgress:
        kept = [s.numRowsTotal for s in p.stateOperators]
        late = [s.numRowsDroppedByWatermark for s in p.stateOperators]
        out.append(Trigger(p.batchId, sum(max(0, s.numInputRows) for s in p.sources), sum(kept), sum(late)))
    return out


def to_table(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now into a Parquet table and read it back."""
    return run_to_table(df, label, mode)[0]


def run_to_table(df: DataFrame, label: str, mode: str = "append") -> tuple[DataFrame, list[Trigger]]:
    """The same, with a report of every trigger."""
    spark = prepare(df.sparkSession)
    out = new_path(spark, label)
    with _settings(spark):
        query = (
            df.writeStream.outputMode(mode)
            .format("parquet")
            .option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows"), _triggers(query)


def write_in_time(df: DataFrame, at: str, path: str, slices: int) -> int:
    """Write a table in `slices` steps of equal time, earlier ones first, so that a stream reads it in time order.

    A step has as few files as hold FILE_ROWS rows each, whatever the partitions of `df`: a trigger that takes one
    file costs seconds of its own, so triggers follow the rows. Returns the seconds of a step. Files of one step are in no order among each other, so a stream that takes
    some of them at a time waits that long for late rows and then loses none.
    """
    low, high = df.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    step = (high - low) // slices + 1 if low is not None else 1_000_000
    place = F.floor((F.unix_micros(at) - F.lit(low)) / step)
    rows = dict(df.groupBy(place).count().collect())  # a row for each step
    for k in range(slices):
        files = max(1, -(-rows.get(k, 0) // FILE_ROWS))
        df.filter(place == k).repartition(files).write.mode("append").parquet(path)
    return -(-step // 1_000_000)


def each_batch(
    df: DataFrame,
    label: str,
    write: Callable[[DataFrame, int, str], None],
    mode: str = "append",
    idle_batches: bool = True,
    out: str | None = None,
) -> str:
    """Run a stream with `write(batch, batch_id, folder)` per micro-batch; returns the folder.

    With the folder `out` of an earlier run, the stream goes on where that run's checkpoint ends.

    A batch that is replayed after a failure comes with the same id, so `write` stays
    idempotent by overwriting the folder of its id. Processing-time timers ask for batches
    without data for ever; a replay that uses them ends only with `idle_batches` off.
    """
    spark = prepare(df.sparkSession)
    out = out or new_path(spark, label)
    with _settings(spark, idle_batches):
        query = (
            df.writeStream.outputMode(mode)
            .foreachBatch(lambda batch, batch_id: write(batch, batch_id, out))
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return out


@contextmanager
def _settings(spark: SparkSession, idle_batches: bool = True) -> Iterator[None]:
    """Settings a query takes over when it starts.

    The number of state partitions follows the cluster's shuffle partitions; on a single
    machine it is the number of cores, as each partition keeps a store of its own open.
    """
    values = {NO_DATA_BATCHES: str(idle_batches).lower()}
    if spark.sparkContext.master.startswith("local"):
        values[SHUFFLE_PARTITIONS] = str(spark.sparkContext.defaultParallelism)
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
