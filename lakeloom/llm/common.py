"""What the corpus operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Rows of an Arrow batch that Python functions take at once.
BATCH_ROWS = 256


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator works on, so that no other column can clash: doc_id, text (null: empty) and `more`."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more
    )


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def process_store(name: str, make: Callable[[], object]):
    """A value kept for the life of this Python process, so that the tasks of one worker share it.

    Before a new value is made, those that no task of the same stage has asked for are dropped, so that a worker that
    serves one job after the other does not gather the memories of all of them.
    """
    module = sys.modules.setdefault("_lakeloom_kept", types.ModuleType("_lakeloom_kept"))
    kept = vars(module).setdefault("values", {})
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if name not in kept:
        for old in [k for k, (_, used) in kept.items() if used != stage]:
            del kept[old]
        kept[name] = (make(), stage)
    elif kept[name][1] != stage:
        kept[name] = (kept[name][0], stage)
    return kept[name][0]


def arrow_map(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, which bounds what Python holds of their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def same_document(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on doc_id and the fingerprint `row_key`; a null doc_id meets a null doc_id."""
    r = right.withColumnsRenamed({"doc_id": "_doc_id", "row_key": "_row_key"})
    on = left["doc_id"].eqNullSafe(r["_doc_id"]) & (left["row_key"] == r["_row_key"])
    return left.join(r, on, how).drop("_doc_id", "_row_key")
