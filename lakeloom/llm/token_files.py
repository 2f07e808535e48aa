"""Token ids in files: fixed-size blocks of ids as compressed bit or byte planes, with a chunk index.

The format. A data set is a folder of two Parquet tables. `chunks` has a row per chunk: the shard
(a range of doc_ids, in ascending order), the chunk's number in it, where it starts in the shard,
its documents (ids and lengths), and the payload. A chunk holds whole documents, so that it can be
read by itself. Its ids are cut into blocks of BLOCK ids (the last one may be shorter); a block is
transposed into planes, either one per byte of the 32-bit ids or one per bit, lowest first; each
plane is compressed with zstandard; `sizes` lists the bytes of every plane in payload order.
`index` has a row per shard: its chunks, its ids, and the ids of all shards before it.

A null text counts as empty: the end id alone. Documents of equal doc_id keep their text's order; a
null doc_id comes first. Rows that repeat are written one by one; other columns are not read. An
empty table gives files without rows, which are read as an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import slices, slim
from .tokens import word_memory

#: Ids of a block, and ids after which a chunk is closed.
BLOCK, CHUNK = 1 << 15, 1 << 17
LEVEL = 3

CHUNKS = (
    "shard int, chunk int, start long, n_ids long, doc_ids array<long>, lengths array<long>, "
    "kind string, sizes array<int>, payload binary"
)
INDEX = "shard int, chunks long, n_ids long, start long"


def planes(block: np.ndarray, kind: str) -> list[bytes]:
    """The byte or bit planes of a block of ids, lowest first."""
    rows = np.ascontiguousarray(block.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        return [row.tobytes() for row in rows]
    bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(4, -1, 8)
    return [np.packbits(bits[b, :, k], bitorder="little").tobytes() for b in range(4) for k in range(8)]


def from_planes(parts: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in parts])
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts]
        rows = np.packbits(np.stack(bits).reshape(4, 8, n), axis=1, bitorder="little")[:, 0, :]
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def encode_chunk(ids: np.ndarray, kind: str) -> tuple[list[int], bytes]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    parts = [press.compress(p) for at in range(0, len(ids), BLOCK) for p in planes(ids[at : at + BLOCK], kind)]
    return [len(p) for p in parts], b"".join(parts)


def decode_chunk(sizes: list[int], payload: bytes, n_ids: int, kind: str) -> np.ndarray:
    press, at, parts = zstandard.ZstdDecompressor(), 0, []
    for size in sizes:
        parts.append(press.decompress(payload[at : at + size]))
        at += size
    each = 4 if kind == "byte" else 32
    blocks = [
        from_planes(parts[k * each : (k + 1) * each], min(BLOCK, n_ids - k * BLOCK), kind)
        for k in range(len(parts) // each)
    ]
    return np.concatenate(blocks) if blocks else np.zeros(0, "<u4")


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    kind: str = "byte",
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of all documents, each followed by `end_id`, in ascending doc_id order.

    The texts are dealt to shards by ranges of doc_id (rows of one id by their text as well), and
    each task tokenizes and writes the documents of its shard as they come.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, end = word_memory(tokenizer), end_id.to_bytes(4, "little")
        shard, chunk, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts = [], []
        schema = pa.schema(
            [
                ("shard", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()),
                ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("kind", pa.string()),
                ("sizes", pa.list_(pa.int32())), ("payload", pa.binary()),
            ]
        )

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            sizes, payload = encode_chunk(ids, kind)
            lengths = [len(p) // 4 for p in parts]
            values = (shard, chunk, start, len(ids), doc_ids, lengths, kind, sizes, payload)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

        held = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                parts.append(memory.ids(text) + end)
                held += len(parts[-1]) // 4
                if held >= CHUNK:
                    yield row()
                    chunk, start, held, doc_ids, parts = chunk + 1, start + held, 0, [], []
        if parts:
            yield row()

    ordered = (
        slim(docs, id_col, text_col)
        .repartitionByRange(shards, F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ordered.mapInArrow(write, CHUNKS).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    # One row per shard, of which there are as many as tasks wrote.
    by_shard = chunks(spark, path).groupBy("shard").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("n_ids").alias("n_ids")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    index = by_shard.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    index.write.parquet(f"{path}/index")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks")


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids)."""
    more = ", ids binary" if keep_ids else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            for row in batch.to_pylist():
                ids = decode_chunk(row["sizes"], row["payload"], row["n_ids"], row["kind"]).tobytes()
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                parts = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(row["base"] + row["start"] + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                }
                if keep_ids:
                    columns["ids"] = pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    index = spark.read.schema(INDEX).parquet(f"{path}/index").select("shard", F.col("start").alias("base"))
    joined = chunks(spark, path).join(F.broadcast(index), "shard")  # a row per shard: as many as files
    return joined.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + more)
