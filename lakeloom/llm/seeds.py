"""Seeds of repeated passages: winnowed anchors, and exchanges that group hashes without hot keys.

A document is a row of 64-bit values, one per word or byte. Of every window of `length` values the
least of its `seed`-value hashes is its anchor (winnowing), so equal windows have equal anchors at
equal places. An exchange groups hashes over all documents: each task first combines what it has,
sends one entry per distinct hash in packed columns, and answers by itself what it can tell alone.
A hash that is in a third of the documents so reaches its reducer once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import process_store, slices

#: Stands for a null doc_id; it comes after all others.
NO_ID = np.iinfo(np.int64).max
#: Entries of a task that are combined and sent at once; one takes some two hundred bytes while it is sorted and packed.
FLUSH = 250_000
#: Parts of messages for each reducer, which takes one after the other; fewer where all reducers would have more than PARTS.
FINE, PARTS = 16, 1024
#: Bytes of answers that are sorted together.
SORTED = 8 << 20
#: Bytes of messages that leave a task in one batch.
SENT = 4 << 20
#: Windows of a document that are looked at together.
STRETCH = 1 << 20
#: The value of each byte, for documents as rows of bytes.
BYTE_VALUES = np.random.default_rng(100).integers(0, 2**64, 256, dtype=np.uint64)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
MESSAGE = "part int, doc_id long, data binary"
#: Kinds of messages, and the columns of answers: the document, then its anchors, or the windows found repeated
#: as the fingerprint of the text, the start and how many windows follow on.
ANCHORS, HOT, WINDOWS, SEGMENTS = 0, 1, 2, 3
ANSWERS = {ANCHORS: ["<i8", "<u8"], WINDOWS: ["<i8", "<u4", "<i8", "<u4"]}
#: Answers that a reducer gathers before it sends them.
ANSWERED = 500_000
Answers = tuple[np.ndarray, ...]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse modulo 2**64, at least n + 1 of them."""
    store = process_store("powers", dict)
    if base not in store or len(store[base][0]) <= n:
        size = max(1 << 16, 2 * n)
        inverse = pow(int(_BASES[base]), -1, 1 << 64)
        both = []
        for b in (_BASES[base], np.uint64(inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        store[base] = tuple(both)
    return store[base]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int, base: int = 0) -> np.ndarray:
    """The hash of each `width` consecutive values."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


def least_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost least hash of each `width` consecutive ones is."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    value, at, span = hashes, np.arange(len(hashes)), 1

    def join(value, at, step, n):
        left = value[:n] <= value[step : step + n]
        return np.where(left, value[:n], value[step : step + n]), np.where(left, at[:n], at[step : step + n])

    while span * 2 <= width:
        value, at = join(value, at, span, len(value) - span)
        span *= 2
    if span < width:
        value, at = join(value, at, width - span, len(hashes) - width + 1)
    return at


def anchors(values: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The seed hashes, and of each window of `length` values the place of its anchor."""
    hashes = rolling(values, seed)
    return hashes, least_of(hashes, length - seed + 1)


def stretches(values: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """The values in parts that overlap so that each window lies in one; bounds the memory of a long text."""
    for low in range(0, max(1, len(values) - length + 1), STRETCH):
        part = values[low : low + STRETCH + length - 1]
        yield low, (BYTE_VALUES[part] if part.dtype == np.uint8 else part)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])


def joined(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The pieces of each column as one; the pieces are let go."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    held.clear()
    return columns


def pack(kind: int, *columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of one length as bytes: kind, rows, width of each column, the columns, anything else."""
    head = np.array([kind, len(columns[0]), len(columns), *(c.dtype.itemsize for c in columns)], "<u4")
    return b"".join([head.tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns), tail])


def unpack(data: bytes, kinds: list[str]) -> tuple[list[np.ndarray], bytes]:
    n, k = np.frombuffer(data, "<u4", 3)[1:].tolist()
    at, out = 4 * (3 + k), []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, data[at:]


def kind_of(data: bytes) -> int:
    return int.from_bytes(data[:4], "little")


def message(parts: list[int], docs: list[int | None], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array(docs, pa.int64()), pa.array(data, pa.binary())], ["part", "doc_id", "data"]
    )


def messages(rows: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Messages (part, data) without a document, several to a batch."""
    parts, held, size = [], [], 0
    for part, data in rows:
        parts.append(part)
        held.append(data)
        size += len(data)
        if size >= SENT:
            yield message(parts, [None] * len(parts), held)
            parts, held, size = [], [], 0
    if parts:
        yield message(parts, [None] * len(parts), held)


def to_parts(kind: int, key: np.ndarray, columns: list[np.ndarray], n_parts: int) -> Iterator[pa.RecordBatch]:
    """The rows, dealt to parts by their hash."""
    parts = n_parts * max(1, min(FINE, PARTS // n_parts))
    yield from _dealt(kind, (key % np.uint64(parts)).astype(np.int64), columns)


def to_docs(kind: int, docs: np.ndarray, columns: list[np.ndarray], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Answers to documents, dealt to buckets of documents; bucket k is part -1 - k."""
    bucket = (mixed(docs.astype(np.int64).view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
    yield from _dealt(kind, -1 - bucket, [docs, *columns])


def _dealt(kind: int, part: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = np.argsort(part, kind="stable")
    starts, sizes = runs(part[order])
    at = [order[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    yield from messages((int(part[rows[0]]), pack(kind, *(c[rows] for c in columns))) for rows in at)


def by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The messages of each part; the rows come sorted by it, so those of one part are held at a time."""
    part, held = None, []
    for batch in batches:
        parts = batch.column(0).to_numpy()
        for s, n in zip(*(c.tolist() for c in runs(parts)), strict=True):
            if held and parts[s] != part:
                yield part, held
                held = []
            part = int(parts[s])
            held += batch.column(2).slice(s, n).to_pylist()
    if held:
        yield part, held


def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers of some buckets, one row for each document; other messages as they are."""
    for part, held in by_part(batches):
        if part >= 0:
            yield from messages((part, data) for data in held)
            continue
        kind = kind_of(held[0])
        columns = [unpack(data, ANSWERS[kind])[0] for data in held]
        shares = np.uint64(1 + sum(map(len, held)) // SORTED)
        for share in range(int(shares)):
            docs, *rest = joined([_share(c, share, shares) for c in columns])
            order = np.argsort(docs, kind="stable")
            docs, rest = docs[order], [c[order] for c in rest]
            starts, sizes = runs(docs)
            for low in range(0, len(starts), 1024):
                at = list(zip(starts[low : low + 1024].tolist(), sizes[low : low + 1024].tolist(), strict=True))
                data = [pack(kind, *(c[s : s + n] for c in rest)) for s, n in at]
                yield message([-1] * len(at), docs[starts[low : low + 1024]].tolist(), data)


def _share(columns: list[np.ndarray], share: int, shares: np.uint64) -> list[np.ndarray]:
    """The rows of some of a bucket's documents."""
    if shares == 1:
        return columns
    mine = (mixed(columns[0].view(np.uint64)) >> np.uint64(32)) % shares == share
    return [c[mine] for c in columns]


def exchange(
    rows: DataFrame,
    send: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    reduce: Callable[[Iterator[list[bytes]]], Iterator[pa.RecordBatch]],
    n_parts: int,
) -> DataFrame:
    """Answers (part, doc_id, data) to what `send` makes of the rows: its own and those of `reduce`, one row per document.

    Spark sorts the messages of a task by their part, on disk if need be, so `reduce` gets the messages of one part after
    the other and holds no more than one; there may be many more parts than the `n_parts` tasks.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        for batch in batches:
            answers = int(np.searchsorted(batch.column(0).to_numpy(), 0))
            if answers:
                yield batch.slice(0, answers)
            if answers < batch.num_rows:  # behind the answers there are none
                yield from reduce(held for _, held in by_part(chain([batch.slice(answers)], batches)))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n_parts, "part").sortWithinPartitions("part")

    gathered = dealt(rows.mapInArrow(send, MESSAGE)).mapInArrow(gather, MESSAGE)
    return dealt(gathered).mapInArrow(by_document, MESSAGE)


def parts_of(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def repeated_anchors(
    docs: DataFrame, values_of: Callable[[], Callable[[str], np.ndarray]], length: int, seed: int, hot: int
) -> DataFrame:
    """Answers of kind ANCHORS (doc_id, the anchors of the document that occur more than once in all), and of
    kind HOT (no doc_id): anchors that occur `hot` times or more, with their number."""
    n_parts = parts_of(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from send_anchors(batches, values_of(), length, seed, n_parts)

    def reduce(parts: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
        tops = []

        def answers() -> Iterator[Answers]:
            for blobs in parts:
                repeated, top = reduce_anchors(blobs, hot)
                tops.append(top)
                yield from repeated

        yield from answered(answers(), n_parts, ANCHORS)
        key, total = (np.concatenate(c) for c in zip(*tops, strict=True))
        yield message([0], [None], [pack(HOT, key, total)])

    return exchange(docs, send, reduce, n_parts)


def send_anchors(
    batches: Iterator[pa.RecordBatch], values: Callable[[str], np.ndarray], length: int, seed: int, n_parts: int
) -> Iterator[pa.RecordBatch]:
    """The anchors of documents (doc_id, text), some at a time."""
    held, size = [], 0
    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for _, part in stretches(values(text), length):
                grams, at = anchors(part, length, seed)
                if len(at):
                    found = grams[at[np.r_[True, at[1:] != at[:-1]]]]
                    held.append((found, np.full(len(found), NO_ID if doc_id is None else doc_id, np.int64)))
                    size += len(found)
                if size >= FLUSH:
                    yield from flush_anchors(held, n_parts)
                    size = 0
    if size:
        yield from flush_anchors(held, n_parts)


def flush_anchors(held: list[tuple[np.ndarray, np.ndarray]], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Anchors (hash, doc) of this task: those that repeat are answered, one of each is sent with its number."""
    key, doc = joined(held)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    starts, sizes = runs(key)
    many = np.repeat(sizes > 1, sizes)
    if many.any():
        yield from to_docs(ANCHORS, doc[many], [key[many]], n_parts)
    yield from to_parts(ANCHORS, key[starts], [key[starts], doc[starts], sizes.astype("<u4")], n_parts)


def reduce_anchors(blobs: list[bytes], hot: int) -> tuple[list[Answers], tuple[np.ndarray, np.ndarray]]:
    """The answers to the anchors of one part, and the hot ones with their number."""
    key, doc, count = joined([unpack(b, ["<u8", "<i8", "<u4"])[0] for b in blobs])
    order = np.argsort(key, kind="stable")
    key, doc, count = key[order], doc[order], count[order]
    starts, sizes = runs(key)
    many = np.repeat(sizes > 1, sizes)
    total = np.add.reduceat(count.astype(np.int64), starts)
    top = total >= hot
    return ([(doc[many], key[many])] if many.any() else []), (key[starts][top], total[top])


def with_answers(docs: DataFrame, df: DataFrame) -> DataFrame:
    """The documents, with `answer` where they have one."""
    found = df.filter("doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("data").alias("answer"))
    return docs.join(found, F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col("_id"), "left").drop("_id")


def first_of_each(key: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by (key, doc, start), where each key's first row is, and which rows have an earlier one."""
    order = np.lexsort((start, doc, *key))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in key])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = (doc[order] != doc[order[first]]) | (start[order] != start[order[first]])
    return order, order[~same], later


WINDOW_COLUMNS = ["<u8", "<u4", "<i8", "<u4", "<i8"]


def flush_windows(key, check, doc, mark, start, n_parts: int) -> Iterator[pa.RecordBatch]:
    """Windows of this task by their hashes: later ones are answered, the first of each is sent."""
    order, first, later = first_of_each((check, key), doc, start)
    repeated = order[later]
    if len(repeated):
        columns = [mark[repeated], start[repeated], np.ones(len(repeated), "<u4")]
        yield from to_docs(WINDOWS, doc[repeated], columns, n_parts)
    yield from to_parts(WINDOWS, key[first], [c[first] for c in (key, check, doc, mark, start)], n_parts)


def reduce_windows(blobs: list[bytes]) -> Iterator[Answers]:
    key, check, doc, mark, start = joined([unpack(b, WINDOW_COLUMNS)[0] for b in blobs])
    order, _, later = first_of_each((check, key), doc, start)
    repeated = order[later]
    if len(repeated):
        yield doc[repeated], mark[repeated], start[repeated], np.ones(len(repeated), "<u4")


def answered(found: Iterator[Answers], n_parts: int, kind: int = WINDOWS) -> Iterator[pa.RecordBatch]:
    """The answers, gathered to some size, so that a document's bucket gets few messages."""
    held, size = [], 0
    for answers in chain(found, [None]):
        if answers is not None:
            held.append(answers)
            size += len(answers[0])
        if held and (answers is None or size >= ANSWERED):
            doc, *columns = (c.astype(k, copy=False) for c, k in zip(joined(held), ANSWERS[kind], strict=True))
            size = 0
            yield from to_docs(kind, doc, columns, n_parts)


def covered(n: int, length: int, mark: int, answer: bytes | None) -> np.ndarray:
    """Which of n values lie in a repeated window, from the answer (mark, start, how many windows from there)."""
    edge = np.zeros(n + 1, np.int64)
    if answer:
        (of, start, many), _ = unpack(answer, ANSWERS[WINDOWS][1:])
        mine = of == mark
        np.add.at(edge, start[mine], 1)
        np.add.at(edge, start[mine] + many[mine] - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0
