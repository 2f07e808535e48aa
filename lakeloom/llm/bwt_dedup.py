"""Repeated byte passages, found in merged Burrows-Wheeler transforms.

A byte is removed if a 100-byte string that also starts earlier (in a smaller doc_id, or earlier in
the same document) covers it. Which stretches can hold such a string at all is found by winnowed
anchors: the 32-byte sequence of least hash in each 100-byte window. Windows with an anchor that
occurs once are out. The others go, in the stretches around their anchor, to the reducer of the
anchor. Equal stretches are one string there, and what has no window whose hash occurs again is left
out. The strings that share an anchor are dealt to shards, each shard is transformed by itself, and the transforms are merged by interleave refinement: the rows
that have 100 bytes in common with their neighbours are the repeated strings, and all but the
earliest of each interval are answered to their documents.

An anchor of very many occurrences (a line that a third of the documents have) would gather its
stretches in one reducer. Its windows are dealt by their own hashes (96 bits) instead, and every
task combines equal ones before it sends them; the result is the same.

Texts are taken as UTF-8. A null text is empty. Rows of one doc_id are parts of one document that start
anew; a row that repeats is cut like the row it repeats. A null doc_id comes after all others. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import settle
from .bwt import repeated_rows
from .common import slices, slim
from .seeds import (
    BYTE_VALUES, FINE, HOT, NO_ID, SEGMENTS, WINDOWS, Answers, anchors, answered, covered, exchange, flush_windows, kind_of, messages, pack, parts_of,
    reduce_windows, repeated_anchors, rolling, runs, stretches, to_docs, unpack, with_answers,
)

SEED = 32
#: Occurrences from which an anchor may be hot; the share of all anchors from which it is, so there
#: are fewer hot anchors than one by this share.
HOT_LEAST, HOT_SHARE = 1024, 1e-5
#: Bytes of strings that are transformed together, and shards they are dealt to. A transform takes some hundred
#: times its bytes in memory.
TOGETHER, SHARDS = 1 << 20, 2
#: Windows of a task, and bytes of its stretches, that are combined and sent at once.
FLUSH, FLUSH_BYTES = 1_000_000, 24 << 20

SEGMENT_COLUMNS = ["<u8", "<i8", "<u4", "<i8", "<u4", "<u4"]


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _values():
    return lambda text: np.frombuffer(_raw(text), np.uint8)


def _among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in `of`, which is sorted."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _earliest(doc: np.ndarray, start: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first of each equal strings by (doc, start), in that order, and the later ones, without rows that repeat the first."""
    seen, first, later = {}, [], []
    docs, starts = doc.tolist(), start.tolist()
    for k in np.lexsort((start, doc)).tolist():
        of = seen.setdefault(strings[k], k)
        if of == k:
            first.append(k)
        elif docs[of] != docs[k] or starts[of] != starts[k]:
            later.append(k)
    return np.array(first, np.int64), np.array(later, np.int64)


def flush_segments(held: list[tuple], strings: list[bytes], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Stretches (columns of anchor, doc, mark, start, windows; and the bytes) of this task: later equal ones are
    answered, the first is sent."""
    columns = [np.concatenate(c).astype(k) for c, k in zip(zip(*held, strict=True), SEGMENT_COLUMNS[:-1], strict=True)]
    anchor, doc, mark, start, many = columns
    first, later = _earliest(doc, start, strings)
    if len(later):
        yield from to_docs(WINDOWS, doc[later], [mark[later], start[later], many[later]], n_parts)
    part = (anchor[first] % np.uint64(n_parts * FINE)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    first, part = first[order], part[order]

    def packed() -> Iterator[tuple[int, bytes]]:
        for s, n in zip(*(c.tolist() for c in runs(part)), strict=True):
            rows = first[s : s + n]
            of = [strings[k] for k in rows.tolist()]
            size = np.array([len(x) for x in of], SEGMENT_COLUMNS[-1])
            yield int(part[s]), pack(SEGMENTS, *(c[rows] for c in columns), size, tail=b"".join(of))

    yield from messages(packed())


def reduce_segments(blobs: list[bytes], length: int) -> Iterator[Answers]:
    """The answers to the stretches of some anchors, with all occurrences of each."""
    held, strings = [], []
    for blob in blobs:
        (*columns, size), tail = unpack(blob, SEGMENT_COLUMNS)
        end = np.cumsum(size.astype(np.int64))
        strings += [tail[e - n : e] for e, n in zip(end.tolist(), size.tolist(), strict=True)]
        held.append(columns)
    anchor, doc, mark, start, many = (np.concatenate(c) for c in zip(*held, strict=True))
    first, later = _earliest(doc, start, strings)
    if len(later):
        yield doc[later], mark[later], start[later], many[later]
    # Families of one string have nothing to compare; the others are merged, several at a time.
    first = first[np.argsort(anchor[first], kind="stable")]
    batch, size = [], 0
    for s, n in zip(*(c.tolist() for c in runs(anchor[first])), strict=True):
        if n > 1:
            family = first[s : s + n].tolist()
            batch += family
            size += sum(len(strings[k]) for k in family)
        if batch and (size >= TOGETHER or s + n == len(first)):
            rows = np.array(batch, np.int64)
            yield from _merged(doc[rows], mark[rows], start[rows], [strings[k] for k in batch], length)
            batch, size = [], 0


def _trimmed(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings with windows whose hash occurs again in the batch, and the first and last of those windows."""
    sizes = np.array([len(s) for s in strings])
    many = sizes - length + 1
    first = np.cumsum(sizes) - sizes
    hashes = rolling(BYTE_VALUES[np.frombuffer(b"".join(strings), np.uint8)], length)
    of = np.repeat(np.arange(len(strings)), many)
    inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    key = hashes[first[of] + inside]
    del hashes
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    of, inside = of[again], inside[again]
    starts, counts = runs(of)
    return of[starts], inside[starts], inside[starts + counts - 1]


def _merged(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, strings: list[bytes], length: int) -> Iterator[Answers]:
    of, low, high = _trimmed(strings, length)
    if not len(of):
        return
    doc, mark, base = doc[of], mark[of], start[of] + low
    cut = [strings[k][a : b + length] for k, a, b in zip(of.tolist(), low.tolist(), high.tolist(), strict=True)]
    string, offset, stretch = repeated_rows(cut, np.arange(len(cut)) % SHARDS, length)
    d, at = doc[string], base[string] + offset
    # Within each stretch the places by (doc, start); all but the first are answered.
    order = np.lexsort((at, d, stretch))
    string, d, at = string[order], d[order], at[order]
    starts, sizes = runs(stretch[order])
    first = np.repeat(starts, sizes)
    later = (d != d[first]) | (at != at[first])
    if later.any():
        yield _in_runs(d[later], mark[string[later]], at[later])


def _in_runs(doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> Answers:
    """The windows, those that follow on as one answer."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start = doc[order], mark[order], start[order]
    begins = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] - start[:-1] > 1)])
    last = np.r_[begins[1:], len(doc)] - 1
    return doc[begins], mark[begins], start[begins], (start[last] - start[begins] + 1).astype("<u4")


def repeated_bytes(
    docs: DataFrame, length: int = 100, seed: int = SEED, hot_least: int = HOT_LEAST, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, kept with `keep_text`).

    `spans` are the removed stretches as (first byte, behind the last); `kept` are the bytes left.
    """
    base = slim(docs, id_col, text_col)
    n_parts = parts_of(base)
    found = settle(repeated_anchors(base, _values, length, seed, hot_least), "anchors", drop_shuffles=True)
    hot = hot_anchors(found, hot_least)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.list_(pa.list_(pa.int64())), pa.binary()] if keep_text else [])]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if keep_text else [])]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", spans array<array<long>>, kept binary" if keep_text else ""

    def row(raw: bytes, cut: np.ndarray | None) -> tuple:
        spans, kept = [], raw
        if cut is not None and cut.any():
            spans = np.flatnonzero(np.diff(np.r_[0, cut.astype(np.int8), 0])).reshape(-1, 2).tolist()
            kept = np.frombuffer(raw, np.uint8)[~cut].tobytes()
        out = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        return (*out, spans, kept) if keep_text else out

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without a repeated anchor are done; the others keep text and anchors."""
        for batch in slices(batches):
            out = []
            for text, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if data:
                    hashes = np.unique(unpack(data, ["<u8"])[0][0])
                    out.append((text, hashes.tobytes(), *[None] * len(kinds)))
                else:
                    out.append((None, None, *row(_raw(text), None)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.binary(), *kinds], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "text", "seeds", *names])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, strings, held, windows, size = [], [], 0, [], 0
        for batch in slices(batches):
            for doc_id, text, seeds_ in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = _raw(text)
                mark = zlib.crc32(raw)
                doc = NO_ID if doc_id is None else doc_id
                repeated = np.frombuffer(seeds_, "<u8")
                for low, part in stretches(np.frombuffer(raw, np.uint8), length):
                    grams, at = anchors(part, length, seed)
                    first, many = runs(at)
                    anchor = grams[at[first]]
                    open_ = _among(anchor, repeated)
                    dealt = open_ & _among(anchor, hot)
                    sent = open_ & ~dealt
                    if sent.any():
                        begin, n = first[sent] + low, many[sent]
                        strings += [raw[a:b] for a, b in zip(begin.tolist(), (begin + n - 1 + length).tolist(), strict=True)]
                        segments.append((anchor[sent], np.full(len(n), doc), np.full(len(n), mark, "<u4"), begin, n))
                        held += int(n.sum()) + len(n) * (length - 1)
                    if dealt.any():
                        start = np.flatnonzero(np.repeat(dealt, many))
                        key, check = rolling(part, length)[start], rolling(part, length, 1)[start] >> np.uint64(32)
                        full = np.full(len(start), doc, np.int64)
                        windows.append((key, check.astype("<u4"), full, np.full(len(start), mark, "<u4"), start + low))
                        size += len(start)
                if held >= FLUSH_BYTES:
                    yield from flush_segments(segments, strings, n_parts)
                    segments, strings, held = [], [], 0
                if size >= FLUSH:
                    yield from flush_windows(*(np.concatenate(c) for c in zip(*windows, strict=True)), n_parts)
                    windows, size = [], 0
        if held:
            yield from flush_segments(segments, strings, n_parts)
        if size:
            yield from flush_windows(*(np.concatenate(c) for c in zip(*windows, strict=True)), n_parts)

    def reduce(parts: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
        def answers() -> Iterator[Answers]:
            for blobs in parts:
                kinds = [kind_of(b) for b in blobs]
                if WINDOWS in kinds:
                    yield from reduce_windows([b for b, k in zip(blobs, kinds, strict=True) if k == WINDOWS])
                if SEGMENTS in kinds:
                    yield from reduce_segments([b for b, k in zip(blobs, kinds, strict=True) if k == SEGMENTS], length)

        yield from answered(answers(), n_parts)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = _raw(text)
                out.append(row(raw, covered(len(raw), length, zlib.crc32(raw), data)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    # Anchors and texts pass a shuffle each before the stretches, the largest of all, are sent; those are gone when
    # the texts meet the answers.
    open_schema = schema.replace("doc_id long", "doc_id long, text string, seeds binary")
    sorted_out = settle(with_answers(base, found).mapInArrow(sort_out, open_schema), "sorted-out", drop_shuffles=True)
    done = sorted_out.filter("text is null").drop("text", "seeds")
    open_ = sorted_out.filter("text is not null").select("doc_id", "text", "seeds")
    repeats = settle(exchange(open_, send, reduce, n_parts), "repeats", drop_shuffles=True)
    return done.unionByName(with_answers(open_.select("doc_id", "text"), repeats).mapInArrow(finish, schema))


def hot_anchors(found: DataFrame, least: int) -> np.ndarray:
    """The anchors with a share of at least HOT_SHARE of the occurrences of all that can be hot, and `least`
    occurrences; fewer than 1 / HOT_SHARE, so they fit the driver and every task."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [unpack(d, ["<u8", "<i8"])[0][1] for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(c.sum()) for c in counts], pa.int64())})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.column(0).to_pylist():
                (key, count), _ = unpack(d, ["<u8", "<i8"])
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[count >= bound].view(np.int64), pa.int64())})

    listed = found.filter("doc_id is null").select("data")
    all_ = listed.mapInArrow(total, "n long").agg({"n": "sum"}).first()[0] or 0
    bound = max(least, int(all_ * HOT_SHARE))
    rows = listed.mapInArrow(pick, "key long").collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))
