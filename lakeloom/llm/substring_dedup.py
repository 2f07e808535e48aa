"""Repeated passages of words, by seed and extend.

Documents meet on winnowed anchors: of each window of 20 words the 8-word sequence with the least
hash. An anchor that occurs once rules its windows out. Around the anchors that occur again, the
match is extended both ways to whole windows, which meet by their hashes (96 bits); a window is
repeated if an equal one starts earlier (in a smaller doc_id, or earlier in the same document), and
neighbouring repeated windows join into maximal repeats, which are cut.

Words are runs without white space (space, tab to carriage return). A null text has no words. Rows of
one doc_id are parts of one document that start anew; a row that repeats is cut like the row it
repeats. A null doc_id comes after all others. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import process_store, slices, slim
from .seeds import (
    NO_ID, FLUSH, anchors, answered, covered, exchange, flush_windows, joined, parts_of, reduce_windows, repeated_anchors,
    rolling, stretches, unpack, with_answers,
)

SEED = 8
#: Words whose values a worker remembers, at some 150 bytes each.
MEMORY = 1 << 17


class WordValues(dict):
    """A 64-bit value for each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        raw = hashlib.blake2b(word, digest_size=8).digest()
        value = self[word] = int.from_bytes(raw, "little")
        return value


def _words(text: str) -> list[bytes]:
    """Runs without white space; splitting bytes knows the six ASCII characters of it only."""
    return text.encode("utf-8", "surrogatepass").split()


def _values():
    memory = process_store("word_values", WordValues)

    def of(text: str) -> np.ndarray:
        words = _words(text)
        return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))

    return of


def _mark(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def send_windows(
    batches: Iterator[pa.RecordBatch], values: Callable[[str], np.ndarray], length: int, seed: int, n_parts: int
) -> Iterator[pa.RecordBatch]:
    """The windows of documents (doc_id, text, anchors) that have one of the anchors, some at a time."""
    held, size = [], 0
    for batch in slices(batches):
        for doc_id, text, seeds_ in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for low, part in stretches(values(text), length):
                grams, at = anchors(part, length, seed)
                start = np.flatnonzero(np.isin(grams, np.frombuffer(seeds_, "<u8"))[at])
                if len(start):
                    key, check = rolling(part, length)[start], rolling(part, length, 1)[start] >> np.uint64(32)
                    doc = np.full(len(start), NO_ID if doc_id is None else doc_id, np.int64)
                    mark = np.full(len(start), _mark(text), "<u4")
                    held.append((key, check.astype("<u4"), doc, mark, start + low))
                    size += len(start)
                if size >= FLUSH:
                    yield from flush_windows(*joined(held), n_parts)
                    size = 0
    if size:
        yield from flush_windows(*joined(held), n_parts)


def repeated_passages(
    docs: DataFrame, length: int = 20, seed: int = SEED, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and spans, kept with `keep_text`).

    `spans` are the maximal repeats as (first word, behind the last); `kept` is the text of the words
    that are left, joined by single spaces.
    """
    base = slim(docs, id_col, text_col)
    n_parts = parts_of(base)
    seeds = settle(repeated_anchors(base, _values, length, seed, hot=1 << 62), "anchors")
    more = ", spans array<array<int>>, kept string" if keep_text else ""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + more

    def row(words: list[bytes], cut: np.ndarray) -> tuple:
        kept = [w for w, c in zip(words, cut.tolist(), strict=True) if not c] if cut.any() else words
        if not keep_text:
            return len(words), len(words) - len(kept), _sha(kept)
        edges = np.flatnonzero(np.diff(np.r_[0, cut.astype(np.int8), 0])).reshape(-1, 2).tolist()
        return len(words), len(words) - len(kept), _sha(kept), edges, b" ".join(kept).decode("utf-8", "surrogatepass")

    kinds = [pa.int64(), pa.int64(), pa.string(), *([pa.list_(pa.list_(pa.int32())), pa.string()] if keep_text else [])]
    names = ["n_words", "n_removed", "kept_sha256", *(["spans", "kept"] if keep_text else [])]

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without a repeated anchor are done; the others keep text and anchors."""
        for batch in slices(batches):
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if found:
                    hashes = np.unique(unpack(found, ["<u8"])[0][0])
                    out.append((text, hashes.tobytes(), *[None] * len(kinds)))
                else:
                    words = _words(text)
                    out.append((None, None, *row(words, np.zeros(len(words), bool))))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.binary(), *kinds], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "text", "seeds", *names])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from send_windows(batches, _values(), length, seed, n_parts)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _words(text)
                out.append(row(words, covered(len(words), length, _mark(text), found)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    sorted_out = settle(
        with_answers(base, seeds).mapInArrow(sort_out, schema.replace("doc_id long", "doc_id long, text string, seeds binary")),
        "sorted-out",
    )
    done = sorted_out.filter("text is null").drop("text", "seeds")
    open_ = sorted_out.filter("text is not null").select("doc_id", "text", "seeds")

    def reduce(parts: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
        yield from answered((found for blobs in parts for found in reduce_windows(blobs)), n_parts)

    repeats = exchange(open_, send, reduce, n_parts)
    return done.unionByName(with_answers(open_.select("doc_id", "text"), repeats).mapInArrow(finish, schema))


def remove_repeated_passages(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text that is left of each document."""
    return repeated_passages(docs, length, keep_text=True, id_col=id_col, text_col=text_col).select("doc_id", F.col("kept").alias("text"))
