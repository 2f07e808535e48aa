"""Burrows-Wheeler transforms of string collections, merged by interleave refinement.

The transform of a shard lists, for its rotations in order, the symbol before each. Shards are
merged without comparing suffixes again: an interleave says which shard the next row comes from. It
starts with all rows of one shard after another, and each round sorts it, stably, by the symbols
before the rows; after h rounds the rows are in the order of their first h symbols. A boundary
between two rows that appears in round h means that they have h - 1 symbols in common. Taking the two
symbols before a row at once halves the rounds, and tells common prefixes by twos.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """before: the symbols in front of each row (0: the string's end); string, offset: where the row starts."""

    before: np.ndarray
    string: np.ndarray
    offset: np.ndarray


def transform(strings: list[bytes], depth: int, at_once: int = 1) -> Shard:
    """The transform of some strings, rows in the order of their first `depth` symbols or more.

    `at_once` may be 2 for strings without the byte 255, which is in no UTF-8.
    """
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    first = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.uint16) + 1
    symbols[first + sizes - 1] = 0  # the end of a string, below every byte
    string = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(symbols)) - first[string]

    def behind(step: int) -> np.ndarray:
        return first[string] + (offset + step) % sizes[string]

    # Seven symbols of 9 bits are one number, so the doubling starts from seven.
    two = symbols.astype(np.int64) << 9 | symbols[behind(1)]
    four = two << 18 | two[behind(2)]
    key, step = (four << 18 | two[behind(4)]) << 9 | symbols[behind(6)], 7
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]])
        if step >= depth or new[-1] == len(new) - 1:
            break
        rank = np.empty_like(key)
        rank[order] = new
        key = rank * (int(new[-1]) + 1) + rank[behind(step)]
        step *= 2
    before = symbols[first[string] + (offset - 1) % sizes[string]]
    if at_once == 2:
        before = symbols[first[string] + (offset - 2) % sizes[string]] << np.uint16(8) | before
    return Shard(before[order], string[order], offset[order])


def merge(shards: list[Shard], depth: int, at_once: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all shards in the order of their first `depth` symbols (as row numbers, shard after
    shard), and the symbols each has in common with the row before it: at most `depth`, and rounded
    down to a multiple of `at_once`, which must divide `depth`."""
    before = np.concatenate([s.before for s in shards])
    sizes = [len(s.before) for s in shards]
    starts = np.cumsum([0, *sizes])
    small = np.uint8 if len(shards) < 256 else np.int32
    come_from = np.repeat(np.arange(len(shards), dtype=small), sizes)
    n = len(before)
    rows, common = np.arange(n, dtype=np.int32), np.full(n, depth, np.int32)
    common[:1] = 0
    boundary = np.zeros(n, bool)
    boundary[:1] = True
    block = np.zeros(n, np.int32)
    for h in range(at_once, depth + 1, at_once):
        symbol = before[rows]
        order = np.argsort(symbol, kind="stable")
        come_from, symbol, block = come_from[order], symbol[order], block[order]
        now = np.ones(n, bool)
        now[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        common[now & ~boundary] = h - at_once
        for k in range(len(shards)):
            rows[come_from == k] = np.arange(starts[k], starts[k + 1])
        if (now == boundary).all():
            break  # no block was split, so none will be
        boundary, block = now, np.cumsum(now, dtype=np.int32)
    return rows, common


def repeated_rows(strings: list[bytes], shard_of: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places (string, offset) that start a stretch of `length` bytes which starts elsewhere too, and a
    number of the stretch that rises along them."""
    at_once = 2 if length % 2 == 0 and not any(b"\xff" in s for s in strings) else 1
    shards, names = [], []
    for k in np.unique(shard_of):
        of = np.flatnonzero(shard_of == k)
        shards.append(transform([strings[i] for i in of], length, at_once))
        names.append(of[shards[-1].string])
    rows, common = merge(shards, length, at_once)
    string, offset = np.concatenate(names)[rows], np.concatenate([s.offset for s in shards])[rows]
    sizes = np.array([len(s) for s in strings])
    interval = np.cumsum(common < length)
    whole = offset + length <= sizes[string]
    string, offset, interval = string[whole], offset[whole], interval[whole]
    same = interval[1:] == interval[:-1]
    many = np.r_[False, same] | np.r_[same, False] if len(interval) else np.zeros(0, bool)
    return string[many], offset[many], interval[many]


def repeated_starts(strings: list[bytes], shard_of: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The groups of places (string, offset) that start an equal stretch of `length` bytes, two or more each."""
    string, offset, interval = repeated_rows(strings, shard_of, length)
    if not len(interval):
        return []
    cuts = np.flatnonzero(interval[1:] != interval[:-1]) + 1
    return list(zip(np.split(string, cuts), np.split(offset, cuts), strict=True))
