"""Best-fit packing of documents into sequences of a fixed number of tokens.

The pieces are counted per length, and only that histogram (one number per length, so at most as
many as a sequence has tokens) is planned on the driver: a linear program over configurations, each
a multiset of lengths that fits a sequence, is solved by multiplicative weights. A knapsack by
dynamic programming prices the configurations of each round. The solution is rounded down, and what
is left over goes best-fit into the open sequences, longest first. Spark then gives every piece its
rank among the pieces of its length, and the plan says which sequence and place that rank has.

A null text counts as empty: it has the end token alone. Rows that repeat are packed one by one, a
null doc_id is kept, other columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import settle
from .common import slices, slim
from .tokens import word_memory

#: Rounds of the multiplicative weights, and configurations taken from the knapsack table in each.
ROUNDS = 150
COLUMNS = 24
#: Pieces whose rank one task finds, on average.
PIECES_A_BLOCK = 50_000

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def pieces(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    end_id: int = 0,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The token ids of each document and `end_id`, cut into pieces of at most `limit` tokens."""
    more = ", ids binary" if keep_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, end = word_memory(tokenizer), end_id.to_bytes(4, "little")
        for batch in slices(batches):
            rows, parts = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memory.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if keep_ids:
                        parts.append(part)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + more
    return slim(docs, id_col, text_col).mapInArrow(cut, schema)


def knapsack(value: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The best value of each capacity, any length any number of times, and the length taken last (0: none)."""
    best, last = np.zeros(limit + 1), np.zeros(limit + 1, np.int64)
    for size in range(1, limit + 1):
        got = value[1 : size + 1] + best[size - 1 :: -1] if size > 1 else value[1:2] + best[:1]
        k = int(got.argmax())
        if got[k] > best[size - 1]:
            best[size], last[size] = got[k], k + 1
        else:
            best[size], last[size] = best[size - 1], 0
    return best, last


def configurations(value: np.ndarray, present: np.ndarray, limit: int, columns: int) -> list[Pattern]:
    """The best configuration that holds each of the lengths that lead to the most value."""
    best, last = knapsack(value, limit)
    whole = value[present] + best[limit - present]
    found = {}
    for length in present[np.argsort(-whole, kind="stable")[:columns]]:
        took, room = defaultdict(int, {int(length): 1}), limit - int(length)
        while room > 0:
            if last[room]:
                took[int(last[room])] += 1
                room -= int(last[room])
            else:
                room -= 1
        found[tuple(sorted(took.items(), reverse=True))] = None
    return list(found)


def fractional(counts: np.ndarray, limit: int, rounds: int = ROUNDS, columns: int = COLUMNS) -> dict[Pattern, float]:
    """The configuration linear program by multiplicative weights: how often to use each configuration.

    A length that the configurations so far cover less than the others gains weight, so the
    next prices draw it in.
    """
    present = np.flatnonzero(counts)
    need = counts[present].astype(float)
    covered = np.zeros(limit + 1)
    used: dict[Pattern, float] = defaultdict(float)
    volume = float((present * need).sum()) / limit
    share = volume / rounds / columns
    weight = present / limit  # a price of its size, to begin with
    for _ in range(rounds):
        value = np.zeros(limit + 1)
        value[present] = weight
        for pattern in configurations(value, present, limit, columns):
            used[pattern] += share
            for length, n in pattern:
                covered[length] += n * share
        done = np.minimum(covered[present] / need, 4.0)
        weight = present / limit * np.exp(-2.0 * (done - done.min()))
    scale = volume / sum(used.values())
    return {pattern: often * scale for pattern, often in used.items()}


def best_fit(counts: np.ndarray, limit: int) -> dict[Pattern, int]:
    """Best fit, longest first, of whole counts of lengths at a time."""
    open_by_room: dict[int, dict[Pattern, int]] = defaultdict(dict)
    rooms = np.zeros(limit + 1, np.int64)  # open sequences by room
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = int(fits[0]) + length
                pattern, n = next(iter(open_by_room[room].items()))
                most = room // length
            else:
                room, pattern, n, most = limit, (), math.inf, limit // length
            each = min(most, left)
            take = int(min(n, left // each))
            if pattern:
                rooms[room] -= take
                open_by_room[room][pattern] -= take
                if not open_by_room[room][pattern]:
                    del open_by_room[room][pattern]
            grown, after = (*pattern, (length, each)), room - each * length
            rooms[after] += take
            open_by_room[after][grown] = open_by_room[after].get(grown, 0) + take
            left -= take * each
    return {p: n for of in open_by_room.values() for p, n in of.items() if n}


def plan(counts: np.ndarray, limit: int, rounds: int = ROUNDS) -> list[tuple[Pattern, int]]:
    """Configurations and how many sequences take each; together they hold every piece once."""
    left = counts.astype(np.int64).copy()
    used = fractional(left, limit, rounds) if left.any() else {}
    out: dict[Pattern, int] = defaultdict(int)
    for pattern, often in sorted(used.items(), key=lambda x: -x[1]):
        n = min(math.floor(often), *(int(left[length]) // k for length, k in pattern))
        if n > 0:
            out[pattern] += n
            for length, k in pattern:
                left[length] -= n * k
    for pattern, n in best_fit(left, limit).items():
        out[pattern] += n
    return list(out.items())


def slots(of: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of a length go where: (length, first rank, rank behind the last, first sequence, often, offset)."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in of:
        offset = 0
        for length, k in pattern:
            rows.append((length, rank[length], rank[length] + n * k, sequence, k, offset))
            rank[length] += n * k
            offset += length * k
        sequence += n
    return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    end_id: int = 0,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    parts = settle(pieces(docs, tokenizer, limit, end_id, keep_ids, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `limit` rows
    counts = np.zeros(limit + 1, np.int64)
    counts[list(histogram)] = list(histogram.values())
    blocks = max(1, math.ceil(int(counts.sum()) / PIECES_A_BLOCK))
    parts = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        parts.groupBy("length", "block")
        .count()
        .select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = parts.withColumn("inside", inside).join(firsts, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("inside") - 1)
    # As many rows as the plan has places: rounds x columns x the lengths of a configuration at most.
    places = spark.createDataFrame(
        slots(plan(counts, limit)), "length long, low long, high long, sequence long, often long, place long"
    )
    found = ranked.join(F.broadcast(places), "length").filter("rank >= low and rank < high")
    more = ["ids"] if keep_ids else []
    return found.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("sequence + (rank - low) div often").alias("sequence_id"),
        F.expr("place + (rank - low) % often * length").alias("offset"),
        *more,
    )
