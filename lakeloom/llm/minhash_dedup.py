"""Near-duplicate documents by MinHash with tensored banding, confirmed on whole shingle sets.

Two collections of 16 bands of 3 minhashes are computed, 96 minhashes in all. A table's key is a
pair of a band of the first and a band of the second collection, which makes 256 tables of 6
minhashes. Two documents of similarity 0.8 share none of them with a probability of 2e-5.

Documents of equal shingle sets are one vertex, so large groups of copies fall together in an
aggregate before anything is paired. The rows of a first band meet by its hash, 16 per vertex, and
the pairs of bands are formed there. In a table bucket the member that is most central among the rows
of its first band is paired with all others, if their signatures agree on at least 58 of 96 places (a
pair of similarity 0.8 agrees on fewer with a probability below 1e-5). The buckets of a group so mostly
name the same few centres, and a member has a few links, however large its group is. Candidates are
confirmed on whole sets. Members of a bucket that are then still in different components, and whose signatures agree
enough, are compared by the prefix filter over their whole sets, which loses no link. Of a dense group
that would be nearly all pairs between a document on its edge and the others, so they also need odd
sketches (bitmaps of the parity of a set's hashes) that differ in no more bits than linked sets can
differ in shingles, which loses none either. Pairs inside a component are not looked at: they cannot
change it. These figures are for 80 percent and more; for
less, bands are shorter or more, and fewer places must agree, for misses as rare (`scheme`).

Words are runs without white space (space, tab to carriage return), A-Z in lower case. A null or
empty text has an empty set and is linked with nothing. Rows of one doc_id are one document of
several texts; a null doc_id is linked with nothing and has no component. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.bounded import broadcast_if_small
from ..session import settle
from .common import process_store, slices, slim
from .components import components

#: Of 80 percent: bands of a collection, minhashes of a band, minhashes in all at least.
BANDS, ROWS, PLACES = 16, 3, 96
#: A pair as similar as asked shares no table key, or agrees on too few places, with these probabilities at most.
NO_TABLE, NO_AGREEMENT = 2.5e-5, 5e-6
#: Members of a small table bucket, and centres of a larger one.
SMALL, CENTRES = 12, 1
#: Bits of an odd sketch: with so many it tells sets of up to some 4,000 shingles apart.
ODD_BITS = 2048
#: Documents that have a rare shingle at most.
RARE = 16
#: Ids that are broadcast at most to pick the texts to confirm; more are joined by a shuffle.
MAX_IDS = 1_000_000
#: Word hashes that a worker remembers; of natural text these are nearly all that come again, in some 30 MB.
MEMORY = 200_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Scheme:
    """Bands of a collection, minhashes of a band, minhashes in all, and how many of them must agree."""

    bands: int
    rows: int
    places: int
    agree: int


def scheme(percent: int) -> Scheme:
    """The longest bands, and the most agreeing places, that miss a pair of `percent` rarely enough."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent is {percent}, not 1 to 100")
    s = min(percent, 80) / 100
    needed = {r: max(BANDS, math.ceil(math.log(NO_TABLE / 2) / math.log(1 - s**r))) for r in range(ROWS, 0, -1)}
    rows = next((r for r, n in needed.items() if n <= 2 * BANDS), 1)
    bands = needed[rows]
    places = max(PLACES, 2 * bands * rows)
    agree, below = 0, 0.0
    while True:
        log_p = math.lgamma(places + 1) - math.lgamma(agree + 1) - math.lgamma(places - agree + 1)
        below += math.exp(log_p + agree * math.log(s) + (places - agree) * math.log(1 - s))
        if below > NO_AGREEMENT:
            return Scheme(bands, rows, places, agree)
        agree += 1


class WordHashes(dict):
    """A 64-bit hash of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        raw = hashlib.blake2b(word, digest_size=8).digest()
        value = self[word] = int.from_bytes(raw, "little")
        return value


def shingles(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct hashes of `width` consecutive words, in order; of fewer words, the hash of all."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and white space of ASCII
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + len(out)]) * _M1
        out ^= out >> np.uint64(29)
    return np.unique(out * _M2)


def multipliers(places: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**32, places, dtype=np.uint32) | np.uint32(1)


def signature(of: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The minhashes of a set: the least of its hashes under each multiplication modulo 2**32."""
    out = np.full(len(by), np.iinfo(np.uint32).max)
    high = (of >> np.uint64(32)).astype(np.uint32)
    for low in range(0, len(high), 4096):  # bounds the memory of a very long text
        out = np.minimum(out, (high[None, low : low + 4096] * by[:, None]).min(axis=1))
    return out


def band_keys(minhashes: np.ndarray, by: Scheme) -> np.ndarray:
    """A key for each band of the first collection, different from band to band."""
    rows = minhashes[: by.bands * by.rows].reshape(by.bands, by.rows).astype(np.uint64)
    key = np.arange(by.bands, dtype=np.uint64) * _M2
    for k in range(by.rows):
        key = (key ^ rows[:, k]) * _M1
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def odd_sketch(of: np.ndarray) -> np.ndarray:
    """A bit for each of ODD_BITS cells of the hashes: whether it holds an odd number of the set's.

    Two sketches differ in at most as many bits as there are hashes in one set alone.
    """
    cells = (of >> np.uint64(64 - (ODD_BITS - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=ODD_BITS) & 1).astype(np.uint8))


def can_differ(one: np.ndarray, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which `others` differ from `one` in no more bits than sets so similar can; `sizes` are of both sets together."""
    apart = np.bitwise_count(others.view(np.uint64) ^ one.view(np.uint64)).sum(axis=1, dtype=np.int64)
    return apart * (100 + percent) <= sizes * (100 - percent)


def vertices(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_hash, and for non-empty sets sig (a byte per minhash) and bands."""
    plan = scheme(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, by = process_store("word_hashes", WordHashes), multipliers(plan.places)
        for batch in slices(batches):
            sizes, of, sigs, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, width, hashes)
                sizes.append(len(s))
                of.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = signature(s, by)
                sigs.append(m.astype(np.uint8).tobytes() if len(s) else None)
                bands.append(band_keys(m, plan) if len(s) else None)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "set_hash": pa.array(of, pa.binary()),
                    "sig": pa.array(sigs, pa.binary()),
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                }
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sig binary, bands array<long>")


def _agreeing(
    a: np.ndarray, b: np.ndarray, size: np.ndarray, sig: np.ndarray, percent: int, plan: Scheme
) -> np.ndarray:
    """Which of the pairs (a, b) of rows can be as similar as asked."""
    low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    ok = low * 100 >= high * percent
    out = np.zeros(len(a), bool)
    at = np.flatnonzero(ok)
    for k in range(0, len(at), 100_000):
        i = at[k : k + 100_000]
        out[i] = (sig[a[i]] == sig[b[i]]).sum(axis=1) >= plan.agree
    return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of equal keys, and where each run of two or more starts and how long it is."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    return order, starts[sizes > 1], sizes[sizes > 1]


def table_buckets(band: np.ndarray, sig: np.ndarray, by: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each band of the second collection: rows, and starts and sizes of the runs that share both bands."""
    order, starts, sizes = _runs(band)
    rows = order[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
    n = by.bands * by.rows
    second = sig[rows, n : 2 * n].reshape(-1, by.bands, by.rows).astype(np.uint64)
    first = band[rows].view(np.uint64)
    places = np.uint64(8) * np.arange(by.rows, dtype=np.uint64)
    for j in range(by.bands):
        key = (first ^ np.bitwise_or.reduce(second[:, j] << places, axis=1) * _M1) * _M2
        inner, at, many = _runs(key)
        yield rows[inner], at, many


def central_first(band: np.ndarray, sig: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """An order of the rows in which, of each band, those come first that agree with the others on most places."""
    order, starts, sizes = _runs(band)
    score = np.zeros(len(band), np.int64)
    for low in range(0, len(starts), 4096):  # bounds the memory of the counts
        many = sizes[low : low + 4096]
        of = np.repeat(np.arange(len(many)), many)
        rows = order[np.repeat(starts[low : low + 4096] - (np.cumsum(many) - many), many) + np.arange(len(of))]
        for place in sig[rows].T:
            key = of * 256 + place
            score[rows] += np.bincount(key)[key]
    return np.lexsort((ids, -score, band))


def pair_up(
    band: np.ndarray, size: np.ndarray, sig: np.ndarray, percent: int, plan: Scheme
) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows, one row for each column, and the rows in buckets of more than two.

    In a bucket the first row is paired with all others, the first CENTRES rows in a large one.
    """
    found, large = [np.zeros((2, 0), np.int64)], [np.zeros(0, np.int64)]
    for rows, at, many in table_buckets(band, sig, plan):
        for k in range(max(1, CENTRES)):
            asked = many > (SMALL if k else 1)
            first, rest = at[asked] + k, np.maximum(many[asked] - 1 - k, 0)
            others = np.repeat(first + 1 - (np.cumsum(rest) - rest), rest) + np.arange(int(rest.sum()))
            found.append(np.stack([np.repeat(rows[first], rest), rows[others]]))
        inside = np.zeros(len(rows) + 1, np.int64)
        np.add.at(inside, at[many > 2], 1)
        np.add.at(inside, (at + many)[many > 2], -1)
        large.append(rows[np.cumsum(inside[:-1]) > 0])
    both = np.sort(np.concatenate(found, axis=1), axis=0)
    both = both[:, both[0] != both[1]]
    key = np.unique(both[0] * len(band) + both[1])
    both = np.stack([key // max(len(band), 1), key % max(len(band), 1)])
    return both[:, _agreeing(both[0], both[1], size, sig, percent, plan)], np.unique(np.concatenate(large))


def still_open(
    band: np.ndarray, size: np.ndarray, sig: np.ndarray, label: np.ndarray, percent: int, plan: Scheme
) -> np.ndarray:
    """Rows that share a bucket with a row of another component they can be linked with."""
    out = np.zeros(len(band), bool)
    for rows, at, many in table_buckets(band, sig, plan):
        if not len(at):
            continue
        ends = np.stack([at, at + many], axis=1).ravel()
        of = label[np.r_[rows, rows[-1:]]]
        mixed = np.minimum.reduceat(of, ends)[::2] != np.maximum.reduceat(of, ends)[::2]
        for first, m in zip(at[mixed].tolist(), many[mixed].tolist(), strict=True):
            bucket = rows[first : first + m]
            names, inverse, counts = np.unique(label[bucket], return_inverse=True, return_counts=True)
            for x in bucket[inverse != counts.argmax()]:
                other = bucket[label[bucket] != label[x]]
                if out[x]:
                    other = other[~out[other]]
                near = _agreeing(np.full(len(other), x), other, size, sig, percent, plan)
                out[other[near]] = True
                out[x] |= near.any()
    return out


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """band, id, n, sig and any more columns of a partition: rows of about 120 bytes, one a band, for each of its vertices."""
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return None
    table = pa.Table.from_batches(batches)
    band, ids, size, *more = (table.column(k).to_numpy() for k in (0, 1, 2, *range(4, table.num_columns)))
    sig = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
    return band, ids, size, sig, *more


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """From (band, id, n, sig) to (a, b, mark): pairs of ids, or with `mark` (band, id) in a bucket of more than two."""
    plan = scheme(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _columns(batches)
        if columns:
            band, ids, size, sig = columns
            order = central_first(band, sig, ids)
            band, ids, size, sig = (c[order] for c in (band, ids, size, sig))
            pairs, large = pair_up(band, size, sig, percent, plan)
            a, b = np.minimum(ids[pairs[0]], ids[pairs[1]]), np.maximum(ids[pairs[0]], ids[pairs[1]])
            for x, y, mark in ((a, b, False), (band[large], ids[large], True)):
                yield pa.RecordBatch.from_pydict(
                    {"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64()), "mark": pa.array(np.full(len(x), mark))}
                )

    return rows.select("band", "id", "n", "sig").repartition("band").mapInArrow(run, "a long, b long, mark boolean")


def unresolved(rows: DataFrame, percent: int) -> DataFrame:
    """From (band, id, n, sig, label) to the ids that may still be linked with another component."""
    plan = scheme(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _columns(batches)
        if columns:
            band, ids, size, sig, label = columns
            found = np.unique(ids[still_open(band, size, sig, label, percent, plan)])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(found, pa.int64())})

    return rows.select("band", "id", "n", "sig", "label").repartition("band").mapInArrow(run, "doc_id long").distinct()


def by_prefixes(open_: DataFrame, docs: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among some documents, without loss but for the rare one by `_agreeing`.

    Two sets of n shingles or more that are similar enough have one in common among the rarest
    n - ceil(n * percent / 100) + 1 of each. In a dense group a document that is not close to the
    centre has many shingles of its own, which come first, and what it can have in common with any
    other is at most the rest. `labels` has id, n, sig and label.
    """
    plan = scheme(percent)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = process_store("word_hashes", WordHashes)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text, width, hashes).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"id": pa.array(np.full(len(s), doc_id)), "n": pa.array(np.full(len(s), len(s))), "shingle": pa.array(s)}
                )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = process_store("word_hashes", WordHashes)
        for batch in slices(batches):
            sets = [shingles(text, width, hashes) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "odd": pa.array([odd_sketch(s).tobytes() for s in sets], pa.binary()),
                }
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        shingle, ids, size, common, label = (table.column(k).to_numpy() for k in range(5))
        sig, odd = (np.frombuffer(b"".join(table.column(k).to_pylist()), np.uint8).reshape(len(ids), -1) for k in (5, 6))
        order, starts, sizes = _runs(shingle)
        found = [np.zeros((2, 0), np.int64)]
        for first, m in zip(starts.tolist(), sizes.tolist(), strict=True):
            rows = order[first : first + m]
            names, inverse, counts = np.unique(label[rows], return_inverse=True, return_counts=True)
            for x in rows[inverse != counts.argmax()] if len(names) > 1 else ():
                other = rows[label[rows] != label[x]]
                # They have at most so many in common that each shares with any other.
                most = np.minimum(common[other], common[x])
                other = other[most * (100 + percent) >= percent * (size[other] + size[x])]
                other = other[_agreeing(np.full(len(other), x), other, size, sig, percent, plan)]
                other = other[can_differ(odd[x], odd[other], size[other] + size[x], percent)]
                found.append(np.stack([np.minimum(ids[other], ids[x]), np.maximum(ids[other], ids[x])]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_pydict({"a": pa.array(both[0]), "b": pa.array(both[1])})

    chosen = docs.join(broadcast_if_small(open_, MAX_IDS), "doc_id", "left_semi").select("doc_id", "text")
    tokens = settle(chosen.mapInArrow(spell, "id long, n long, shingle long"), "shingles")
    seen = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
    shared = tokens.join(seen, "shingle").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "shingle"))).alias("shared"))
    # The shingles of one document alone come first in its order; only the rest of the prefix can meet.
    place = F.expr(f"n - cast(ceil(n * {percent} / 100) as long) + 1 - (n - size(shared))")
    prefix = shared.withColumn("place", place.cast("int")).filter("place > 0")
    often = F.size(F.filter("shared", lambda s: s["seen"] > RARE))
    rows = prefix.select("id", "n", "shared", often.alias("often"), F.explode(F.expr("slice(shared, 1, place)")).alias("s"))
    # Prefixes that reach an often seen shingle hold all rare ones of their sets: two that meet there have either
    # met at a rare one as well, or have no rare one in common.
    rows = rows.withColumn("common", F.when(F.col("s.seen") > RARE, F.col("often")).otherwise(F.size("shared")))
    sketches = settle(chosen.mapInArrow(sketch, "id long, n long, odd binary").distinct(), "sketches")
    named = rows.join(labels.join(sketches, ["id", "n"]), ["id", "n"]).select("s.shingle", "id", "n", "common", "label", "sig", "odd")
    return named.repartition("shingle").mapInArrow(meet, "a long, b long").distinct()


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are as similar as asked."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = process_store("word_hashes", WordHashes)
        for batch in slices(batches):
            sets = [shingles(t, width, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "of": pa.array(sets, pa.binary())})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(u, v)
                both = int((u[np.minimum(at, len(u) - 1)] == v).sum())
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    chosen = docs.join(broadcast_if_small(ids, MAX_IDS), "doc_id", "left_semi").select("doc_id", "text")
    sets = settle(chosen.mapInArrow(sets_of, "id long, of binary"), "sets")
    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("of").alias("of_a")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("of").alias("of_b")), "b")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * shingles in both >= percent * shingles in either; `width` words
    make a shingle. component_id is the least doc_id that can be reached over links.
    """
    base = slim(docs, id_col, text_col)
    every = settle(vertices(base, width, percent), "vertices")
    # Equal sets are one vertex, named by its least id.
    reps = settle(
        every.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("set_hash", F.col("n_shingles").alias("n"), "sig")
        .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")),
        "sets-once",
    )
    rows = reps.select(F.explode("bands").alias("band"), "id", "n", "sig")
    found = settle(candidates(rows, percent), "candidates")
    pairs = found.filter("not mark").select("a", "b").distinct()
    links = settle(confirm(pairs, base, width, percent), "confirmed")
    # The same id may name several sets: rows of one doc_id are one document.
    of = components(links)
    marked = found.filter("mark").select(F.col("a").alias("band"), F.col("b").alias("id")).distinct()
    if not marked.isEmpty():
        labels = reps.join(of, "id", "left").select("id", "n", "sig", F.coalesce("component", "id").alias("label"))
        labelled = marked.join(labels, "id")
        open_ = settle(unresolved(labelled, percent), "unresolved")
        if not open_.isEmpty():
            later = settle(by_prefixes(open_, base, labels, width, percent), "candidates")
            more = confirm(later, base, width, percent)
            # What is known by now is a link from each vertex to the name of its component.
            of = components(of.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = reps.select("set_hash", "id").join(of, "id", "left").select("set_hash", F.coalesce("component", "id").alias("reached"))
    # A document of several texts reaches what any of them reaches.
    classes = every.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("reached")).otherwise(F.col("doc_id")))
    out = classes.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def remove_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group; the columns stay as they are."""
    drop = near_duplicates(docs, width, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_id"))
    return docs.join(drop.distinct(), docs[id_col].cast("long") == F.col("_id"), "left_anti")
