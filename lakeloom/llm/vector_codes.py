"""Product codes of vectors by Lloyd's rounds with norm-of-sum bounds, in whole numbers.

A vector's components become floor(1024 * x) and are cut into `parts` consecutive parts. Each part
position has a codebook, at first that part of the vectors of the smallest ids. A round assigns every
part to the nearest entry (squared Euclidean distance, ties to the lower index) and moves each entry
to floor(sum / count) of its parts; unused entries stay. After the last round parts are assigned once
more.

Entries form a few groups. A part keeps, per group, a lower bound of its distance to the group's
entries (its own excepted) and the round in which the bound was found. The codebooks of all rounds are
retained, so that in a later round a bound is lowered by the true net displacement of the entries since
its stamp, the norm of the sum of their moves, and not by the sum of the norms. Only a group whose bound
is not above the exact distance to the own entry is scanned again. Distances are exact integers: in
floating point while they are below 2**53, else in a longer or unbounded type.

A round is one pass in which each task keeps the state of its rows and adds up its parts per entry;
nothing is shuffled but those sums, a row per entry and task. The driver holds the codebooks alone,
entries * dimension numbers a round. The state is written to the shared folder, which is also where a
lost executor's work is taken up again, and the state before it is deleted.

Rows whose vector is null, holds null or non-finite components, or is not as long as that of the
smallest kept id, are dropped. Components saturate at 2**60, errors at 2**63 - 1. A dimension that
`parts` does not divide is cut as evenly as possible. A null id comes last; rows that repeat an id
are rows of their own, in the order of their vectors. With fewer rows than entries the codebook has
as many entries as rows. Null labels are one label. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.bounded import broadcast_if_small
from ..session import new_path, settle
from .common import discard, slices

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Groups of entries, each with a bound.
GROUPS = 8
#: Rows that are assigned at once.
ROWS = 2048
LIMIT, LONGEST = 2**60, 2**63 - 1
#: A label of more than one in so many rows is hot, so there are fewer hot labels than this.
HOT_SHARE = 1000


@dataclass
class Codebooks:
    """The entries after each round (k x dimension), where the parts begin and end, and the group of each entry by part."""

    rounds: list[np.ndarray]
    cuts: list[int]
    groups: list[np.ndarray]

    @classmethod
    def start(cls, vectors: np.ndarray, parts: int, groups: int) -> Codebooks:
        cuts = [vectors.shape[1] * p // parts for p in range(parts + 1)]
        spans = zip(cuts, cuts[1:], strict=False)
        return cls([vectors], cuts, [group_entries(vectors[:, a:b], groups) for a, b in spans])

    @property
    def now(self) -> np.ndarray:
        return self.rounds[-1]

    def parts(self) -> list[tuple[int, slice]]:
        return [(p, slice(a, b)) for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))]

    def drift(self, part: int) -> np.ndarray:
        """[round, group]: how far the farthest entry of a group is now from where it was in a round."""
        at = slice(self.cuts[part], self.cuts[part + 1])
        net = np.array([np.sqrt(((self.now - old)[:, at].astype(float) ** 2).sum(axis=1)) for old in self.rounds])
        of = self.groups[part]
        return np.stack([net[:, of == g].max(axis=1, initial=0.0) for g in range(of.max() + 1)], axis=1)

    def sha256(self) -> str:
        numbers = [str(x) for p, at in self.parts() for entry in self.now[:, at].tolist() for x in entry]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def group_entries(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group of near entries for each entry: seeds far from each other, then the nearest seed."""
    x = entries.astype(float)
    nearest, of = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    seed = 0
    for g in range(min(groups, len(x))):
        far = ((x - x[seed]) ** 2).sum(axis=1)
        of[far < nearest] = g
        nearest = np.minimum(nearest, far)
        seed = int(nearest.argmax())
    return of


def exact_kind(*numbers: np.ndarray) -> type:
    """The fastest type in which squared distances between these rows, and the products in them, are exact."""
    most = max((int(abs(n).max()) for n in numbers if n.size), default=0)
    bits = 2 * most.bit_length() + 2 + max(n.shape[1] for n in numbers).bit_length()
    return np.float64 if bits < 53 else np.longdouble if bits < min(63, np.finfo(np.longdouble).nmant) else object


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry; both in the type of `exact_kind`."""
    return (x * x).sum(axis=1)[:, None] + (entries * entries).sum(axis=1)[None] - 2 * (x @ entries.T)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


def _two_least(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of the first least value of each row, that value, and the least of the others. Changes `d`."""
    rows = np.arange(len(d))
    at = d.argmin(axis=1)
    least = d[rows, at].copy()
    d[rows, at] = np.inf
    return at, least, d.min(axis=1)


def assign(x: np.ndarray, part: int, books: Codebooks, code=None, bound=None, stamp=None):
    """Of the parts `x`: code, squared distance, bounds and stamps [row, group], and the rows scanned per group.

    Without a code all entries are compared; else only the groups whose bound does not rule them out.
    """
    at = slice(books.cuts[part], books.cuts[part + 1])
    of, now = books.groups[part], len(books.rounds) - 1
    entries = books.now[:, at]
    kind = exact_kind(x, entries)
    x, entries = x.astype(kind), entries.astype(kind)
    rows, groups = np.arange(len(x)), int(of.max()) + 1
    if code is None:
        d = distances(x, entries)
        new = d.argmin(axis=1)
        best = d[rows, new].copy()
        d[rows, new] = np.inf
        bound = np.stack([_root(d[:, of == g].min(axis=1)) for g in range(groups)], axis=1)
        return new, best, bound, np.full((len(x), groups), now), len(x) * groups
    own = ((x - entries[code]) ** 2).sum(axis=1)
    near = _root(own)
    drift = books.drift(part)
    lowered = drift[stamp, np.arange(groups)]
    left = bound - lowered
    slack = 1e-9 * (np.where(np.isinf(bound), 0, bound) + lowered + near[:, None] + 1)
    scan = left - slack <= near[:, None]
    bound, stamp = bound.copy(), stamp.copy()
    new, best = code.copy(), own.copy()
    second = np.full(len(x), np.inf)
    for g in range(groups):
        some = np.flatnonzero(scan[:, g])
        if not len(some):
            continue
        members = np.flatnonzero(of == g)
        d = distances(x[some], entries[members])
        d[code[some][:, None] == members] = np.inf
        where, least, other = _two_least(d)
        which = members[where]
        bound[some, g], stamp[some, g] = _root(least), now
        better = (least < best[some]) | ((least == best[some]) & (which < new[some]))
        moved = some[better]
        best[moved], new[moved], second[moved] = least[better], which[better], _root(other[better])
    # The new entry leaves its group's bound, and the old one comes under that of its own.
    moved = np.flatnonzero(new != code)
    bound[moved, of[new[moved]]] = second[moved]
    home = of[code[moved]]
    held = np.where(stamp[moved, home] == now, bound[moved, home], left[moved, home])
    bound[moved, home] = np.minimum(held, near[moved])
    stamp[moved, home] = now
    return new, best, bound, stamp, int(scan.sum())


def add_up(sums: np.ndarray, counts: np.ndarray, x: np.ndarray, codes: np.ndarray, books: Codebooks) -> None:
    """Add rows to the sums [entry, component] (unbounded integers) and counts [part, entry]."""
    for p, at in books.parts():
        order = np.argsort(codes[:, p], kind="stable")
        of, first, n = np.unique(codes[order, p], return_index=True, return_counts=True)
        wide = x[order, at] if abs(x).max(initial=0) < 2**40 else x[order, at].astype(object)
        if at.stop > at.start:
            sums[of, at] += np.add.reduceat(wide, first, axis=0).astype(object)
        counts[p, of] += n


def whole(squares: np.ndarray) -> np.ndarray:
    """Squared distances as integers of 64 bits, or unbounded where they came so."""
    return squares.astype(np.int64) if squares.dtype == np.float64 else np.array([int(v) for v in squares], object)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(float) * scale), -LIMIT, LIMIT).astype(np.int64)


def assigned(batches: Iterator[pa.RecordBatch], books: Codebooks, scale: int) -> Iterator[tuple]:
    """For pieces of the rows: vec_id, label, integers, codes, squared errors, bounds and stamps.

    Rows come as vectors, or with the state of the last round.
    """
    ends = np.cumsum([0, *(int(g.max()) + 1 for g in books.groups)]).tolist()
    for batch in slices(batches, ROWS):
        n = batch.num_rows
        if not n:
            continue
        codes = np.zeros((n, len(books.groups)), np.int64)
        if "vector" in batch.schema.names:
            x, old = whole_numbers(_matrix(batch.column("vector"), books.cuts[-1]), scale), None
            bounds, stamps = np.zeros((n, ends[-1])), np.zeros((n, ends[-1]), np.int64)
        else:
            x = _matrix(batch.column("ints"), books.cuts[-1])
            old = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, -1).astype(np.int64)
            bounds = _matrix(batch.column("bounds"), ends[-1]).astype(float)
            stamps = np.frombuffer(b"".join(batch.column("stamps").to_pylist()), np.uint8).reshape(n, -1).astype(np.int64)
        errors = np.zeros(n, np.int64)
        for p, at in books.parts():
            of = slice(ends[p], ends[p + 1])
            held = () if old is None else (old[:, p], bounds[:, of], stamps[:, of])
            codes[:, p], best, bounds[:, of], stamps[:, of], _ = assign(x[:, at], p, books, *held)
            errors = errors + whole(best)
        yield batch.column("vec_id"), batch.column("label"), x, codes, errors, bounds, stamps


def keep_round(rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """Every row with its state after a round, and behind the rows of a task its sums: part, entry, used, sums."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(books.now.shape, object)
        counts = np.zeros((len(books.groups), len(books.now)), np.int64)
        nothing = None
        for vec_id, label, x, codes, _, bounds, stamps in assigned(batches, books, scale):
            add_up(sums, counts, x, codes, books)
            n, nothing = len(vec_id), label.type
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": vec_id,
                    "label": label,
                    "ints": _lists(x, pa.int64()),
                    "codes": pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()),
                    # Rounded down, so that a bound stays one.
                    "bounds": _lists(np.nextafter(bounds.astype(np.float32), np.float32(-np.inf)), pa.float32()),
                    "stamps": pa.array([s.tobytes() for s in stamps.astype(np.uint8)], pa.binary()),
                    "part": pa.nulls(n, pa.int32()),
                    "entry": pa.nulls(n, pa.int32()),
                    "used": pa.nulls(n, pa.int64()),
                    "sums": pa.nulls(n, pa.list_(pa.string())),
                }
            )
        part, entry = np.nonzero(counts)
        spans = [at for _, at in books.parts()]
        n = len(part)
        if n:
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": pa.nulls(n, pa.int64()),
                    "label": pa.nulls(n, nothing),
                    "ints": pa.nulls(n, pa.list_(pa.int64())),
                    "codes": pa.nulls(n, pa.binary()),
                    "bounds": pa.nulls(n, pa.list_(pa.float32())),
                    "stamps": pa.nulls(n, pa.binary()),
                    "part": pa.array(part, pa.int32()),
                    "entry": pa.array(entry, pa.int32()),
                    "used": pa.array(counts[part, entry], pa.int64()),
                    "sums": pa.array([[str(v) for v in sums[e, spans[p]]] for p, e in zip(part, entry, strict=True)], pa.list_(pa.string())),
                }
            )

    return rows.mapInArrow(
        run,
        f"vec_id long, label {label}, ints array<long>, codes binary, bounds array<float>, stamps binary, "
        "part int, entry int, used long, sums array<string>",
    )


def last_round(rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """Every row's code and error under the final entries."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vec_id, label, _, codes, errors, _, _ in assigned(batches, books, scale):
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": vec_id,
                    "label": label,
                    "code": pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)]),
                    "error": pa.array([min(e, LONGEST) for e in errors.tolist()], pa.int64()),
                }
            )

    return rows.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def moved(state: DataFrame, books: Codebooks) -> np.ndarray:
    """The entries after a round: floor(sum / count) of the parts of each. One row per component reaches the driver."""
    each = state.filter("part is not null").select("part", "entry", "used", F.posexplode("sums").alias("at", "value"))
    total = F.sum(F.col("value").cast("decimal(38,0)")).alias("total")
    entries = books.now.copy()
    for r in each.groupBy("part", "entry", "at").agg(total, F.sum("used").alias("n")).collect():
        entries[r["entry"], books.cuts[r["part"]] + r["at"]] = int(r["total"]) // r["n"]
    return entries


def finite(vector: Column) -> Column:
    """Whether a vector holds neither null nor a component that is not finite."""
    v = vector.cast("array<double>")
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def encode(
    vectors: DataFrame,
    entries: int = ENTRIES,
    parts: int = PARTS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    groups: int = GROUPS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, Codebooks | None]:
    """Per kept row: vec_id, label, code, error; and the codebooks of all rounds (None without rows)."""
    if not 1 <= entries <= 256 or not 1 <= rounds < 256:
        raise ValueError("a code has a byte for each part, and a stamp one for the round")
    spark = vectors.sparkSession
    kept = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    ).filter(F.col("vector").isNotNull() & finite(F.col("vector")))
    by = [F.col("vec_id").asc_nulls_last(), "vector"]
    one = kept.orderBy(*by).limit(1).collect()
    if not one:
        return spark.createDataFrame([], f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"), None
    kept = kept.filter(F.size("vector") == len(one[0]["vector"]))
    start = [r["vector"] for r in kept.orderBy(*by).limit(entries).collect()]
    books = Codebooks.start(whole_numbers(np.array(start, float).reshape(len(start), -1), scale), parts, groups)
    rows, path = kept, None
    for _ in range(rounds):
        written = new_path(spark, "vector-codes")
        state = keep_round(rows, books, scale)
        state.write.parquet(written)
        state = spark.read.schema(state.schema).parquet(written)
        books = Codebooks([*books.rounds, moved(state, books)], books.cuts, books.groups)
        rows = state.filter("part is null").drop("part", "entry", "used", "sums")
        if path:
            discard(spark, path)
        path = written
    out = settle(last_round(rows, books, scale), "vector-codes")
    if path:
        discard(spark, path)
    return out, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """`coded` with `label_error`, the errors of all rows of its label. A hot label's sum is broadcast."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = settle(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("_sum"), F.count(F.lit(1)).alias("_n")), "label-errors")
    all_rows = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    is_hot = F.col("_n") * HOT_SHARE > all_rows
    hot = F.broadcast(sums.filter(is_hot).select(F.col("_label").alias("_hot"), F.col("_sum").alias("_hot_sum")))
    cold = sums.filter(~is_hot).drop("_n")
    rows = coded.join(hot, coded["label"].eqNullSafe(F.col("_hot")), "left").drop("_hot")
    found = rows.filter("_hot_sum is not null").withColumnRenamed("_hot_sum", "label_error")
    rest = rows.filter("_hot_sum is null").drop("_hot_sum").join(broadcast_if_small(cold), F.col("label").eqNullSafe(F.col("_label")))
    return found.unionByName(rest.drop("_label").withColumnRenamed("_sum", "label_error"))


def vector_codes(vectors: DataFrame, **how: object) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = encode(vectors, **how)
    return with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256")
    )
