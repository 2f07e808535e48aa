import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm.vector_codes import Codebooks, add_up, assign, encode, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, parts=4, rounds=4, scale=1024):
    rows = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(scale * v) for v in r[1]] for r in rows]
    size = len(x[0]) // parts
    spans = [range(p * size, (p + 1) * size) for p in range(parts)]
    books = [list(v) for v in x[:entries]]

    def nearest(v, span):
        return min((sum((v[k] - b[k]) ** 2 for k in span), j) for j, b in enumerate(books))

    for _ in range(rounds):
        found = [[nearest(v, s)[1] for s in spans] for v in x]
        moved = [list(b) for b in books]
        for p, span in enumerate(spans):
            for j in range(len(books)):
                mine = [v for v, f in zip(x, found, strict=True) if f[p] == j]
                for k in span if mine else ():
                    moved[j][k] = sum(v[k] for v in mine) // len(mine)
        books = moved
    last = [[nearest(v, s) for s in spans] for v in x]
    errors = [min(sum(d for d, _ in f), 2**63 - 1) for f in last]
    sha = hashlib.sha256(",".join(str(b[k]) for s in spans for b in books for k in s).encode()).hexdigest()
    of = {}
    for r, e in zip(rows, errors, strict=True):
        of[r[2]] = min(of.get(r[2], 0) + e, 2**63 - 1)
    return sorted(
        (repr(r[0]), "".join(f"{j:02x}" for _, j in f), e, of[r[2]], sha)
        for r, f, e in zip(rows, last, errors, strict=True)
    )


def result(df):
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def vectors(n, seed=0, dimension=8, scale=1.0):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(i % 5, 0.7) * scale)) for _ in range(dimension)], i % 3 or None) for i in range(n)]


@pytest.mark.parametrize("n", [5, 40, 300])
def test_like_brute_force(spark, n):
    rows = vectors(n)
    odd = [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] + [0.0] * 7, 2), (904, [-float("inf")] * 8, 0)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    assert result(vector_codes(table, entries=16)) == brute(rows, 16)


def test_ties_repeats_null_ids_and_clashing_columns(spark):
    rows = [(i % 20, [float(i % 3), 0.0, 1.0, float(i % 2)] * 2, None) for i in range(60)] + [(None, [0.5] * 8, 7), (None, [0.25] * 8, 7)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    table = table.withColumns({c: F.lit(1) for c in ("ints", "codes", "bounds", "stamps", "vector", "_label", "_sum", "part", "used")})
    assert result(vector_codes(table, entries=12)) == brute(rows, 12)


@pytest.mark.parametrize("scale", [1e4, 3e6, 1e12, 1e30])
def test_large_components_stay_exact(spark, scale):
    rows = vectors(40, 3, 4, scale)
    got = vector_codes(spark.createDataFrame(rows, SCHEMA), entries=6, parts=2)
    want = brute([(i, [max(-(2.0**50), min(2.0**50, v)) for v in x], y) for i, x, y in rows], 6, 2)
    assert result(got) == want


def test_a_dimension_that_parts_do_not_divide_other_lengths_and_nothing(spark):
    rows = [(i, [float(i * k % 7) for k in range(5)], 0) for i in range(30)]
    coded, books = encode(spark.createDataFrame([*rows, (50, [1.0], 0), (51, [], 0)], SCHEMA), entries=4, parts=4)
    assert coded.count() == 30 and books.cuts == [0, 1, 2, 3, 5]
    assert vector_codes(spark.createDataFrame([(1, None, 2)], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        encode(spark.createDataFrame(rows, SCHEMA), entries=257)


def test_hot_label_and_many_labels(spark):
    rows = [(i, [float(i % 11), float(i % 7)] * 2, 1 if i % 3 == 0 else i) for i in range(900)]
    assert result(vector_codes(spark.createDataFrame(rows, SCHEMA), entries=8, rounds=1)) == brute(rows, 8, rounds=1)


def test_bounds_rule_out_scans_and_change_nothing():
    """Every round's codes equal those of a full scan, and ever fewer groups are scanned."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(3000, 16)) * 200 + rng.integers(0, 9, (3000, 1)) * 500).astype(np.int64)
    books, state, shares = Codebooks.start(x[:64], 4, 8), [None] * 4, []
    for _ in range(6):
        codes, scanned = np.zeros((len(x), 4), np.int64), 0
        for p, at in books.parts():
            full = assign(x[:, at], p, books)
            code, best, bound, stamp, n = assign(x[:, at], p, books, *(state[p] or ()))
            assert (code == full[0]).all() and (best == full[1]).all()
            of = books.groups[p]
            d = np.sqrt(((x[:, None, at] - books.now[None, :, at]) ** 2).sum(axis=2).astype(float))
            d[np.arange(len(x)), code] = np.inf
            net = books.drift(p)[stamp, np.arange(of.max() + 1)]
            for g in range(of.max() + 1):
                assert (bound[:, g] - net[:, g] <= d[:, of == g].min(axis=1) + 1e-6).all()
            state[p], codes[:, p], scanned = (code, bound, stamp), code, scanned + n
        shares.append(scanned)
        sums, counts = np.zeros(books.now.shape, object), np.zeros((4, 64), np.int64)
        add_up(sums, counts, x, codes, books)
        moved = books.now.copy()
        for p, at in books.parts():
            for j in np.flatnonzero(counts[p]):
                moved[j, at] = [int(v) // int(counts[p, j]) for v in sums[j, at]]
        books = Codebooks([*books.rounds, moved], books.cuts, books.groups)
    assert shares[-1] < shares[0] / 2
