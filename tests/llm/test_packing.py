import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeloom.llm.packing import best_fit, fractional, knapsack, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_knapsack(value, limit):
    best = [0.0] * (limit + 1)
    for c in range(1, limit + 1):
        best[c] = max([best[c - 1], *(value[s] + best[c - s] for s in range(1, c + 1))])
    return best


def test_knapsack():
    value = np.random.default_rng(0).random(41) * np.arange(41)
    assert np.allclose(knapsack(value, 40)[0], brute_knapsack(value, 40))


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_every_piece_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(64, rng.lognormal(2.5, 1, 3000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=65)
    of, held = plan(counts, 64, rounds=40), np.zeros(65, int)
    for pattern, n in of:
        assert n > 0 and sum(length * k for length, k in pattern) <= 64
        for length, k in pattern:
            held[length] += n * k
    assert (held == counts).all()
    least = math.ceil((np.arange(65) * counts).sum() / 64)
    assert sum(n for _, n in of) <= 1.01 * least + 2


def test_fractional_solution_covers_the_lengths():
    counts = np.bincount(np.minimum(64, np.random.default_rng(1).lognormal(2.5, 1, 30_000).astype(int) + 1), minlength=65)
    covered, used = np.zeros(65), fractional(counts, 64, 200)
    for pattern, often in used.items():
        for length, k in pattern:
            covered[length] += k * often
    volume = np.arange(65) * counts
    assert sum(used.values()) == pytest.approx(volume.sum() / 64)
    assert (np.arange(65) * np.minimum(covered, counts)).sum() > 0.8 * volume.sum()


def test_best_fit_of_nothing():
    assert best_fit(np.zeros(9, int), 8) == {} and plan(np.zeros(9, int), 8) == []


def test_pack_rows(docs):
    library = Tokenizer.from_file(PATH)
    rows = [(i, "word and another! " * (i % 37)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "long " * 300), (None, "no id"), (5, "same id"), (7, rows[7][1])]
    table = docs(*rows).withColumns({c: F.lit(1) for c in ("length", "block", "piece", "rank", "ids")})
    got = pack(table, PATH, limit=100, keep_ids=True).collect()
    want = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 100)):
            raw = np.array(ids[at : at + 100], "<u4").tobytes()
            want.append((i, k, at, len(raw) // 4, zlib.crc32(raw), raw))
    keys = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
    assert sorted((tuple(bytes(r[k]) if k == "ids" else r[k] for k in keys) for r in got), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for of in places.values():
        end = 0
        for offset, length in sorted(of):
            assert offset == end
            end += length
        assert end <= 100
    assert len(places) <= 1.05 * math.ceil(sum(r["length"] for r in got) / 100) + 2
    assert pack(table.limit(0), PATH).collect() == []
