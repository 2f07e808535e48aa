import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import minhash_dedup
from lakeloom.llm.components import components
from lakeloom.llm.minhash_dedup import near_duplicates, remove_near_duplicates

from .helpers import by_id


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    width = min(width, len(words))
    return {(width, *words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(rows, width, percent=80):
    sets = {i: sets_of(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def near(rng, words, vocabulary, share):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    rows, i = [], 0
    for size in (2, 3, 5, 8, 60):
        for _ in range(6 if size < 60 else 1):
            seed_words = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 300))]
            for _ in range(size):
                words = near(rng, seed_words, vocabulary, rng.choice([0, 0.01, 0.03, 0.05, 0.08]))
                rows.append((i := i + 1, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(12):  # each close to the last, far from the first
        rows.append((i := i + 1, "\t".join(chain)))
        at = rng.randrange(180)
        chain = chain[:at] + [rng.choice(vocabulary) for _ in range(8)] + chain[at + 8 :]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "one  two")]
    rows += [(1007, "x " * 60_000), (1008, "x " * 50_000), (0, rows[70][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_like_brute_force(docs, width):
    rows = corpus()
    table = docs(*rows).withColumns({c: F.lit(1) for c in ("id", "n", "sig", "set_hash", "bands", "a", "b")})
    got = by_id(near_duplicates(table, width))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == brute(rows, width)
    left = remove_near_duplicates(table, width)
    assert left.columns == table.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if r["kept"]}


def test_large_buckets_lose_no_link(docs, monkeypatch):
    rows = corpus(1)
    monkeypatch.setattr(minhash_dedup, "SMALL", 2)
    monkeypatch.setattr(minhash_dedup, "CENTRES", 1)
    got = by_id(near_duplicates(docs(*rows), 2))
    assert {i: r["component_id"] for i, r in got.items()} == {i: r[1] for i, r in brute(rows, 2).items()}


def test_dense_groups_around_a_centre(docs):
    """Members near the limit of their centre, far from each other, and a few linked to one member only."""
    rng, rows = random.Random(5), []
    for g in range(3):
        centre = [f"c{g}-{k}" for k in range(120)]
        for i in range(50):
            words = list(centre)
            for at in rng.sample(range(120), rng.randrange(3, 13)):
                words[at] = f"own{g}-{i}-{at}"
            rows.append((g * 1000 + i + 1, " ".join(words)))
            if i % 10 == 0:
                words[5:9] = [f"far{g}-{i}-{k}" for k in range(4)]
                rows.append((g * 1000 + 500 + i, " ".join(words)))
        rows.append((g * 1000 + 900, " ".join(centre)))
    got = by_id(near_duplicates(docs(*rows), 2))
    want = brute(rows, 2)
    assert len({r[1] for r in want.values()}) > 10
    assert {i: r["component_id"] for i, r in got.items()} == {i: r[1] for i, r in want.items()}


@pytest.mark.parametrize("percent", [50, 60, 70])
def test_any_percent_like_brute_force(docs, percent):
    """Pairs just above and just below the asked similarity, besides the corpus."""
    rng, rows = random.Random(percent), corpus(2)
    for g in range(40):
        both = round(percent * 200 / (100 + percent)) + g % 2
        first = [f"p{g}-{k}" for k in range(100)]
        second = first[:both] + [f"q{g}-{k}" for k in range(100 - both)]
        rows += [(2000 + 2 * g, " ".join(first)), (2001 + 2 * g, " ".join(rng.sample(second, 100)))]
    got = by_id(near_duplicates(docs(*rows), 1, percent))
    assert {i: r["component_id"] for i, r in got.items()} == {i: r[1] for i, r in brute(rows, 1, percent).items()}


def test_odd_sketches_refuse_no_linked_sets():
    """Sets that differ in d hashes differ in d bits at most; clearly different small sets in more than is allowed."""
    rng = np.random.default_rng(7)
    for size in (1, 30, 150, 1000, 9000):
        for both in (size, size - size // 9, size - size // 8, size // 2, 0):
            of = rng.integers(0, 2**63, 2 * size - both, dtype=np.uint64) * np.uint64(2)
            one, other = of[:size], of[size - both :]
            a, b = minhash_dedup.odd_sketch(one), minhash_dedup.odd_sketch(other)
            differ = int(np.unpackbits(a ^ b).sum())
            assert differ <= 2 * (size - both)
            sizes = np.array([2 * size])
            kept = bool(minhash_dedup.can_differ(a, b[None, :], sizes, 80)[0])
            if 100 * both >= 80 * (2 * size - both):
                assert kept
            elif both <= size // 2 and 30 <= size <= 1000:
                assert not kept


def test_a_dense_group_is_not_paired_off(docs, monkeypatch):
    """Members a little too far from each other: nearly none of their pairs are proposed for whole sets."""
    proposed = []
    whole = minhash_dedup.by_prefixes

    def count(*args):
        out = whole(*args)
        proposed.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "by_prefixes", count)
    rng, centre, rows = random.Random(11), [f"c{k}" for k in range(150)], []
    for i in range(200):
        words = list(centre)
        for at in rng.sample(range(150), rng.choice([4, 8, 12, 16])):
            words[at] = f"own{i % 40}-{at}"
        rows.append((i + 1, " ".join(words)))
    got = by_id(near_duplicates(docs(*rows), 2))
    assert {i: r["component_id"] for i, r in got.items()} == {i: r[1] for i, r in brute(rows, 2).items()}
    assert proposed and sum(proposed) < 2 * len(rows)


def test_a_member_of_a_dense_group_has_few_links():
    """Whatever the order of rows, the buckets of a group name the same centres: links grow with its members."""
    plan, by = minhash_dedup.scheme(80), minhash_dedup.multipliers(96)
    rng, hashes, of = random.Random(4), minhash_dedup.WordHashes(), []
    for i in range(600):
        words = [f"c{k}" for k in range(150)]
        for at in rng.sample(range(150), 1 + i % 7):
            words[at] = f"own{i}-{at}"
        of.append(minhash_dedup.shingles(" ".join(words), 2, hashes))
    sigs = [minhash_dedup.signature(s, by) for s in of]
    band = np.stack([minhash_dedup.band_keys(m, plan) for m in sigs])
    sig, size, ids = np.stack([m.astype(np.uint8) for m in sigs]), np.array([len(s) for s in of]), np.arange(600)
    links = set()
    for k in range(plan.bands):
        rows = np.array(rng.sample(range(600), 600))
        rows = rows[minhash_dedup.central_first(band[rows, k], sig[rows], ids[rows])]
        pairs, _ = minhash_dedup.pair_up(band[rows, k], size[rows], sig[rows], 80, plan)
        links |= {tuple(sorted(p)) for p in rows[pairs].T.tolist()}
    assert {i for p in links for i in p} == set(range(600))
    assert len(links) < 8 * 600


def test_scheme():
    assert minhash_dedup.scheme(80) == minhash_dedup.scheme(95) == minhash_dedup.Scheme(16, 3, 96, 58)
    for percent in (0, 101):
        with pytest.raises(ValueError):
            minhash_dedup.scheme(percent)


def test_null_ids_repeats_and_nothing(docs):
    text = " ".join(f"t{k}" for k in range(50))
    got = near_duplicates(docs((None, text), (None, text), (3, text), (3, text), (5, text))).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(3, 3, True), (3, 3, True), (5, 3, False)]
    assert [(r["component_id"], r["kept"]) for r in got if not r["doc_id"]] == [(None, True)] * 2
    assert near_duplicates(docs((1, "a")).limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(0)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(400, 480)] + [(rng.randrange(20), rng.randrange(20)) for _ in range(15)]
    rng.shuffle(links)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {i: i for p in links for i in p if p[0] != p[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
