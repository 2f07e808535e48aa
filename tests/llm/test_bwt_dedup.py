import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import bwt_dedup, seeds
from lakeloom.llm.bwt import merge, repeated_starts, transform
from lakeloom.llm.bwt_dedup import repeated_bytes

from .helpers import by_id


def brute(rows, length):
    seen, out = set(), {}
    for i, raw in sorted((i, (t or "").encode()) for i, t in rows):
        cut = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen:
                cut[k : k + length] = True
            seen.add(window)
        kept = bytes(b for b, c in zip(raw, cut.tolist(), strict=True) if not c)
        out[i] = (len(raw), int(cut.sum()), int((np.diff(np.r_[0, cut.astype(int)]) > 0).sum()), hashlib.sha256(kept).hexdigest())
    return out


def corpus(length, seed=0):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdeé ñ日") for _ in range(n))
    passages = [say(n) for n in (length, length + 1, length - 1, 2 * length, 4 * length)]
    rows = []
    for i in range(100):
        text = say(rng.randrange(2 * length))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            at = rng.randrange(len(text) + 1)
            text = text[:at] + (p if rng.random() < 0.6 else p[rng.randrange(len(p)) :]) + text[at:]
        rows.append((i * 7 % 100, text))
    rows += [(500, None), (501, ""), (502, "a" * 5 * length), (503, "ab" * 4 * length), (504, rows[3][1]), (505, rows[3][1])]
    rows += [(506, say(15_000)), (507, "\x00" * 3 * length)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("at_once", [1, 2])
@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merge_like_sorting_all_rotations(shards, at_once):
    rng = random.Random(shards)
    strings = [bytes(rng.choice(b"ab\x00\xfe") for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    strings += strings[:5]
    depth = 12
    parts = [transform(strings[k::shards], depth, at_once) for k in range(shards)]
    rows, common = merge(parts, depth, at_once)
    spelled = []
    for k, part in enumerate(parts):
        own = strings[k::shards]
        for s, o in zip(part.string, part.offset, strict=True):
            symbols = [b + 1 for b in own[s]] + [0]
            spelled.append(tuple((symbols[o:] + symbols * depth)[:depth]))
    ordered = [spelled[r] for r in rows]
    assert ordered == sorted(spelled) and sorted(rows.tolist()) == list(range(len(spelled)))
    for j in range(1, len(ordered)):
        same = next((h for h in range(depth) if ordered[j][h] != ordered[j - 1][h]), depth)
        assert common[j] == same - same % at_once


def test_repeated_starts():
    strings = [b"xxabcdefgh", b"abcdefghyy", b"zabcdefg", b"abc"]
    got = [sorted(zip(s.tolist(), o.tolist(), strict=True)) for s, o in repeated_starts(strings, np.array([0, 1, 0, 1]), 7)]
    assert sorted(got) == [[(0, 2), (1, 0), (2, 1)], [(0, 3), (1, 1)]]


@pytest.mark.parametrize(("length", "seed", "hot"), [(100, 32, 1024), (100, 32, 3), (12, 4, 1024), (12, 4, 2)])
def test_like_brute_force(docs, length, seed, hot):
    rows = corpus(length)
    table = docs(*rows).withColumns({c: F.lit(1) for c in ("data", "part", "answer", "n_bytes", "seeds")})
    got = by_id(repeated_bytes(table, length, seed, hot))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == brute(rows, length)


def test_small_parts_and_kept_bytes(docs, monkeypatch):
    monkeypatch.setattr(seeds, "FLUSH", 20)
    monkeypatch.setattr(seeds, "STRETCH", 64)
    monkeypatch.setattr(bwt_dedup, "FLUSH", 10)
    monkeypatch.setattr(bwt_dedup, "TOGETHER", 500)
    rows = corpus(100, 3)
    got = by_id(repeated_bytes(docs(*rows), keep_text=True))
    want = brute(rows, 100)
    for i, text in rows:
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want[i][1:]
        assert hashlib.sha256(bytes(got[i]["kept"])).hexdigest() == want[i][3]
        assert sum(b - a for a, b in got[i]["spans"]) == want[i][1]


def test_odd_ids_and_nothing(docs):
    text = "".join(chr(97 + k * k % 23) + chr(97 + k % 7) for k in range(120))
    got = sorted((r["doc_id"] is None, r["n_removed"]) for r in repeated_bytes(docs((None, text), (2, text), (2, text), (2, "x " + text))).collect())
    assert got[-1] == (True, len(text)) and [g[1] for g in got[:2]] == [got[0][1]] * 2
    assert repeated_bytes(docs((1, "a")).limit(0)).collect() == []


def test_earlier_steps_leave_no_shuffle_files(docs, spark):
    """The texts' shuffles are gone before the stretches are sent; counts of a few bytes may stay."""

    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {every.apply(k).getName(): every.apply(k).length() for k in range(every.size())}

    rng, before = random.Random(8), files()
    rows = [(i, "".join(rng.choices("abcdefgh ", k=4000))) for i in range(200)]
    repeated_bytes(docs(*rows, *((i + 500, t) for i, t in rows)))  # not run to its end
    left = sum(n for name, n in files().items() if name.startswith("shuffle_") and name not in before)
    assert left < 20_000


def stretches_of(n, seed):
    """Stretches (columns, bytes), two of each anchor, that share 120 of 160 bytes."""
    rng = np.random.default_rng(seed)
    shared, own = rng.integers(97, 123, (n, 120), np.uint8), rng.integers(65, 91, (2 * n, 40), np.uint8)
    own[:, -1] = np.arange(2 * n) % 2
    strings = [own[k].tobytes() + shared[k // 2].tobytes() for k in range(2 * n)]
    anchor = np.repeat(rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64), 2)
    doc = np.arange(2 * n)
    return [(anchor, doc, np.full(2 * n, 7, "<u4"), np.full(2 * n, 1000), np.full(2 * n, 61))], strings


def test_a_reducer_holds_little_of_its_stretches():
    held, strings = stretches_of(25_000, 1)
    sent = list(bwt_dedup.flush_segments(held, strings, 1))
    rows = sorted((x for b in sent for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)), key=lambda x: x[0])
    assert len({part for part, _ in rows}) == bwt_dedup.FINE
    batch = seeds.message([p for p, _ in rows], [None] * len(rows), [d for _, d in rows])
    del held, strings, sent, rows
    tracemalloc.start()
    try:
        doc, mark, start, many = zip(*(a for _, blobs in seeds.by_part([batch]) for a in bwt_dedup.reduce_segments(blobs, 100)), strict=True)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    doc, start, many = (np.concatenate(c) for c in (doc, start, many))
    assert sorted(doc.tolist()) == list(range(1, 50_000, 2)) and set(zip(start.tolist(), many.tolist(), strict=True)) == {(1040, 21)}
    assert most < 100e6  # 8 MB of stretches


def test_one_part_reaches_the_reducer_at_a_time(docs):
    def send(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from seeds.messages((part, seeds.pack(seeds.HOT, np.full(5, part))) for part in range(40))
                yield from seeds.to_docs(seeds.WINDOWS, np.array([k]), [np.ones(1, "<u4"), np.arange(1), np.ones(1, "<u4")], 3)

    def reduce(parts):
        for blobs in parts:
            values = np.concatenate([seeds.unpack(b, ["<i8"])[0][0] for b in blobs])
            yield from seeds.to_docs(seeds.WINDOWS, values[:1] + 1000, [np.full(1, len(set(values.tolist())), "<u4"), np.full(1, len(values)), np.ones(1, "<u4")], 3)

    rows = seeds.exchange(docs(*((i, "") for i in range(6))), send, reduce, 3).collect()
    answers = {r["doc_id"]: [c.tolist() for c in seeds.unpack(bytes(r["data"]), seeds.ANSWERS[seeds.WINDOWS][1:])[0]] for r in rows}
    assert answers == {**{i: [[1], [0], [1]] for i in range(6)}, **{1000 + p: [[1], [30], [1]] for p in range(40)}}


def test_windows_that_follow_on_are_one_answer():
    doc, mark, start = np.array([1, 1, 1, 2, 1, 1]), np.array([5, 5, 5, 5, 6, 5], "<u4"), np.array([4, 3, 9, 5, 5, 4])
    got = list(zip(*(c.tolist() for c in bwt_dedup._in_runs(doc, mark, start)), strict=True))
    assert got == [(1, 5, 3, 2), (1, 5, 9, 1), (1, 6, 5, 1), (2, 5, 5, 1)]


def test_stretches_are_gone_when_the_texts_meet_the_answers(docs, spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("abcdefgh ", k=4000))) for i in range(50)]
    plan = repeated_bytes(docs(*rows, *((i + 500, t) for i, t in rows)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # of the last step; nothing before it is run again
