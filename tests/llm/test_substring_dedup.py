import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import seeds, substring_dedup
from lakeloom.llm.substring_dedup import repeated_passages

from .helpers import by_id


def brute(rows, length):
    lists = sorted((i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows)
    seen, out = set(), {}
    for i, words in lists:
        cut = [False] * len(words)
        for k in range(len(words) - length + 1):
            window = tuple(words[k : k + length])
            if window in seen:
                cut[k : k + length] = [True] * length
            seen.add(window)
        kept = [w for w, c in zip(words, cut, strict=True) if not c]
        out[i] = (len(words), sum(cut), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed=0, length=20):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [say(n) for n in (length, length + 1, length - 1, 2 * length, 5 * length, 3)]
    rows = []
    for i in range(120):
        words = say(rng.randrange(3 * length))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            at, cut = rng.randrange(len(words) + 1), rng.randrange(len(p))
            words[at:at] = p if rng.random() < 0.6 else p[cut:]
        rows.append((i * 7 % 120, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(500, None), (501, ""), (502, " "), (503, "a " * 200), (504, "a b " * 300), (505, rows[3][1]), (506, rows[3][1])]
    rows += [(507, " ".join(say(20_000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("length", "seed"), [(20, 8), (5, 2), (20, 20)])
def test_like_brute_force(docs, length, seed):
    rows = corpus(length=length)
    table = docs(*rows).withColumns({c: F.lit(1) for c in ("data", "part", "answer", "n_words", "_id")})
    got = by_id(repeated_passages(table, length, seed))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == brute(rows, length)


def test_small_flushes_and_text(docs, monkeypatch):
    monkeypatch.setattr(seeds, "FLUSH", 50)
    rows = corpus(2)
    got = by_id(repeated_passages(docs(*rows), keep_text=True))
    want = brute(rows, 20)
    for i, text in rows:
        words = (text or "").split()
        spans = got[i]["spans"]
        assert sum(b - a for a, b in spans) == want[i][1]
        assert got[i]["kept"] == " ".join(w for k, w in enumerate(words) if not any(a <= k < b for a, b in spans))


def test_odd_ids_and_nothing(docs):
    text = " ".join(f"t{k}" for k in range(30))
    got = sorted((r["doc_id"] is None, r["n_removed"]) for r in repeated_passages(docs((None, text), (2, text), (2, text), (2, "x " + text))).collect())
    assert got == [(False, 0), (False, 0), (False, 30), (True, 30)]
    assert repeated_passages(docs((1, "a")).limit(0)).collect() == []


def test_least_of_is_leftmost():
    x = np.random.default_rng(0).integers(0, 6, 300).astype(np.uint64)
    for w in (1, 2, 3, 7, 13, 64, 300):
        assert seeds.least_of(x, w).tolist() == [s + int(np.argmin(x[s : s + w])) for s in range(len(x) - w + 1)]


def test_rolling_is_a_function_of_the_window():
    v = np.tile(np.random.default_rng(0).integers(0, 2**64, 50, dtype=np.uint64), 4)
    h = seeds.rolling(v, 20)
    assert (h[:50] == h[50:100]).all() and len(np.unique(h)) == 50


def most_memory(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def in_one_batch(sent):
    """The messages of a task as one reducer gets them, by part."""
    rows = sorted((x for b in sent for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True) if x[0] >= 0), key=lambda x: x[0])
    return seeds.message([p for p, _ in rows], [None] * len(rows), [d for _, d in rows])


def test_a_worker_remembers_few_words():
    words = [b"%d" % k for k in range(600_000)]

    def run():
        memory = substring_dedup.WordValues()
        return [memory[w] for w in words[:10]], sum(memory[w] >> 60 for w in words), [memory[w] for w in words[:10]]

    (before, _, after), most = most_memory(run)
    assert before == after
    assert most < 30e6


def test_a_reducer_holds_little_of_its_windows():
    n = 300_000
    key = np.random.default_rng(0).integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
    sent = []
    for doc in (1, 2):
        sent += seeds.flush_windows(key, key.astype("<u4"), np.full(n, doc), np.full(n, doc, "<u4"), np.arange(n), 1)
    batch = in_one_batch(sent)
    del sent

    def run():
        return sum(len(a[0]) for _, blobs in seeds.by_part([batch]) for a in seeds.reduce_windows(blobs) if set(a[0].tolist()) == {2})

    found, most = most_memory(run)
    assert found == n
    assert most < 20e6  # 19 MB of windows


def test_a_task_sends_windows_of_a_batch_bit_by_bit(monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH", 500)
    texts = [" ".join(f"w{i}x{k}" for k in range(419)) for i in range(30)]
    values, columns = substring_dedup._values(), ([], [], [])
    for i, text in enumerate(texts):
        grams, _ = seeds.anchors(values(text), 20, 8)
        for c, x in zip(columns, (i, text, grams.tobytes()), strict=True):
            c.append(x)
    batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2], pa.binary())], ["doc_id", "text", "seeds"])
    flushes, whole = [], seeds.flush_windows
    monkeypatch.setattr(substring_dedup, "flush_windows", lambda *c: flushes.append(len(c[0])) or whole(*c))
    sent = list(substring_dedup.send_windows(iter([batch]), values, 20, 8, 3))
    assert flushes == [800] * 15
    assert sum(len(seeds.unpack(d, seeds.WINDOW_COLUMNS)[0][0]) for b in sent for d in b.column(2).to_pylist()) == 12_000


def test_anchors_of_a_task_come_in_parts(monkeypatch):
    monkeypatch.setattr(seeds, "FLUSH", 2_000)
    rng = random.Random(4)
    rows = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(2_000)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(rows * 2)], ["doc_id", "text"])
    sent = list(seeds.send_anchors(iter([batch]), substring_dedup._values(), 20, 8, 1))
    of_parts = list(seeds.by_part([in_one_batch(sent)]))
    assert len(of_parts) == seeds.FINE
    found = [seeds.reduce_anchors(blobs, 1 << 62)[0] for _, blobs in of_parts]
    assert sorted({d for answers in found for docs_, _ in answers for d in docs_.tolist()}) == list(range(40))


def test_small_flushes_of_windows(docs, monkeypatch):
    for module in (seeds, substring_dedup):
        monkeypatch.setattr(module, "FLUSH", 50)
    monkeypatch.setattr(seeds, "ANSWERED", 20)
    rows = corpus(3)
    got = by_id(repeated_passages(docs(*rows)))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == brute(rows, 20)


def test_answers_of_a_bucket_are_sorted_share_by_share(monkeypatch):
    n = 400_000
    docs_ = np.arange(n) % 5_000
    sent = list(seeds.to_docs(seeds.ANCHORS, docs_, [np.arange(n).astype("<u8")], 1))
    rows = [x for b in sent for x in b.column(2).to_pylist()]
    batch = seeds.message([-1] * len(rows), [None] * len(rows), rows)
    del sent, rows
    monkeypatch.setattr(seeds, "SORTED", 1 << 20, raising=False)

    def run():
        got = {}
        for b in seeds.by_document(iter([batch])):
            for doc, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                (found,), _ = seeds.unpack(data, ["<u8"])
                assert doc not in got and (found % 5_000 == doc).all()
                got[doc] = len(found)
        return got

    got, most = most_memory(run)
    assert got == dict.fromkeys(range(5_000), 80)
    assert most < 18e6  # 6 MB of answers, all at once 22e6
