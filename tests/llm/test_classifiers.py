import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import quality as Q
from lakeloom.llm import toxicity as T
from lakeloom.llm.labels import examples

from .helpers import by_id

SF = "/root/testdata/sf0.01"


def corpus(n, seed=0):
    """Texts of invented words; toxic ones hold two words of a list in one sentence, poor ones have bars between words."""
    rng, rows = random.Random(seed), []
    letters = "abcdefgh"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    for i in range(n):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.4
        sentences = [[rng.choice(words) for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 12))]
        if toxic:
            rng.choice(sentences).extend(rng.choice(["zorgid", "zorgly", "quax"]) for _ in range(2))
        gap = " | " if poor else " "
        rows.append((i, ". ".join(gap.join(s) for s in sentences) + ".", int(toxic), int(not poor)))
    return rows


def test_toxicity_from_document_labels(spark, docs):
    rows = corpus(600)
    table = docs(*[(i, t) for i, t, _, _ in rows], (1000, None), (1001, ""), (None, "quax zorgid"), (1002, "fine. " * 20_000))
    labels = spark.createDataFrame([(i, x) for i, _, x, _ in rows] + [(1001, None), (None, 1)], "doc_id long, toxic int")
    table = table.withColumns({c: F.lit(1) for c in ("score", "toxic", "label")})
    got = by_id(T.toxicity(table, labels))
    assert len(got) == len(rows) + 4
    for i, r in got.items():
        assert r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(got[i], x, t) for i, t, x, _ in rows if got[i]["held_out"]]
    assert np.mean([r["predicted"] == x for r, x, _ in held]) > 0.95
    for r, x, text in held:  # the located sentences are the ones with the words
        for s in r["sentences"] if x else ():
            assert any(w in text[s["first"] : s["behind"]] for w in ("zorg", "quax"))
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and got[1002]["predicted"] == 0 and got[None]["predicted"] == 1
    model = T.learn(table, labels)
    left = T.remove_toxic(table, model)
    assert left.columns == table.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_held_out_labels_are_never_read(spark, docs):
    rows = corpus(100)
    labels = spark.createDataFrame([(i, x) for i, _, x, _ in rows], "doc_id long, toxic int")
    taken = examples(docs(*[(i, t) for i, t, _, _ in rows]), labels, "toxic", 5, 0)
    assert sorted(taken) == sorted((t, x) for i, t, x, _ in rows if zlib.crc32(str(i).encode()) % 5)


def test_noisy_or():
    z = [-1.0, 0.5, 2.0]
    assert T.noisy_or(z) == pytest.approx(1 - np.prod([1 - 1 / (1 + np.exp(-x)) for x in z]))


def test_without_labels(spark, docs):
    table = docs((1, "a"), (2, None))
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r["score"] for r in T.toxicity(table, none).collect()} == {0.5}
    assert {round(r["score"], 6) for r in Q.quality(table, none).collect()} == {0.5}
    assert T.toxicity(table.limit(0), none).collect() == [] and Q.quality(table.limit(0), none).collect() == []


def test_chunks_cover_every_byte():
    for n in (0, 1, Q.CHUNK - 1, Q.CHUNK, Q.CHUNK + 1, Q.CHUNK + Q.STEP, 1000, 5000):
        text = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        out, firsts = Q.chunked([text, b"x"])
        assert firsts[0] == 0 and len(out) == firsts[1] + 1
        back = bytearray(n)
        for k in range(firsts[1]):
            part = bytes(out[k])[: max(0, n - k * Q.STEP)]
            back[k * Q.STEP : k * Q.STEP + len(part)] = part
        assert bytes(back) == text


def test_responses_like_plain_convolution():
    rng = np.random.default_rng(0)
    net = Q.Network(rng.normal(size=(Q.WIDTH, 256, Q.FILTERS)).astype(np.float32), rng.normal(size=Q.FILTERS), np.zeros((3, Q.FILTERS)), 0.0)
    bytes_ = rng.integers(0, 256, (3, Q.CHUNK), dtype=np.uint8)
    want = np.empty((3, Q.FILTERS))
    for c in range(3):
        every = [sum(net.filters[j, bytes_[c, t + j]] for j in range(Q.WIDTH)) for t in range(Q.CHUNK - Q.WIDTH + 1)]
        want[c] = np.maximum(np.max(every, axis=0) + net.offset, 0)
    assert np.allclose(Q.responses(bytes_, net.pairs(), net.offset), want, atol=1e-4)


def test_quality_of_held_out_rows(spark, docs):
    rows = corpus(500, seed=1)
    table = docs(*[(i, t) for i, t, _, _ in rows], (1000, None), (1001, ""), (1002, "ab | " * 50_000), (None, "x"))
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows], "doc_id long, quality int")
    got = by_id(Q.quality(table.withColumns({"score": F.lit(1), "quality": F.lit(2)}), labels))
    assert len(got) == 504
    for i, r in got.items():
        assert r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(got[i]["predicted"], x) for i, _, _, x in rows if got[i]["held_out"]]
    assert np.mean([p == x for p, x in held]) > 0.9
    assert got[1002]["predicted"] == 0 and got[1000]["score"] == got[1001]["score"]


@pytest.mark.parametrize(("module", "run", "label"), [(T, "toxicity", "toxic"), (Q, "quality", "quality")])
def test_accuracy_on_the_tables(spark, module, run, label):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    scored = getattr(module, run)(docs, labels).join(labels, "doc_id").filter("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] > 0.9


def test_the_sample_is_bounded_by_rows_and_characters(spark, docs):
    table = docs(*[(i, "word " * 20) for i in range(50)], (60, "x" * 300_000), (61, "y" * 3000), (1, "again"), (1, "again"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)], "doc_id long, toxic int")
    taken = lambda **how: examples(table, labels, "toxic", 5, 0, **how)
    every = taken()
    assert len(every) > 30 and max(len(t) for t, _ in every) <= 200_000
    few = taken(most=1500)
    assert sum(len(t) for t, _ in few) <= 1500 and few == every[: len(few)] and taken(most=50) == []
    assert taken(limit=7) == every[:7]


def test_packed_sample_holds_every_word(spark, docs):
    texts = [(1, "Abc abc! x.\ny z"), (2, None), (3, "..."), (4, "abc " * 1000)]
    sampled = docs(*texts).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 2).cast("int").alias("label"))
    got = T.bags(sampled)
    assert len(got.label) == 4 and got.sentences.sum() == len(got.words) and got.words.sum() == len(got.token)
    assert sorted(got.words.tolist()) == [0, 0, 1, 2, 2, 1000]
    of = {tuple(x for x in s if x >= 0) for s in got.slots.tolist()}
    assert of == {tuple(T.features(w)) for w in ("Abc", "abc!", "x.", "y", "z", "abc")}
    assert len(T.bags(sampled.limit(0)).token) == 0
