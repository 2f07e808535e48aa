import random
import re

import pytest
from pyspark.sql import functions as F

from lakeloom.llm.decontaminate import contamination, remove_documents, remove_spans

from .helpers import by_id

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows, items):
    lists = [(i, WORD.findall(low(t))) for i, t in items]
    out = {}
    for doc_id, text in rows:
        words, hit, found = WORD.findall(low(text)), set(), set()
        for item, of in lists:
            size = min(13, len(of))
            wins = {tuple(of[k : k + size]) for k in range(len(of) - size + 1)} if size else set()
            for k in range(len(words) - size + 1) if size else ():
                if tuple(words[k : k + size]) in wins:
                    hit.update(range(k, k + size))
                    found.add(str(item))
        out[doc_id] = (len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words))
    return out


def tables(spark, docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(9)] + ["É", "ß", "日本"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    lists = [say(n) for n in (40, 13, 14, 25, 7, 3, 20, 13)] + [["rare"], ["rare", "pair"]]
    items = [(i, " ".join(w)) for i, w in enumerate(lists)] + [(90, None), (91, "?!"), (0, " ".join(lists[0]))]
    rows = [(0, None), (1, ""), (2, " ,. "), (3, "One RARE pair."), (None, "rare")]
    for i in range(4, 60):
        words = say(rng.randrange(60))
        if i % 3 == 0:
            part = rng.choice(lists)
            words += part[rng.randrange(3) :][: rng.randrange(8, 30)] + say(rng.randrange(200))
        rows.append((i, "".join(w.upper() * (rng.random() < 0.2) or w + rng.choice([" ", ", ", "\n", "-"]) for w in words)))
    rows.append((70, "x " * 30_000 + ", ".join(lists[1])))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    return rows, items, docs(*rows).withColumns({c: F.lit(1) for c in ("words", "row_key", "at", "size")}), bench


@pytest.mark.parametrize("how", [{}, {"max_bytes": 0}])
def test_like_brute_force(spark, docs, how):
    rows, items, table, bench = tables(spark, docs)
    got = by_id(contamination(table, bench, **how))
    want = expected(rows, items)
    assert {i: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for i, r in got.items()} == want
    assert sum(w[3] for w in want.values()) >= 3


def test_removal(spark, docs):
    rows, items, table, bench = tables(spark, docs)
    want = expected(rows, items)
    left = remove_documents(table, bench)
    assert left.columns == table.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, w in want.items() if not w[3]}
    cut = by_id(remove_spans(table, bench))
    assert len(cut) == len(rows)
    for i, text in rows:
        n_words, n_hit = want[i][:2]
        assert len(WORD.findall(low(cut[i]["text"]))) == n_words - n_hit
        if not n_hit:
            assert cut[i]["text"] == text


def test_nothing(spark, docs):
    _, _, table, bench = tables(spark, docs)
    assert contamination(table.limit(0), bench).collect() == []
    assert {r["n_hit"] for r in contamination(table, bench.limit(0)).collect()} == {0}
