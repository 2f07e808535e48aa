import hashlib
from collections import Counter

from pyspark.sql import functions as F

from lakeloom.llm.exact_dedup import deduplicate, exact_groups

TEXTS = [
    (5, "a b c"), (3, "ab\tc"), (9, "abc"), (4, "a b c"), (1, "xyz"), (2, None), (7, " \n"), (8, ""),
    (10, "é\u00a0é"), (11, "éé"), (None, "a  b  c "), (12, "q" * 100_000), (13, "q" * 100_000 + " "),
]


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def expected(rows):
    out = []
    for i, t in rows:
        group = [(j, u) for j, u in rows if plain(u) == plain(t)]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out.append((i, keep[0], len(group), (i, t) == keep, hashlib.sha256(plain(t).encode()).hexdigest()))
    return out


def result(df):
    return [tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]


def test_groups_like_brute_force(docs):
    assert Counter(result(exact_groups(docs(*TEXTS)))) == Counter(expected(TEXTS))


def test_texts_of_one_digest_are_told_apart(docs):
    short = exact_groups(docs(*TEXTS), digest=lambda sha: F.substring(sha, 1, 0))
    assert Counter(result(short)) == Counter(expected(TEXTS))


def test_clashing_columns_and_empty_table(docs):
    named = docs(*TEXTS).withColumns({c: F.lit(1) for c in ("plain", "digest", "size", "salt", "n", "key")})
    assert Counter(result(exact_groups(named))) == Counter(expected(TEXTS))
    assert exact_groups(docs(*TEXTS).limit(0)).collect() == []
    assert deduplicate(docs(*TEXTS).limit(0)).collect() == []


def test_hot_group(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.col("id").cast("string")).alias("text")
    )
    got = exact_groups(rows)
    assert got.filter("group_size = 2000").agg(F.min("keep_id"), F.max("keep_id"), F.count("*")).first() == (0, 0, 2000)
    assert got.filter("kept").count() == 4001


def test_deduplicate_keeps_one_row(docs):
    rows = docs(*TEXTS, (1, "xyz"), (1, "other"), (1, "xyz "))
    left = deduplicate(rows)
    assert left.columns == rows.columns
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    longest = [(7, " \n"), (1, "xyz "), (1, "other"), (10, "é\u00a0é"), (11, "éé"), (13, "q" * 100_000 + " ")]
    assert got == Counter([*longest, (None, "a  b  c ")])
