import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F, types as T

from lakeloom.llm.manifest import build, fold, manifest, proofs, verified, with_proofs

from .conftest import DOCS

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars):
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def tree(leaves, fan):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[k : k + fan]) for k in range(0, len(below), fan)])
    return levels


def sides(levels, at, fan):
    out = []
    for nodes in levels[:-1]:
        first = at // fan * fan
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fan])))
        at //= fan
    return out


def brute(rows, fan=3):
    sources = {}
    for r in sorted(rows, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf(*r))):
        sources.setdefault(r[3], []).append(r)
    trees = {s: tree([leaf(*r) for r in rs], fan) for s, rs in sources.items()}
    above = tree([trees[s][-1][0] for s in sources], fan)
    out = []
    for k, (s, rs) in enumerate(sources.items()):
        for at, r in enumerate(rs):
            proof = sides(trees[s], at, fan) + sides(above, k, fan)
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r[0], text, *r[2:])
            for left, right in proof:
                node = h(left, node, right)
            out.append((r[0], trees[s][0][at], trees[s][-1][0], above[-1][0], h(*(a + b for a, b in proof)), node, node == above[-1][0]))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def corpus(n, sources, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "é" * 3, "line\nline\n", "a\n" * rng.randrange(9), f"text {i}"])
        source = rng.choice([None, "", "hot", "hot", "hot", *(f"s{k}" for k in range(sources))])
        rows.append((rng.randrange(2 * n), text, rng.choice(["en", None]), source, rng.choice([None, i])))
    return rows


@pytest.mark.parametrize(("n", "sources", "fan", "step"), [(1, 0, 3, 4), (2, 1, 3, 4), (400, 30, 3, 2), (300, 4, 2, 3), (250, 5, 3, 4)])
def test_like_brute_force(spark, n, sources, fan, step):
    rows = corpus(n, sources)
    table = spark.createDataFrame(rows, DOCS).repartition(5)
    table = table.withColumns({c: F.lit(1) for c in ("tree", "idx", "n", "digest", "leaf", "probe", "block", "path", "rows")})
    assert result(verified(table, fan, step)) == brute(rows, fan)


def test_repeats_null_ids_long_texts_and_nothing(spark, docs):
    rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in [(None, "x\n"), (None, None), (1, "a"), (1, "a"), (1, "b"), (2, "\n" * 300_000)]]
    assert result(verified(spark.createDataFrame(rows, DOCS))) == brute(rows)
    assert verified(docs((1, "a")).limit(0)).collect() == []


def test_a_changed_column_breaks_its_own_proof_only(spark):
    rows = corpus(200, 6, 2)
    table = spark.createDataFrame(rows, DOCS)
    kept = proofs(manifest(table)).select("doc_id", "digest", "root", "proof")
    other = F.sha2(F.concat("digest", F.lit("!")), 256)
    checked = kept.select((fold(F.col("digest"), F.col("proof")) == F.col("root")).alias("same"), (fold(other, F.col("proof")) == F.col("root")).alias("changed"))
    assert checked.filter("same").count() == 200 and checked.filter("changed").count() == 0


def test_only_every_few_levels_are_written(spark):
    nodes = spark.range(1000).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("idx"), F.lit(1000).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    made = build(nodes, "test", fan=3, step=4)
    assert [level.count() for level in made.levels] == [13, 1]
    assert made.top.first()["digest"] == tree([h(str(i)) for i in range(1000)], 3)[-1][0]
    assert {len(r["proof"]) for r in with_proofs(made).select("proof").collect()} == {7}


def test_other_columns_as_leaves(spark):
    rows = spark.createDataFrame([(1, "b", None), (2, "a", 1.5)], T.StructType([T.StructField("k", T.LongType()), T.StructField("g", T.StringType()), T.StructField("x", T.DoubleType())]))
    got = proofs(manifest(rows, ("k", "x"), group="g", order="k")).collect()
    assert {r["digest"] for r in got} == {h("1:1", "-"), h("1:2", "3:1.5")}
