"""Rules, messages, maintenance, statistics, vector and text search."""

import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions.vectors import METRICS, distances
from lakeloom.operators.bounded import TooLarge, broadcast_if_small, collect_bounded
from lakeloom.operators.events import NotificationRule, Trigger, fan_out, match_notifications, route
from lakeloom.operators.maintenance import (
    apply_deletes, build_rollup, compact, compaction_plan, orphan_files, refresh_rollup, snapshots_to_expire,
    tier_by_age, upsert,
)
from lakeloom.operators.ranges import band_join, interval_join
from lakeloom.operators import nearest
from lakeloom.operators.search import build_cells, dimension_ranges, knn, sq8_decode, sq8_encode
from lakeloom.operators.stats import changelog_table, latest_by_key, mark_late, null_profile, percentiles
from lakeloom.operators.text import bm25_topk, embed, terms
from lakeloom.plans import QUERIES
from lakeloom.sources.messages import explode_notifications, parse_json, parse_requests
from lakeloom.sources.tables import Tables

T0 = dt.datetime(2024, 1, 1)


def objects(spark):
    rows = [
        ("ObjectCreated:Put", "in/a.csv", {"m": "1"}, {"t": "x"}),
        ("ObjectCreated:Copy", "in/b.parquet", {"m": "2"}, {}),
        ("ObjectRemoved:Delete", "in/c.csv", None, None),
        (None, None, None, None),
    ]
    return spark.createDataFrame(rows, "event_name string, key string, metadata map<string,string>, tags map<string,string>")


def test_rules(spark):
    rules = [
        NotificationRule("all"),
        NotificationRule("created", events=("ObjectCreated:*",)),
        NotificationRule("exact", events=("ObjectCreated:Put", "ObjectRemoved:Delete"), suffix=".csv"),
        NotificationRule("every", events=("ObjectCreated:*",), prefix="in/", suffix=".csv", regex="^in/[a-z]\\.", metadata={"m": "1"}, tags={"t": "x"}),
        NotificationRule("nothing", prefix="out/"),
    ]
    got = {}
    for r in match_notifications(objects(spark), rules).collect():
        got.setdefault(r["key"], set()).add(r["rule"])
    assert got == {"in/a.csv": {"all", "created", "exact", "every"}, "in/b.parquet": {"all", "created"},
                   "in/c.csv": {"all", "exact"}, None: {"all"}}


def test_triggers(spark):
    events = spark.createDataFrame(
        [("order", "/shop", {"p": "1"}), ("order", "/web", {}), (None, None, None)],
        "type string, source string, extensions map<string,string>")
    triggers = [Trigger("any"), Trigger("orders", type="order"), Trigger("shop", "order", "/shop", {"p": "1"})]
    got = sorted((r["source"] or "", r["subscriber"]) for r in fan_out(events, triggers).collect())
    assert got == [("", "any"), ("/shop", "any"), ("/shop", "orders"), ("/shop", "shop"), ("/web", "any"), ("/web", "orders")]


def test_route_limits(spark):
    df = spark.createDataFrame([(499_999_999, 200), (500_000_000, 1), (1, 201)], "total_bytes bigint, file_count int")
    assert [r["route"] for r in route(df).collect()] == ["light", "heavy", "heavy"]


def test_messages(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{"), (3, None), (4, '{"b": 2}'), (5, '{"a": "x"}')], "id int, value string")
    good, dead = parse_json(df, "a int")
    assert sorted((r["id"], r["a"]) for r in good.collect()) == [(1, 1), (4, None)]
    assert sorted(r["id"] for r in dead.collect()) == [2, 3, 5]


def test_notifications_and_requests(spark):
    text = '{"Records":[{"eventName":"E","s3":{"bucket":{"name":"b"},"object":{"key":"k","size":5}}},{"eventName":"F"}]}'
    rows, dead = explode_notifications(spark.createDataFrame([(text,), ("x",)], "value string"))
    assert [(r["event_name"], r["key"], r["size"]) for r in rows.collect()] == [("E", "k", 5), ("F", None, None)]
    assert dead.count() == 1
    asks = spark.createDataFrame([('{"files":["a","b"]}',), ('{"files":["c"],"table":"t"}',), ('{"files":[]}',), ('{"table":"t"}',), ("-",)], "value string")
    files, dead, incomplete = parse_requests(asks)
    assert sorted(map(tuple, files.collect())) == [("db.my_table", "a"), ("db.my_table", "b"), ("t", "c")]
    assert (dead.count(), incomplete.count()) == (1, 2)


def test_latest_with_counters_is_one_pass(spark, capsys):
    rows = [(1, 1, "a", 2.0), (1, 3, None, 1.0), (1, 2, "c", None), (2, None, "x", None), (None, 5, "y", 4.0)]
    df = spark.createDataFrame(rows, "k int, at int, what string, value double")
    more = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    got = latest_by_key(df, ["k"], ["at"], *more)
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert got.columns == ["k", "at", "what", "value", "n", "total"]
    assert sorted(map(tuple, got.collect()), key=str) == [
        (1, 3, None, 1.0, 3, 3.0), (2, None, "x", None, 1, None), (None, 5, "y", 4.0, 1, 4.0)
    ]
    assert latest_by_key(df, ["k"], ["at"]).columns == df.columns


# ---- maintenance

@pytest.mark.parametrize("retain,expired", [(1, [1, 2, 3]), (3, [1]), (9, [])])
def test_retention(spark, retain, expired):
    rows = [("t", i, T0 + dt.timedelta(days=i)) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "table_name string, snapshot_id bigint, committed_at timestamp")
    assert sorted(r["snapshot_id"] for r in snapshots_to_expire(df, retain).collect()) == expired
    assert snapshots_to_expire(df, retain, F.lit(T0)).count() == 0


def test_orphans(spark):
    listing = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file_path string, size int")
    used = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "file_path string, snapshot_id int")
    assert [r["file_path"] for r in orphan_files(listing, used).collect()] == ["c"]
    assert orphan_files(listing.limit(0), used).count() == 0
    assert orphan_files(listing, used.limit(0)).count() == 3


def test_upsert_and_deletes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    assert sorted(map(tuple, upsert(base, changes, ["k"], ["n"]).collect())) == [(1, "a"), (2, "y"), (3, "z")]
    rows = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k int, at int")
    gone = spark.createDataFrame([(1, 3), (1, 6)], "k int, gone int")
    assert sorted(map(tuple, apply_deletes(rows, gone, ["k"], "at", "gone").collect())) == [(1, 7), (2, 1)]


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_compaction_plan(spark, limit):
    rnd = random.Random(3)
    files = [("t", i, f"f{i}", rnd.randint(1, 150)) for i in range(200)]
    df = spark.createDataFrame(files, "table_name string, at bigint, path string, size bigint")
    plan = compaction_plan(df, "table_name", "at", "path", "size", 100, limit).collect()
    assert len(plan) == 200 and all((r["bin"] is None) == (r["size"] >= 100) for r in plan)
    upto = 0
    for r in sorted((r for r in plan if r["bin"] is not None), key=lambda r: r["at"]):
        assert r["bin"] == upto // 100
        upto += r["size"]


def test_compact(spark, tmp_path):
    spark.range(1000).repartition(10).write.parquet(str(tmp_path / "many"))
    count = compact(spark, str(tmp_path / "many"), str(tmp_path / "few"), 10_000_000)
    assert count == 1 and spark.read.parquet(str(tmp_path / "few")).count() == 1000


def test_tiers(spark):
    df = spark.createDataFrame([(T0 - dt.timedelta(days=d),) for d in (0, 7, 8, 90, 91)], "at timestamp_ntz")
    tiers = tier_by_age(df, "at", F.lit(T0).cast("timestamp_ntz"), "7 DAYS", "90 DAYS")
    assert [r["tier"] for r in tiers.collect()] == ["hot", "hot", "cold", "cold", "gone"]


def test_rollup_refresh_equals_rebuild(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    a, b = df.filter("v < 40 or v is null"), df.filter("v >= 40")
    merged = refresh_rollup(build_rollup(a, ["k"], "v"), b, ["k"], "v")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, build_rollup(df, ["k"], "v").collect()))


# ---- joins and statistics

def test_band_join(spark):
    rnd = random.Random(5)
    values = [rnd.uniform(-50, 150) for _ in range(200)] + [0.0, 10.0, 20.0]
    bands = [("a", 0.0, 10.0), ("b", 5.0, 95.0), ("empty", 7.0, 7.0), ("c", -20.0, -0.5), ("d", 10.0, 20.0)]
    got = band_join(spark.createDataFrame([(v,) for v in values], "v double"),
                    spark.createDataFrame(bands, "name string, low double, high double"), "v", "low", "high", 10.0)
    want = sorted((v, n) for v in values for n, lo, hi in bands if lo <= v < hi)
    assert sorted((r["v"], r["name"]) for r in got.collect()) == want


def test_interval_join(spark):
    rnd = random.Random(6)
    orders = [(i, rnd.randint(1, 3), T0 + dt.timedelta(seconds=rnd.randint(0, 20000))) for i in range(80)] + [(99, None, T0)]
    pays = [(i, rnd.randint(1, 4), T0 + dt.timedelta(seconds=rnd.randint(-3000, 24000))) for i in range(80)]
    pays.append((100, orders[0][1], orders[0][2] + dt.timedelta(hours=1)))
    pays.append((101, orders[0][1], orders[0][2] + dt.timedelta(hours=1, microseconds=1)))
    got = interval_join(spark.createDataFrame(orders, "o int, k int, ot timestamp"),
                        spark.createDataFrame(pays, "p int, pk int, pt timestamp"), "k", "pk", "ot", "pt", 3600)
    want = []
    for o, k, ot in orders:
        hits = [p for p, pk, pt in pays if pk == k and dt.timedelta(0) <= pt - ot <= dt.timedelta(hours=1)]
        want += [(o, p) for p in hits] or [(o, None)]
    assert sorted(((r["o"], r["p"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 101)] + [("b", 5.0), ("b", None), ("c", None)], "k string, v double")
    got = {r["k"]: (r["n"], r["p50"], r["p99"]) for r in percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (100, 50.0, 99.0), "b": (1, 5.0, 5.0)}


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, `b.c` string")
    assert sorted(map(tuple, null_profile(df).collect())) == [("a", 1, 2), ("b.c", 2, 2)]
    assert sorted(map(tuple, null_profile(df.limit(0)).collect())) == [("a", 0, 0), ("b.c", 0, 0)]


def test_changelog_with_tombstone(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 1, None), (2, 2, 7.0)], "k int, n int, v double")
    assert [tuple(r) for r in changelog_table(df, ["k"], "v", ["n"]).select("k", "v").collect()] == [(2, 7.0)]


def test_late_rows(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    df = spark.createDataFrame([(1, at(0)), (1, at(60)), (2, at(49)), (2, at(50)), (3, at(49)), (3, None)], "b int, ts timestamp")
    late = [r["ts"] for r in mark_late(df, "b", "ts", "10 MINUTES").filter("late").collect()]
    assert late == [at(49), at(49)]


# ---- bounds

def test_bounds(spark):
    assert "broadcast" in broadcast_if_small(spark.range(5))._jdf.queryExecution().toString().lower()
    assert "broadcast" not in broadcast_if_small(spark.range(5), 4)._jdf.queryExecution().toString().lower()
    with pytest.raises(TooLarge):
        collect_bounded(spark.range(5), 4)


# ---- search

def vectors(spark, n=300, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dims)).astype(np.float32)
    data[3 % n] = 0
    data[10 % n] = data[11 % n]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return data.astype(np.float64), spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("block", [1024, 4])
def test_knn_equals_brute_force(spark, metric, block):
    data, base = vectors(spark)
    queries = base.filter("vec_id < 12").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in knn(queries, base, 5, metric, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["base_id"]))
    d = np.round(distances(metric, data, data[:12]), 6) * (-1 if metric == "ip" else 1)
    for q in range(12):
        order = sorted(range(len(data)), key=lambda i: (d[q][i], i))[:5]
        assert [b for _, b in sorted(got[q])] == order


def test_knn_edges(spark):
    _, base = vectors(spark, 3)
    queries = base.limit(1).withColumnRenamed("vec_id", "query_id")
    assert knn(queries, base, 10).count() == 3
    assert knn(queries, base.limit(0), 10).count() == 0
    assert knn(queries.limit(0), base, 10).count() == 0


@pytest.mark.parametrize("tile_bytes", [8 << 20, 8 * 8 * 40])
@pytest.mark.parametrize("metric", METRICS)
def test_knn_in_tiles_equals_the_search_with_a_list(spark, metric, tile_bytes, monkeypatch):
    monkeypatch.setattr(nearest, "TILE_BYTES", tile_bytes)
    _, base = vectors(spark)
    nulls = spark.createDataFrame([(None, [0.0] * 8), (900, None)], "vec_id bigint, embedding array<float>")
    base = base.unionByName(nulls).withColumn("cell", F.lit("x")).withColumn("id", F.lit(1))
    queries = base.filter("vec_id < 90 or vec_id is null or vec_id = 900").withColumnRenamed("vec_id", "query_id")
    order = ["query_id", "place"]
    listed = knn(queries, base, 5, metric).orderBy(order).collect()
    assert len(listed) == 450
    assert nearest.knn_join(queries, base, 5, metric).orderBy(order).collect() == listed


def test_tiles_of_nothing(spark):
    _, base = vectors(spark, 5)
    queries = base.withColumnRenamed("vec_id", "query_id")
    assert nearest.knn_join(queries, base.limit(0), 3).count() == 0
    assert nearest.knn_join(queries.limit(0), base, 3).count() == 0
    assert nearest.knn_join(queries, base, 9).count() == 25


def test_ties_of_a_common_vector_rank_by_id_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TILE_BYTES", 8 * 2 * 16)
    base = spark.range(300).select(F.col("id").alias("vec_id"), F.expr("array(1.0D, 2.0D)").alias("embedding"))
    queries = base.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = nearest.knn_join(queries, base, 4).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["base_id"]) for r in got] == [(q, b) for q in range(0, 300, 50) for b in range(4)]


def test_a_hot_cell_is_cut_into_tiles(spark, monkeypatch):
    """Half of the rows and queries in one cell: no tile holds much more than its share."""
    monkeypatch.setattr(nearest, "TILE_BYTES", 8 * 8 * 100)
    rows = spark.range(4000).select(
        "id", F.expr("transform(sequence(1, 8), i -> double(hash(id, i)))").alias("vector"),
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50).cast("int").alias("cell"),
    )
    asked = rows.filter("id % 5 = 0")
    seen = spark.sparkContext.accumulator(0)
    size = nearest._of_tile

    def watched(metric, k):
        run = size(metric, k)

        def check(left, right):
            assert left.num_rows < 200 and right.num_rows < 200
            seen.add(left.num_rows * right.num_rows)
            return run(left, right)

        return check

    monkeypatch.setattr(nearest, "_of_tile", watched)
    found = nearest.ranked(nearest.nearest_in_cells(asked, rows, 3, "l2"), 3, "l2").collect()
    assert {r["query_id"] for r in found if r["place"] == 1 and r["base_id"] == r["query_id"]} == set(range(0, 4000, 5))
    pairs = asked.groupBy("cell").count().join(rows.groupBy("cell").agg(F.count("*").alias("n")), "cell")
    assert seen.value == pairs.agg(F.sum(F.col("count") * F.col("n"))).first()[0]


def test_index_of_clustered_rows_reads_little(spark, tmp_path):
    """Recall of 0.9 over all rows with vec_id % 50 = 0, with less than a third of the pairs compared."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(60, 16)) * 4
    data = (middle[rng.integers(60, size=6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    base = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = base.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    index = build_cells(base).write(str(tmp_path / "cells"))
    assert len(index.centres) > 60
    probes = index.probes_for(queries, 10, 1, 0.9)
    exact = {(r["query_id"], r["base_id"]) for r in nearest.knn_join(queries, base, 10).collect()}
    found = {(r["query_id"], r["base_id"]) for r in index.search(queries, 10, 1, recall=0.9).collect()}
    assert len(exact) == 1200 and len(found & exact) / len(exact) >= 0.9
    assert index.pairs_compared(queries, probes) < 120 * 6000 / 3


def test_cells_find_most_neighbours_and_all_with_every_cell(spark, tmp_path):
    _, base = vectors(spark, 400)
    queries = base.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["base_id"]) for r in knn(queries, base, 5).collect()}
    index = build_cells(base, 8).write(str(tmp_path / "cells"))
    some = {(r["query_id"], r["base_id"]) for r in index.search(queries, 5, probes=4).collect()}
    every = {(r["query_id"], r["base_id"]) for r in index.search(queries, 5, probes=8).collect()}
    assert len(some & exact) / len(exact) >= 0.7
    assert every == exact


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
@pytest.mark.parametrize("asked", ["knn_", "knn_rows_"])
def test_registered_index_search_has_its_recall(spark, asked, sf_dir):
    exact = {(r["query_id"], r["base_id"]) for r in QUERIES[f"{asked}l2"](spark, sf_dir).collect()}
    found = {(r["query_id"], r["base_id"]) for r in QUERIES[f"{asked}ivf"](spark, sf_dir).collect()}
    assert len(found & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("name", [*METRICS, "filtered", "ivf"])
def test_registered_searches_ask_with_rows(spark, name):
    sf_dir = "/root/testdata/sf0.1"
    asking = {r[0] for r in Tables(spark, sf_dir).embeddings.filter("vec_id % 50 = 0").select("vec_id").collect()}
    got = QUERIES[f"knn_rows_{name}"](spark, sf_dir).groupBy("query_id").count().collect()
    assert {r["query_id"] for r in got} == asking and {r["count"] for r in got} == {10}


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_index_recall_over_real_rows(spark, sf_dir):
    base = Tables(spark, sf_dir).embeddings
    queries = base.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["base_id"]) for r in knn(queries, base, 10).collect()}
    index = build_cells(base.select("vec_id", "embedding"), 16)
    found = {(r["query_id"], r["base_id"]) for r in index.search(queries, 10, probes=4, recall=0.9).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_sq8_error_is_below_half_a_step(spark):
    data, base = vectors(spark)
    low, high = dimension_ranges(base)
    back = sq8_decode(sq8_encode(base).drop("embedding"), low, high)
    step = np.array([(h - l) / 255 for l, h in zip(low, high)])
    for r in back.collect():
        assert np.all(np.abs(np.array(r["embedding"]) - data[r["vec_id"]]) <= step / 2 + 1e-9)


@pytest.mark.parametrize("block", [256, 2])
def test_bm25_equals_brute_force(spark, block):
    rnd = random.Random(9)
    words = ["the", "red", "Fox", "été", "x1", "jumps", "over"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 30))) + ".") for i in range(60)] + [(60, None), (61, "")]
    asks = [(1, "red fox"), (2, "the the été!"), (3, "unknown"), (4, "over x1"), (5, "")]
    got = bm25_topk(spark.createDataFrame(asks, "q bigint, text string"), spark.createDataFrame(docs, "d bigint, t string"),
                    5, "q", "text", "d", "t", block=block)
    texts = {d: [w.strip(".!").lower() for w in t.split() if w.strip(".!")] for d, t in docs if t is not None}
    mean = sum(map(len, texts.values())) / len(texts)
    want = []
    for q, text in asks:
        scores = []
        for d, ws in texts.items():
            s = 0.0
            for term in {w.strip("!").lower() for w in text.split()}:
                df, n = sum(term in x for x in texts.values()), ws.count(term)
                if n:
                    s += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            if s > 0:
                scores.append((-round(s, 6), d))
        want += [(q, d) for _, d in sorted(scores)[:5]]
    assert sorted((r["query_id"], r["doc_id"]) for r in got.collect()) == sorted(want)


def test_terms_and_embedding_hook(spark):
    df = spark.createDataFrame([("Ça va, l'été?",), ("",)], "t string")
    assert [r[0] for r in df.select(terms("t")).collect()] == [["ça", "va", "l", "été"], []]
    made = embed(df, "t", lambda s: [[float(len(x))] for x in s])
    assert sorted(r["embedding"] for r in made.collect()) == [[0.0], [13.0]]


def test_text_vectors_are_read_without_their_empty_slots(spark, tmp_path):
    """Slots of 2**18 by document and row would take minutes here; the weights are those of the stored terms."""
    rows = [(i, f"w{i % 7} w{i % 7} x{i}" if i % 10 else None) for i in range(6000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.monotonic()
    got = {r["doc_id"]: (r["nonzero"], r["sq"]) for r in QUERIES["tfidf_vectors"](spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 40
    assert len(got) == len(rows) and got[0] == (0, 0.0)
    often = {k: sum(i % 7 == k and i % 10 > 0 for i in range(6000)) for k in range(7)}
    idf = lambda n: math.log(6001 / (n + 1))
    want = {i: (2, round(4 * idf(often[i % 7]) ** 2 + idf(1) ** 2, 4)) for i in range(6000) if i % 10}
    # Some terms share a slot.
    assert sum(got[i][0] == 2 and abs(got[i][1] - w[1]) < 1e-3 for i, w in want.items()) > 0.9 * len(want)
