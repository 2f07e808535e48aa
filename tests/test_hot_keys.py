"""Sliced hot keys give what a plain per-key pass gives; brute force is the judge."""

import datetime as dt
import random
from itertools import groupby

import pytest
from pyspark.sql import Window, functions as F

from lakeloom.operators import ordered
from lakeloom.operators.bursts import burst_match
from lakeloom.operators.events import batch_files, batch_files_by_size, batch_totals, sessionize
from lakeloom.operators.history import as_of_join, with_validity
from lakeloom.operators.ordered import SLICE, order_by_key

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, user bigint, ts timestamp_ntz, value double"


def hot_rows(seed, n=600, step=200):
    """A third of the rows in key 1, another third in the NULL key, ties in time, missing values."""
    rnd = random.Random(seed)
    rows, clock = [], 0
    for i in range(n):
        clock += rnd.choice([0, 0, 1, 5, rnd.randint(1, step)])
        user = rnd.choice([1, None, rnd.randint(2, 20)])
        rows.append((i, user, BASE + dt.timedelta(seconds=clock), rnd.choice([None, float(rnd.randint(1, 9))])))
    return rows


def by_user(rows):
    key = lambda r: (r[1] is not None, r[1] or 0)
    for _, group in groupby(sorted(rows, key=key), key=key):
        yield sorted(group, key=lambda r: (r[2], r[0]))


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return hot_rows(request.param)


@pytest.fixture()
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def ordered_rows(df, limit):
    from lakeloom.functions.columns import micros

    return order_by_key(df.withColumn("at", micros("ts")), ["user"], "at", ("id",), limit)


def test_hot_keys_are_cut_and_others_are_not(df):
    rows = ordered_rows(df, 25)
    sizes = rows.df.groupBy("user", SLICE).count().collect()
    slices = {}
    for r in sizes:
        slices[r["user"]] = slices.get(r["user"], 0) + 1
    assert slices[1] > 4 and slices[None] > 4
    assert max(r["count"] for r in sizes) < 75
    cold = [u for u, n in slices.items() if u not in (1, None)]
    assert all(slices[u] == 1 for u in cold)


def test_one_instant_of_many_rows_is_cut_by_its_ties(spark):
    rows = [(i, 1, BASE + dt.timedelta(seconds=max(0, i - 49)), float(i)) for i in range(80)] + [(100, 2, BASE, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = ordered_rows(df, 10)
    sizes = {(r["user"], r[SLICE]): r["count"] for r in found.df.groupBy("user", SLICE).count().collect()}
    assert len(sizes) >= 8 and max(sizes.values()) <= 20 and sum(sizes.values()) == 81
    by_slice = sorted((r[SLICE], r["id"]) for r in found.df.filter("user = 1").collect())
    assert [i for _, i in by_slice] == list(range(80))
    done = found.position("pos").lead("id", "next").lag("id", "before").running_sum("value", "total").fill_forward("value", "known")
    got = {r["id"]: (r["pos"], r["next"], r["before"], r["total"], r["known"]) for r in done.result().filter("user = 1").collect()}
    assert got == {i: (i + 1, i + 1 if i < 79 else None, i - 1 if i else None, i * (i + 1) / 2, float(i)) for i in range(80)}


@pytest.mark.parametrize("limit", [1000, 10])
def test_slices_are_found_by_equality(spark, limit):
    """Whatever the number of cuts, each join has a row's key and cell as its equality and gives a row for a row."""
    df = spark.range(10_000).select("id", F.lit(1).alias("user"), F.col("id").alias("at"))
    hot = df.groupBy("user").agg(F.count("*").alias("_n"), F.min("at").alias("_lo"), F.max("at").alias("_hi"))
    grids, cells = ordered._grids(df, ["user"], "at", hot, limit)
    cuts = ordered._cuts(cells, ["user"], limit)
    sliced = ordered._in_slices(df, ["user"], "at", grids, cuts)
    plan = sliced._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any(" >= " in j or " < " in j for j in joins) and "NestedLoop" not in plan
    assert sliced.count() == 10_000 and sliced.select(SLICE).distinct().count() == 10_000 // limit


def test_far_off_times_do_not_undo_the_slices(spark):
    far = [(10_000, 1, dt.datetime(9999, 12, 31), 1.0), (10_001, 1, dt.datetime(1970, 1, 1), 1.0)]
    df = spark.createDataFrame([(i, 1, BASE + dt.timedelta(seconds=i), 1.0) for i in range(2000)] + far, SCHEMA)
    rows = ordered_rows(df, 100)
    sizes = [r["count"] for r in rows.df.groupBy(SLICE).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 200 and sum(sizes) == 2002
    places = {r["id"]: r["pos"] for r in rows.position("pos").result().collect()}
    assert places[10_001] == 1 and places[0] == 2 and places[1999] == 2001 and places[10_000] == 2002


def test_running_results_equal_plain_windows(df):
    rows = ordered_rows(df, 25)
    rows = rows.position("pos").lead("id", "next_id").lag("value", "before").running_sum("value", "total")
    rows = rows.fill_forward("value", "known")
    w = Window.partitionBy("user").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select(
        "id", F.row_number().over(w).cast("long"), F.lead("id").over(w), F.lag("value").over(w),
        F.sum(F.coalesce("value", F.lit(0))).over(upto), F.last("value", True).over(upto),
    )
    mine = rows.result().select("id", "pos", "next_id", "before", "total", "known")
    assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_validity_of_hot_keys(df, rows):
    got = with_validity(df, ["user"], "ts", ["id"], rows_per_slice=25)
    expected = {}
    for group in by_user(rows):
        for this, after in zip(group, group[1:] + [None]):
            expected[this[0]] = after and after[2]
    assert {r["id"]: r["_aktualne_do"] for r in got.collect()} == expected
    assert got.filter("_aktualne_od <> ts").count() == 0


def test_validity_without_keys_stays_open(df):
    assert with_validity(df, [], "ts").filter("_aktualne_do IS NOT NULL").count() == 0


def test_as_of_join_of_hot_keys(df, rows):
    facts = df.filter("id % 3 = 0").select("id", "user", "ts")
    versions = df.filter("id % 3 <> 0").select(
        "user", F.col("ts").alias("v_ts"), F.col("id").alias("v_id"), "value"
    )
    got = as_of_join(facts, versions, ["user"], "ts", "v_ts", ["v_id", "value"], ["v_id"], rows_per_slice=20)
    expected = {}
    for i, user, ts, _ in rows:
        if i % 3:
            continue
        known = [r for r in rows if r[0] % 3 and r[1] == user and user is not None and r[2] <= ts]
        best = max(known, key=lambda r: (r[2], r[0]), default=None)
        expected[i] = (best[0], best[3]) if best else (None, None)
    assert {r["id"]: (r["v_id"], r["value"]) for r in got.collect()} == expected


def sequential_batches(rows, max_files, timeout):
    out = []
    for group in by_user(rows):
        current = []
        for row in group:
            if current and (len(current) == max_files or (row[2] - current[-1][2]).total_seconds() >= timeout):
                out.append(current)
                current = []
            current.append(row)
        out.append(current)
    return sorted(
        ((b[0][1], b[0][2], b[-1][2], len(b), sum(r[3] for r in b if r[3] is not None) if any(r[3] is not None for r in b) else None)
         for b in out), key=str,
    )


@pytest.mark.parametrize("limit", [25, 1_000_000])
@pytest.mark.parametrize("max_files,timeout", [(5, 30), (50, 5)])
def test_batches_equal_sequential_processing(df, rows, limit, max_files, timeout):
    numbered = batch_files(df, ["user"], "ts", "value", ["id"], max_files, timeout, limit)
    totals = batch_totals(numbered, ["user"], "ts", "value").drop("batch_start")
    assert sorted(map(tuple, totals.collect()), key=str) == sequential_batches(rows, max_files, timeout)


def test_sessions_of_hot_keys(df):
    n = [F.count(F.lit(1)).alias("n")]
    got = sessionize(df, ["user"], "ts", ["id"], 60, n, rows_per_slice=25)
    built_in = df.groupBy("user", F.session_window("ts", "60 seconds").alias("w")).agg(*n)
    want = built_in.select("user", "w.start", "w.end", "n").collect()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)


def test_gap_of_exactly_the_timeout_closes_a_batch(spark):
    rows = [(0, 1, BASE, 1.0), (1, 1, BASE + dt.timedelta(seconds=30), 1.0), (2, 1, BASE + dt.timedelta(seconds=59), 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    totals = batch_totals(batch_files(df, ["user"], "ts", "value", ["id"]), ["user"], "ts", "value")
    assert sorted(r["file_count"] for r in totals.collect()) == [1, 2]


def test_burst_of_51_files_makes_two_batches(spark):
    df = spark.createDataFrame([(i, 1, BASE + dt.timedelta(seconds=i), 1.0) for i in range(51)], SCHEMA)
    totals = batch_totals(batch_files(df, ["user"], "ts", "value", ["id"]), ["user"], "ts", "value")
    assert sorted(r["file_count"] for r in totals.collect()) == [1, 50]


def test_size_batches_of_hot_keys(df, rows):
    got = batch_files_by_size(df, ["user"], "ts", "value", ["id"], 20, rows_per_slice=25)
    expected = {}
    for group in by_user(rows):
        total = 0.0
        for row in group:
            expected[row[0]] = int(total // 20)
            total += row[3] or 0.0
    assert {r["id"]: r["batch_no"] for r in got.collect()} == expected


def sequential_bursts(rows, min_events, span):
    out = []
    for group in by_user(rows):
        i = 0
        while i < len(group):
            j = i
            while j < len(group) and (group[j][2] - group[i][2]).total_seconds() < span:
                j += 1
            if j - i >= min_events:
                out.append((group[i][1], group[i][2], group[j - 1][2], j - i))
                i = j
            else:
                i += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [25, 1_000_000])
@pytest.mark.parametrize("span", [40, 600])
def test_bursts_equal_sequential_matching(df, rows, limit, span):
    got = burst_match(df, ["user"], "ts", ["id"], 3, span, limit)
    assert sorted(map(tuple, got.collect()), key=str) == sequential_bursts(rows, 3, span)


def test_bursts_of_an_even_beat_cross_many_slices(spark):
    """The slowest case for the choice across slices: no two starting points ever meet."""
    rows = [(i, 7, BASE + dt.timedelta(seconds=10 * i), 1.0) for i in range(150)]
    got = burst_match(spark.createDataFrame(rows, SCHEMA), ["user"], "ts", ["id"], 3, 70, 40)
    assert sorted(map(tuple, got.collect()), key=str) == sequential_bursts(rows, 3, 70)


def test_bursts_of_a_dense_key_take_linear_time(spark):
    """Every span holds all 200,000 events: going through each span per row would not end."""
    df = spark.range(200_000).select(
        "id", F.lit(1).cast("long").alias("user"), F.timestamp_micros(F.col("id")).alias("ts")
    )
    got = burst_match(df, ["user"], "ts", ["id"]).collect()
    assert [r["n"] for r in got] == [200_000]


@pytest.mark.parametrize("sizes,expected", [([2], []), ([3], [3]), ([7], [7])])
def test_runs_within_the_span(spark, sizes, expected):
    rows = [(i, 1, BASE + dt.timedelta(minutes=i), 1.0) for i in range(sizes[0])]
    got = burst_match(spark.createDataFrame(rows, SCHEMA), ["user"], "ts", ["id"])
    assert [r["n"] for r in got.collect()] == expected


def test_events_exactly_one_span_apart_do_not_match(spark):
    rows = [(i, 1, BASE + dt.timedelta(minutes=5 * i), 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert burst_match(df, ["user"], "ts", ["id"]).count() == 0


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert burst_match(empty, ["user"], "ts", ["id"]).count() == 0
    assert with_validity(empty, ["user"], "ts", ["id"]).count() == 0
    assert batch_files(empty, ["user"], "ts", "value", ["id"]).count() == 0


def test_no_window_runs_in_a_single_partition(df):
    plan = ordered_rows(df, 1_000_000).position("pos").result()._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert ordered.ROWS_PER_SLICE > 0
