"""Streams over several micro-batches: carried state, late rows, replays, state start."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F
from test_hot_keys import sequential_batches, sequential_bursts

from lakeloom.session import new_path
from lakeloom.sinks.tables import read_table
from lakeloom.streaming import carry, jobs, state
from lakeloom.streaming.run import each_batch, stream_table, to_table

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, user bigint, ts timestamp, value double"


def in_files(spark, tmp_path, parts):
    """One file per part, with modification times in order; one file per trigger."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    return stream_table(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)


def timed_rows(seed, n=240):
    rnd = random.Random(seed)
    rows, clock = [], 0
    for i in range(n):
        clock += rnd.choice([0, 1, 5, 40, rnd.randint(1, 90)])
        rows.append((i, rnd.choice([1, 1, 2, 3]), T0 + dt.timedelta(seconds=clock), float(rnd.randint(1, 9))))
    return rows


def in_three(rows):
    third = len(rows) // 3
    # A cut within one instant would make its remaining rows late in event time; keep ties together.
    cuts = [0]
    for at in (third, 2 * third):
        while rows[at][2] == rows[at - 1][2]:
            at += 1
        cuts.append(at)
    return [rows[a:b] for a, b in zip(cuts, cuts[1:] + [len(rows)])]


def test_batches_carry_over_triggers(spark, tmp_path):
    rows = timed_rows(1)
    stream = in_files(spark, tmp_path, in_three(rows))
    done = carry.batch_stream(stream, ["user"], "ts", "value", ["id"], max_files=4, timeout_seconds=60)
    end = rows[-1][2]
    want = [b for b in sequential_batches(rows, 4, 60) if b[3] >= 4 or (end - b[2]).total_seconds() >= 60]
    got = done.select("user", "first_at", "last_at", "file_count", "total_bytes")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_bursts_carry_over_triggers(spark, tmp_path):
    rows = timed_rows(2)
    stream = in_files(spark, tmp_path, in_three(rows))
    done = carry.burst_stream(stream, ["user"], "ts", ["id"], min_events=3, span_seconds=120)
    end = rows[-1][2]
    want = [b for b in sequential_bursts(rows, 3, 120) if (end - b[1]).total_seconds() >= 120]
    assert sorted(map(tuple, done.collect()), key=str) == sorted(want, key=str)


def test_late_rows_are_a_side_output(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    parts = [[(1, 1, at(0), 1.0), (2, 1, at(60), 1.0)], [(3, 1, at(49), 1.0), (4, 1, at(50), 1.0)], [(5, 1, at(10), 1.0), (6, 1, at(61), 1.0)]]
    in_time, late = jobs.split_late(in_files(spark, tmp_path, parts), "ts", "10 MINUTES", "late")
    assert sorted(r["id"] for r in late.collect()) == [3, 5]
    assert sorted(r["id"] for r in in_time.collect()) == [1, 2, 4, 6]


def test_windows_close_as_the_watermark_passes(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    parts = [[(1, 1, at(5), 1.0), (2, 1, at(70), 2.0)], [(3, 1, at(80), 3.0), (4, 1, at(300), 4.0)], [(5, 1, at(10), 9.0)]]
    windows = jobs.tumbling_window(
        in_files(spark, tmp_path, parts), "ts", ["user"], "1 minute", [F.sum("value").alias("total")], "10 seconds")
    got = to_table(windows, "windows").orderBy("window_start").collect()
    assert [(r["window_start"], r["total"]) for r in got] == [(at(0), 1.0), (at(60), 5.0)]


def test_replayed_rows_are_dropped(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    parts = [[(1, 1, at(5), 1.0), (1, 1, at(5), 1.0)], [(1, 1, at(5), 1.0), (2, 1, at(20), 2.0)]]
    kept = to_table(jobs.deduplicate(in_files(spark, tmp_path, parts), ["id"], "ts", "1 hour"), "dedup")
    assert sorted(r["id"] for r in kept.collect()) == [1, 2]


def updates(df, label, spark, **options):
    out = new_path(spark, label)
    write = lambda batch, i, folder: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
    each_batch(df, label, write, "update", **options)
    return read_table(spark, out)


def test_tracker_starts_from_existing_totals(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    parts = [[(1, 1, at(1), 1.0), (2, 2, at(2), 1.0)], [(3, 1, at(3), 1.0)]]
    known = spark.createDataFrame([(1, 10), (9, 5)], "user bigint, total bigint")
    got = updates(state.track_orders(in_files(spark, tmp_path, parts), "user", "id", known), "track", spark, idle_batches=False)
    assert {r["user"]: r["m"] for r in got.groupBy("user").agg(F.max("total").alias("m")).collect()} == {1: 12, 2: 1}


def test_changelog_keeps_the_tombstone(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    parts = [[(1, 1, at(5), 1.0), (2, 2, at(6), 2.0)], [(3, 1, at(9), None)], [(4, 1, at(7), 5.0), (5, 2, at(8), 3.0)]]
    got = updates(state.changelog_updates(in_files(spark, tmp_path, parts), "user", "value", "ts", "id"), "log", spark)
    last = {r["user"]: r["v"] for r in got.groupBy("user").agg(F.max_by("value", "batch").alias("v")).collect()}
    assert last == {1: None, 2: 3.0}


def test_interval_join_emits_unmatched_rows_late(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    parts = [[(1, 1, at(0), 1.0), (2, 2, at(1), 1.0)], [(3, 1, at(60), 2.0)], [(4, 3, at(400), 1.0), (5, 3, at(400), 2.0)], [(6, 4, at(900), 1.0), (7, 4, at(900), 2.0)]]
    in_files(spark, tmp_path, parts)
    side = lambda v, names: stream_table(spark, str(tmp_path / "in"), maxFilesPerTrigger=1).filter(F.col("value") == v).select(
        F.col("id").alias(names[0]), F.col("user").alias(names[1]), F.col("ts").alias(names[2]))
    joined = jobs.interval_join(side(1.0, "oux"), side(2.0, ("p", "payer", "paid")), "u", "payer", "x", "paid", "1 HOUR", "10 minutes", "30 minutes")
    got = to_table(joined, "join")
    pairs = {(r["o"], r["p"]) for r in got.collect()}
    assert {(1, 3), (2, None), (4, 5), (6, 7)} <= pairs and (1, None) not in pairs


def test_topic_windows_run(spark, tmp_path):
    stream = in_files(spark, tmp_path, [[(1, 1, T0, 1.0), (2, 1, T0, 3.0)]]).withColumnRenamed("user", "topic")
    got = updates(jobs.topic_window(stream, "topic", "value"), "topic", spark)
    assert got.agg(F.max("n"), F.max("total"), F.max("mean")).first()[:] == (2, 4.0, 2.0)
