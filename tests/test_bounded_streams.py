"""Streams over several triggers: chained joins, bounded input and state, messages written again after a failure."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from lakeloom.sinks.messages import as_messages, read_messages, send_messages, subscribe
from lakeloom.sources.messages import parse_json
from lakeloom.streaming import jobs, run
from lakeloom.streaming.run import run_to_table, stream_table, to_table, write_in_time

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, user bigint, ts timestamp, kind string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def in_files(spark, tmp_path, parts):
    path = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


def side(spark, path, kind, names):
    rows = stream_table(spark, path, maxFilesPerTrigger=1).filter(F.col("kind") == kind)
    return rows.select(*(F.col(c).alias(n) for c, n in zip(("id", "user", "ts"), names, strict=True)))


def three(spark, path, how):
    legs = [
        jobs.Leg(side(spark, path, "b", ("b", "b_user", "b_at")), "b_user", "b_at", "30 MINUTES", "10 minutes"),
        jobs.Leg(side(spark, path, "c", ("c", "c_user", "c_at")), "c_user", "c_at", "20 MINUTES", "10 minutes"),
    ]
    return jobs.interval_chain(side(spark, path, "a", ("a", "a_user", "a_at")), "a_user", "a_at", "10 minutes", legs, how)


def test_three_streams_join_over_triggers(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(3), at(i), rnd.choice("abc")) for i in range(120)]
    parts = [rows[k : k + 30] for k in range(0, 120, 30)]
    got, triggers = run_to_table(three(spark, in_files(spark, tmp_path, parts), "inner"), "three")
    want = {
        (a[0], b[0], c[0])
        for a in rows if a[3] == "a"
        for b in rows if b[3] == "b" and b[1] == a[1] and 0 <= (b[2] - a[2]).total_seconds() <= 1800
        for c in rows if c[3] == "c" and c[1] == a[1] and 0 <= (c[2] - a[2]).total_seconds() <= 1200
    }
    assert want and {(r["a"], r["b"], r["c"]) for r in got.collect()} == want
    assert sum(t.input_rows > 0 for t in triggers) >= 3


def test_late_rows_join_nothing_and_lonely_rows_come_out(spark, tmp_path):
    """Rows behind the watermark are dropped by the first and by the second join; rows without partners come with NULLs."""
    end = [(90, 9, at(900), "a"), (91, 9, at(900), "b"), (92, 9, at(900), "c")]
    parts = [
        [(1, 1, at(0), "a"), (2, 1, at(5), "b"), (3, 1, at(6), "c"), (4, 2, at(1), "a"), (5, 3, at(2), "a"), (6, 3, at(3), "c")],
        [(10, 4, at(200), "a"), (11, 4, at(201), "b"), (12, 4, at(202), "c")],
        [(13, 4, at(260), "a"), (14, 4, at(261), "b"), (15, 4, at(262), "c")],
        [(20, 2, at(4), "b"), (21, 2, at(5), "c")],  # far too late
        end, [(i + 10, 8, at(1900), k) for i, _, _, k in end], [(i + 20, 8, at(2900), k) for i, _, _, k in end],
    ]
    got, triggers = run_to_table(three(spark, in_files(spark, tmp_path, parts), "leftOuter"), "three")
    found = {(r["a"], r["b"], r["c"]) for r in got.collect()}
    early = {x for x in found if x[0] < 90}
    assert early == {(1, 2, 3), (4, None, None), (5, None, 6), (10, 11, 12), (13, 14, 15)}
    assert sum(t.late_rows for t in triggers) >= 2


def test_state_rows_fall_behind_the_watermark(spark, tmp_path):
    """What a join and a window keep follows the time bound, not the rows read so far."""
    rows = [(i, i % 5, at(i), "ab"[i % 2]) for i in range(600)]
    path = in_files(spark, tmp_path, [rows[k : k + 100] for k in range(0, 600, 100)])
    left, right = side(spark, path, "a", ("a", "u", "x")), side(spark, path, "b", ("b", "v", "y"))
    joined = jobs.interval_join(left, right, "u", "v", "x", "y", "15 MINUTES", "5 minutes", "5 minutes", "inner")
    _, triggers = run_to_table(joined, "bounded-join")
    assert sum(t.input_rows for t in triggers) >= 1200 and len([t for t in triggers if t.input_rows]) >= 6
    assert max(t.state_rows for t in triggers) < 250 and triggers[-1].state_rows < 60
    windows = jobs.tumbling_window(stream_table(spark, path, maxFilesPerTrigger=1), "ts", ["user"], "10 minutes", [F.count("*").alias("n")], "5 minutes")
    got, triggers = run_to_table(windows, "bounded-windows")
    assert max(t.state_rows for t in triggers) <= 5 * 14 and triggers[-1].state_rows <= 10
    assert got.agg(F.sum("n")).first()[0] >= 580


@pytest.mark.parametrize("bound", [{"maxFilesPerTrigger": 2}, {"maxBytesPerTrigger": 1}])
def test_a_trigger_takes_a_bounded_part(spark, tmp_path, bound):
    path = in_files(spark, tmp_path, [[(i, 1, at(i), "a")] for i in range(6)])
    rows, triggers = run_to_table(stream_table(spark, path, **bound), "bounded")
    assert rows.count() == 6
    most = bound.get("maxFilesPerTrigger", 1)
    assert [t.input_rows for t in triggers if t.input_rows] == [most] * (6 // most)


def test_time_slices_are_written_in_order(spark, tmp_path):
    rows = [(i, 1, at(random.Random(i).randrange(1000)), "a") for i in range(200)]
    path = str(tmp_path / "slices")
    step = write_in_time(spark.createDataFrame(rows, SCHEMA), "ts", path, 5)
    out = to_table(jobs.deduplicate(stream_table(spark, path, maxFilesPerTrigger=1), ["id"], "ts", f"{step} seconds"), "in-time")
    assert out.count() == 200
    empty = str(tmp_path / "none")
    write_in_time(spark.createDataFrame([], SCHEMA), "ts", empty, 3)
    assert spark.read.parquet(empty).count() == 0


def test_triggers_follow_the_rows_not_the_partitions(spark, tmp_path, monkeypatch):
    """A table of many small partitions is one file a step; a large step is cut into files of bounded rows."""
    rows = [(i, i % 3, at(random.Random(i).randrange(1000)), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    for name, most, files in (("few", 1_000_000, 4), ("cut", 50, 8)):
        monkeypatch.setattr(run, "FILE_ROWS", most)
        path = str(tmp_path / name)
        step = write_in_time(df, "ts", path, 4)
        stream = jobs.deduplicate(stream_table(spark, path, maxFilesPerTrigger=1), ["id"], "ts", f"{step} seconds")
        out, triggers = run_to_table(stream, name)
        assert sorted(r["id"] for r in out.collect()) == list(range(400))
        assert files <= sum(t.input_rows > 0 for t in triggers) <= 1.5 * files


def messages(spark, path, mode="binary"):
    rows = stream_table(spark, path, maxFilesPerTrigger=1)
    attributes = {"id": F.col("id"), "time": F.col("ts"), "none": F.lit(None).cast("string")}
    return as_messages(rows, F.when(F.col("kind") != "?", F.col("kind")), F.col("user"), ["id", "ts"], attributes, mode)


def test_a_replayed_batch_writes_over_its_messages(spark, tmp_path):
    path = in_files(spark, tmp_path, [[(i, i % 2, at(i), "ab?"[i % 3])] * 2 for i in range(3)])
    out = send_messages(messages(spark, path), "sink")
    read = lambda: sorted(map(str, read_messages(spark, out).collect()))
    first = read()
    assert len(first) == 6 and {r["topic"] for r in read_messages(spark, out).collect()} == {"a", "b", "unrouted"}
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/checkpoint/commits/2")
    files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, False)  # as if the run had ended before its commit
    send_messages(messages(spark, path), "sink", out)
    assert read() == first


def test_topics_are_selected_by_folder_and_as_a_stream(spark, tmp_path):
    path = in_files(spark, tmp_path, [[(1, 7, at(1), "a"), (2, None, at(2), "b"), (3, 7, at(3), "c")]])
    out = send_messages(messages(spark, path), "sink")
    some = read_messages(spark, out, ["a", "b"])
    assert {(r["topic"], r["key"]) for r in some.collect()} == {("a", "7"), ("b", None)}
    assert "PartitionFilters: [topic" in some._jdf.queryExecution().executedPlan().toString()
    followed = to_table(subscribe(spark, out, ["c"]), "follow").collect()
    assert [(r["topic"], r["headers"]["ce_id"]) for r in followed] == [("c", "3")] and "ce_none" not in followed[0]["headers"]


def test_binary_and_structured_content(spark, tmp_path):
    path = in_files(spark, tmp_path, [[(1, 7, at(1), "a")]])
    binary = read_messages(spark, send_messages(messages(spark, path), "sink"))
    good, dead = parse_json(binary, "id bigint, ts timestamp")
    assert [(r["id"], r["ts"], r["headers"]["content-type"]) for r in good.collect()] == [(1, at(1), "application/json")] and dead.isEmpty()
    whole = read_messages(spark, send_messages(messages(spark, path, "structured"), "sink"))
    good, _ = parse_json(whole, "id string, data struct<id bigint, ts timestamp>")
    assert [(r["id"], r["data"]["id"]) for r in good.collect()] == [("1", 1)]
    with pytest.raises(ValueError):
        messages(spark, path, "other")
