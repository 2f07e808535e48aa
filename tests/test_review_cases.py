"""Inputs that used to lose or misplace data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.columns import json_schema
from lakeloom.operators.mapping import MapRow, load_rejects, load_source
from lakeloom.operators.maintenance import compact
from lakeloom.operators.stats import latency_rollup
from lakeloom.sinks.tables import SchemaMismatch, ingest_files, read_table
from lakeloom.sources.files import read_csv_union
from lakeloom.streaming import carry, state
from test_streams import in_files, updates

T0 = dt.datetime(2024, 1, 1)


def test_schema_of_all_json_rows(spark):
    df = spark.createDataFrame([('{"k":1}',), ('{"q":"x"}',), ("not json",), (None,)], "props string")
    row = json_schema(df, "props").first()
    assert row["n"] == 2 and "k: BIGINT" in row["schema"] and "q: STRING" in row["schema"]


def mapped(spark):
    rows = [(1, "a", T0), (1, "b", T0 + dt.timedelta(1)), (1, "c", T0 + dt.timedelta(2))]
    return spark.createDataFrame(rows, "k int, v string, _czas_z_ekstraktu timestamp")


def test_a_shadowed_row_keeps_its_condition_and_key(spark):
    rows = [
        MapRow("s", "t", "k", "id"), MapRow("s", "t", "v", "val"),
        MapRow("s", "t", "v", "id", condition="v <> 'b'"), MapRow("s", "t", "k", "id", primary_key=True),
    ]
    got = sorted((r["id"], r["val"], r["_aktualne_do"]) for r in load_source(mapped(spark), rows).collect() if r["_aktualne_do"])
    assert got == [(1, "a", T0 + dt.timedelta(2))]
    assert load_source(mapped(spark), rows).count() == 2


def test_unreadable_values_are_set_apart(spark):
    src = spark.createDataFrame([("1", "5", T0), ("2", "five", T0), ("3", "", T0)], "k string, v string, _czas_z_ekstraktu timestamp")
    rows = [MapRow("s", "t", "k", "id", "INT", primary_key=True), MapRow("s", "t", "v", "val", "INT")]
    assert sorted(r["id"] for r in load_source(src, rows).collect()) == [1, 3]
    bad = load_rejects({"s": src}, rows, "t").collect()
    assert [(r["source_table"], r["broken"]) for r in bad] == [("s", ["v"])] and '"v":"five"' in bad[0]["row"]


def test_outages_are_not_lost(spark):
    log = spark.createDataFrame(
        [("a", T0, 5.0, False), ("a", T0, None, True), ("down", T0, None, True), (None, T0, 1.0, None)],
        "path string, at timestamp, ms double, failed boolean",
    )
    got = {r["path"]: r for r in latency_rollup(log, ["path"], "at", "ms", F.col("failed")).collect()}
    assert (got["a"]["n"], got["a"]["error_rate"], got["a"]["p50"]) == (2, 0.5, 5.0)
    assert (got["down"]["n"], got["down"]["error_rate"], got["down"]["p99"]) == (1, 1.0, None)
    assert (got[None]["n"], got[None]["error_rate"], got[None]["p50"]) == (1, 0.0, 1.0)


def test_a_full_batch_waits_for_the_watermark(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    parts = [[(1, 1, at(0), 1.0), (2, 1, at(10), 1.0)], [(3, 1, at(5), 1.0)], [(4, 2, at(5000), 1.0)], [(5, 2, at(9000), 1.0)]]
    done = carry.batch_stream(in_files(spark, tmp_path, parts), ["user"], "ts", "value", ["id"], delay="60 seconds", max_files=2, timeout_seconds=600)
    got = sorted((r["first_at"], r["last_at"], r["file_count"]) for r in done.filter("user = 1").collect())
    assert got == [(at(0), at(5), 2), (at(10), at(10), 1)]


def test_every_item_of_a_batch_is_kept(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    parts = [[(i, 1, at(i), 1.0) for i in range(50)]]
    got = updates(state.track_orders(in_files(spark, tmp_path, parts), "user", "id"), "track", spark, idle_batches=False)
    assert [(r["total"], r["held"]) for r in got.collect()] == [(50, 50)]


def test_csv_files_of_mixed_headers_in_one_folder(spark, tmp_path):
    (tmp_path / "in put").mkdir()
    (tmp_path / "in put/1.csv").write_text("id,name\n1,x\n")
    (tmp_path / "in put/2.csv").write_text("name,id\ny,2\n")
    (tmp_path / "in put/3.csv").write_text('id,"a, b"\n007,z\n')
    (tmp_path / "in put/4.csv").write_text("")
    df = read_csv_union(spark, [str(tmp_path / "in put")])
    assert df.columns == ["id", "name", "a, b"]
    assert sorted(map(tuple, df.collect()), key=str) == [("007", None, "z"), ("1", "x", None), ("2", "y", None)]


def parquet(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_no_column_of_a_requested_file_is_lost(spark, tmp_path):
    parquet(spark, tmp_path / "in", [(1,)], "id long")
    parquet(spark, tmp_path / "in", [(2, "c")], "id long, c string")
    files = spark.createDataFrame([("t", str(p)) for p in sorted((tmp_path / "in").glob("*.parquet"))] * 2, "table string, file string")
    assert ingest_files(files, lambda name: str(tmp_path / "out" / name)) == {"t": 2}
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "out/t")).collect())) == [(1, None), (2, "c")]


def test_nothing_is_appended_if_any_table_does_not_fit(spark, tmp_path):
    for name, schema in (("a", "id long"), ("b", "id long, x string")):
        parquet(spark, tmp_path / "in" / name, [(1,) if name == "a" else (1, "x")], schema)
        parquet(spark, tmp_path / "out" / name, [(0,)], "id long")
    files = [(n, str(p)) for n in "ab" for p in (tmp_path / "in" / n).glob("*.parquet")]
    with pytest.raises(SchemaMismatch):
        ingest_files(spark.createDataFrame(files, "table string, file string"), lambda name: str(tmp_path / "out" / name))
    assert spark.read.parquet(str(tmp_path / "out/a")).count() == 1


def test_compaction_keeps_all_columns(spark, tmp_path):
    parquet(spark, tmp_path / "many", [(1,)], "id long")
    parquet(spark, tmp_path / "many", [(2, "c")], "id long, c string")
    compact(spark, str(tmp_path / "many"), str(tmp_path / "few"), 1 << 20)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "few")).select("id", "c").collect())) == [(1, None), (2, "c")]


def test_csv_headers_behind_blank_lines_with_line_breaks_and_none_at_all(spark, tmp_path):
    files = {"a": "\n \t\nid,name\n1,x\n", "b": '﻿"id","na\nme"\n2,"y\nz"\n', "c": "", "d": "\n\n", "e": 'id,"say ""hi"""\n3,w\n'}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    got = read_csv_union(spark, [str(tmp_path)])
    assert got.columns == ["id", "name", "na\nme", 'say "hi"']
    assert sorted(map(tuple, got.collect())) == [("1", "x", None, None), ("2", None, "y\nz", None), ("3", None, None, "w")]
    only_empty = read_csv_union(spark, [str(tmp_path / "c.csv"), str(tmp_path / "d.csv")])
    assert only_empty.columns == [] and only_empty.count() == 0
