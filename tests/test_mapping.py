"""Mapping-driven loads, lookups, typed projection and writers."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F, types as T

from lakeloom.operators.lookup import Calendar, DuplicateKey, period_lookup
from lakeloom.operators.mapping import (
    MapRow, by_source, conditions, key_columns, load_source, load_target, read_mapping, typed_projection,
)
from lakeloom.plans.history import calendar
from lakeloom.sinks.tables import SchemaMismatch, append_table, check_compat, read_table, replace_table, write_checked
from lakeloom.sources.files import read_csv_union, schema_profile
from lakeloom.sources.sqlscript import run_script, split_statements

T0 = dt.datetime(2024, 1, 1)
HEADER = (
    "Tabela zrodlowa;Tabela docelowa;Kolumna w tab zrodlowej;Kolumna w tab docelowej;STEREOTYPE;TYPE;PRECISION;SCALE;"
    "PRIMARY_KEY;WARUNKI;ZRODLO\n"
)


def test_mapping_file(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text(
        HEADER + "src;tgt;a;x;;DECIMAL;9;3;1;where a > 1; raw \nsrc;tgt;b;y;;;;;0;;RAW\nsrc;tgt;c;z;;;;;0;;OTHER\nsrc;;d;q;;;;;;;RAW\n"
    )
    rows = read_mapping(spark, str(path))
    assert [(r.source_column, r.target_column) for r in rows] == [("a", "x"), ("b", "y")]
    assert rows[0].data_type() == T.DecimalType(9, 3) and rows[0].primary_key
    assert list(by_source(rows, "tgt")) == ["src"]


def test_conditions_are_stripped_distinct_and_sorted():
    rows = [MapRow("s", "t", c, c, condition=w) for c, w in
            (("a", "WHERE b = 1"), ("b", "b = 1"), ("c", "a = 2 OR a = 3"), ("d", " "))]
    assert conditions(rows) == ["a = 2 OR a = 3", "b = 1"]


def test_key_choice():
    rows = [MapRow("s", "t", "a", "x", primary_key=True), MapRow("s", "t", "b", "y")]
    assert key_columns(rows, ["b", ""]) == ["b"]
    assert key_columns(rows, ["", " "]) == ["a"]
    assert key_columns([rows[1]], None) == []


def raw(spark):
    rows = [(1, "a", "p", T0), (1, "b", "q", T0 + dt.timedelta(days=1)), (2, "c", "p", T0), (1, "z", "no", T0 + dt.timedelta(hours=1))]
    return spark.createDataFrame(rows, "k int, v string, w string, _czas_z_ekstraktu timestamp")


def test_conditions_apply_before_history_and_or_is_grouped(spark):
    rows = [MapRow("s", "t", "k", "id", primary_key=True), MapRow("s", "t", "v", "val", condition="w = 'p' OR w = 'q'"),
            MapRow("s", "t", "k", "k2", condition="where k > 0")]
    got = load_source(raw(spark), rows).collect()
    ends = {(r["id"], r["val"]): r["_aktualne_do"] for r in got}
    assert ends == {(1, "a"): T0 + dt.timedelta(days=1), (1, "b"): None, (2, "c"): None}
    assert all(r["k2"] == r["id"] and r["_aktualne_od"] == r["_czas_z_ekstraktu"] for r in got)


def test_history_uses_the_source_key_even_if_a_target_has_its_name(spark):
    """Target `k` holds another column; partitioning by it would join unrelated rows."""
    rows = [MapRow("s", "t", "k", "id", primary_key=True), MapRow("s", "t", "w", "k")]
    got = load_source(raw(spark), rows).collect()
    assert sum(r["_aktualne_do"] is None for r in got) == 2


@pytest.mark.parametrize("schemas,expected", [
    (None, ["_czas_z_ekstraktu", "_czas_aktualizacji", "_aktualne_od", "_aktualne_do"]),
    ({}, ["_czas_z_ekstraktu", "_czas_aktualizacji"]),
    ({"t": {"id", "_aktualne_od"}}, ["_aktualne_od"]),
])
def test_technical_columns_follow_the_target(spark, schemas, expected):
    rows = [MapRow("s", "t", "k", "id", primary_key=True)]
    assert load_target({"s": raw(spark)}, rows, "t", target_schemas=schemas).columns == ["id", *expected]


def test_period_without_time_source_is_null(spark):
    rows = [MapRow("s", "t", "k", "id"), MapRow("s", "t", "v", "okres_w_dobie_id")]
    assert {r["okres_w_dobie_id"] for r in load_source(raw(spark), rows).collect()} == {None}


def test_period_lookup_in_a_load(spark):
    src = spark.createDataFrame(
        [(1, T0.date(), dt.datetime(2024, 1, 1, 23, 0), "PT60M", T0), (2, T0.date(), dt.datetime(2024, 1, 1, 10, 15), "PT15M", T0),
         (3, T0.date(), dt.datetime(2024, 1, 1, 10, 15), "P1D", T0), (4, None, None, None, T0)],
        "id int, doba date, udt_do timestamp, ziarno_cz string, _czas_z_ekstraktu timestamp",
    )
    rows = [MapRow("s", "t", "id", "id", primary_key=True), MapRow("s", "t", "udt_do", "okres_w_dobie_id"),
            MapRow("s", "t", "udt_do", "czas_do_utc"), MapRow("s", "t", "doba", "doba_pl")]
    got = {r["id"]: (r["okres_w_dobie_id"], r["doba_pl"]) for r in load_source(src, rows, calendar=calendar(spark)).collect()}
    assert got == {1: ("R-PT60M-23:00", dt.date(2024, 1, 2)), 2: ("R-PT15M-10:15", dt.date(2024, 1, 1)),
                   3: (None, dt.date(2024, 1, 1)), 4: (None, None)}


def test_duplicate_dimension_keys_are_refused(spark):
    good = calendar(spark)
    with pytest.raises(DuplicateKey):
        period_lookup(raw(spark), "_czas_z_ekstraktu", "w", Calendar(good.days.union(good.days), good.periods))


def test_typed_projection_cases(spark):
    df = spark.createDataFrame(
        [("2024-02-30", "1.5"), ("2024-02-29", "1234567.5"), ("", ""), (None, "2.0005"), ("2024-01-01", "x")], "d string, n string"
    )
    rows = [MapRow("s", "t", "d", "day", "DATE"), MapRow("s", "t", "n", "num", "DECIMAL", 9, 3)]
    good, bad = typed_projection(df, rows)
    assert sorted(map(tuple, good.collect()), key=str) == sorted(
        [(None, None), (None, decimal.Decimal("2.001"))], key=str)
    assert {tuple(r["_broken"]) for r in bad.collect()} == {("d",), ("n",)} and bad.count() == 3


# ---- CSV union and writers

def test_employees(spark, tmp_path):
    files = {
        "employees_added.csv": "id,name,age,department,email\n7,Grace Lee,28,Sales,g@example.com\n8,Hank Wilson,42,Engineering,h@example.com\n9,Ivy Chen,31,Marketing,i@example.com\n",
        "employees_deleted.csv": "id,name,department\n4,Dave Brown,Sales\n5,Eve Davis,Engineering\n6,Frank Miller,Marketing\n",
        "employees_renamed.csv": "id,full_name,age,department\n1,Alice Smith,30,Engineering\n2,Bob Jones,25,Marketing\n3,Carol White,35,Engineering\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    df = read_csv_union(spark, [str(tmp_path / n) for n in reversed(files)])
    assert df.columns == ["id", "name", "age", "department", "email", "full_name"]
    assert {t for _, _, t, _ in schema_profile(df)} == {"string"}
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns]).first().asDict()
    assert nulls == {"id": 0, "name": 3, "age": 3, "department": 0, "email": 6, "full_name": 6}
    counts = {r["department"]: r["count"] for r in df.groupBy("department").count().collect()}
    assert counts == {"Engineering": 4, "Marketing": 3, "Sales": 2}


def test_append_refuses_other_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark.range(3), path)
    with pytest.raises(SchemaMismatch):
        append_table(spark.range(2).withColumn("x", F.lit(1)), path)
    with pytest.raises(SchemaMismatch):
        append_table(spark.range(2).select(F.col("id").cast("int")), path)
    append_table(spark.range(2), path)
    assert read_table(spark, path).count() == 5


def test_named_table_and_check(spark):
    assert write_checked(spark.range(7), "checked_rows").passed
    append_table(spark.range(2), "checked_rows")
    assert read_table(spark, "checked_rows").count() == 9


def test_empty_write_passes(spark, tmp_path):
    check = write_checked(spark.range(0), str(tmp_path / "empty"))
    assert (check.written, check.found, check.passed) == (0, 0, True)


@pytest.mark.parametrize("new,modes", [
    ("a int, b string", {"STRICT", "BACKWARD", "FORWARD", "FULL", "NONE"}),
    ("a bigint, b string", {"BACKWARD", "NONE"}),
    ("a int, b string, c int", {"BACKWARD", "FORWARD", "FULL", "NONE"}),
    ("a int", {"BACKWARD", "FORWARD", "FULL", "NONE"}),
    ("a int not null, b string, c int not null", {"FORWARD", "NONE"}),
    ("a string, b string", {"NONE"}),
])
def test_compatibility(spark, new, modes):
    old, new = T.StructType.fromDDL("a int, b string"), T.StructType.fromDDL(new)
    assert {m for m in ("STRICT", "BACKWARD", "FORWARD", "FULL", "NONE") if not check_compat(old, new, m)} == modes


def test_script_splitting(spark):
    text = "-- one; two\nSELECT 'a;b' AS x, \"q;\" AS y; /* c; */ ;\n  ;SELECT 1 AS `s;t`"
    assert len(split_statements(text)) == 2
    results = run_script(spark, text)
    assert results[0][1].first()["x"] == "a;b" and results[1][1].columns == ["s;t"]
    assert run_script(spark, "CREATE OR REPLACE TEMPORARY VIEW vv AS SELECT 1 AS a;")[0][1] is None
