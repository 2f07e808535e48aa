"""Zipped deliveries: names, encodings, ragged lines, headers, broken archives."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.names import archive_base, archive_table, business_date, delivery_flag, version_time
from lakeloom.sources import archives as ar


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("in")
    files = {
        "20250101/TAB_A_20250101_K_20250101000000001.csv.ZIP": packed(
            a__csv=b"\xef\xbb\xbfid; name ;city\r\n1;Ann;Rome\r\n\r\n2;Bob\r\n3;;Oslo\r\n4;x;y;z\r\n"
        ),
        "20250102/TAB_A_20250102_K_20250102000000001.csv.zip": packed(
            readme__txt=b"no", b__CSV="id;land;id\n5;Śląsk;9\n".encode(), c__csv=b"other\n1\n"
        ),
        "20250102/TAB_B_20250102__20250102000000001.csv.zip": packed(x__csv="k;v\n1;Köln\n".encode("latin-1")),
        "20250101/TAB_B_20250102__20250102000000001.csv.zip": packed(x__csv=b"k;v\n1;old\n"),
        "20250103/TAB_C_20250103_K_20250103000000001.csv.zip": packed(x__csv=b"only;header\n"),
        "20250103/TAB_D_20250103_K_20250103000000001.csv.zip": b"this is not a zip",
        "20250103/TAB_E_20250103_K_20250103000000001.csv.zip": packed(x__txt=b"nothing"),
        "20250103/nodate.csv.zip": packed(x__csv=b"a\n1\n"),
        "20250103/note.txt": b"not an archive",
    }
    for name, data in files.items():
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_bytes(data)
    return str(base)


@pytest.fixture(scope="module")
def delivery(spark, root):
    return ar.Delivery(ar.read_archives(spark, root))


def test_inventory_counts_archives_of_any_case(spark, root):
    found = {r["table"]: r["archives"] for r in ar.inventory(ar.read_archives(spark, root)).collect()}
    assert found == {"TAB_A": 2, "TAB_B": 2, "TAB_C": 1, "TAB_D": 1, "TAB_E": 1}


def test_inventory_does_not_read_the_content(spark, root):
    plan = ar.inventory(ar.read_archives(spark, root))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_header_union_is_trimmed_and_in_path_order(delivery):
    assert delivery.columns["TAB_A"] == ["id", "name", "city", "land"]
    assert delivery.columns["TAB_C"] == ["only", "header"]


def test_table_of_two_layouts(delivery):
    rows = delivery.table("TAB_A").select("id", "name", "city", "land").collect()
    assert sorted(map(tuple, rows)) == [
        ("1", "Ann", "Rome", None), ("3", None, "Oslo", None), ("5", None, None, "Śląsk"),
    ]


def test_last_delivery_of_a_name_wins_and_latin1_is_read(delivery):
    assert [tuple(r) for r in delivery.table("TAB_B").select("k", "v").collect()] == [("1", "Köln")]


def test_replaced_deliveries_are_counted(spark, root):
    rows = ar.latest_delivery(ar.read_archives(spark, root)).filter("replaced > 0").collect()
    assert [(r["table"], r["replaced"]) for r in rows] == [("TAB_B", 1)]
    assert "20250102/" in rows[0]["path"]


def test_header_only_gives_no_rows(delivery):
    assert delivery.table("TAB_C").count() == 0


def test_ragged_lines_are_kept_apart(delivery):
    rows = delivery.quarantine().collect()
    assert sorted((r["table"], r["line"]) for r in rows) == [("TAB_A", "2;Bob"), ("TAB_A", "4;x;y;z")]


def test_unreadable_archives_are_reported(delivery):
    problems = {r["path"].split("/")[-1][:5]: r["problem"] for r in delivery.problems().collect()}
    assert problems == {"TAB_D": "not a zip archive", "TAB_E": "no csv member"}


def test_write_keeps_tables_and_errors_apart(spark, delivery, tmp_path):
    delivery.write(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/TAB_A").count() == 3
    assert spark.read.parquet(f"{tmp_path}/errors").count() == 2


def test_one_table_reads_no_other_archive(spark, tmp_path):
    """Another table's archives are larger than Spark can hold, so that reading one would end the load."""
    day = tmp_path / "20250101"
    day.mkdir()
    (day / "TAB_A_20250101_K_1.csv.zip").write_bytes(packed(a__csv=b"k\n1\n"))
    (day / "TAB_AB_20250101_K_1.csv.zip").write_bytes(packed(a__csv=b"other\n1\n"))
    with (day / "TAB_B_20250101_K_1.csv.zip").open("wb") as f:
        f.truncate(2**31 + 5)  # no blocks are written
    one = ar.Delivery.of_folder(spark, str(tmp_path), tables=["TAB_A"])
    assert one.columns == {"TAB_A": ["k"]} and one.table("TAB_A").count() == 1
    assert one.lines.select("path").distinct().count() == 1 and one.problems().count() == 0
    every = ar.Delivery.of_folder(spark, str(tmp_path))
    assert sorted(every.columns) == ["TAB_A", "TAB_AB"]
    assert [r["problem"] for r in every.problems().collect()] == [f"too large: {2**31 + 5} bytes"]
    none = ar.Delivery.of_folder(spark, str(tmp_path), tables=["TAB_X"])
    assert none.columns == {} and none.quarantine().count() == 0


def test_replaced_archives_are_not_read(spark, root):
    delivery = ar.Delivery.of_folder(spark, root)
    assert [tuple(r) for r in delivery.table("TAB_B").select("k", "v").collect()] == [("1", "Köln")]
    paths = {r["path"] for r in delivery.lines.select("path").distinct().collect()}
    assert not any("20250101/TAB_B" in p for p in paths) and any("20250102/TAB_B" in p for p in paths)


def test_a_later_delivery_replaces_its_own_partitions(spark, tmp_path):
    first, second, out = tmp_path / "in1/1", tmp_path / "in2/2", str(tmp_path / "out")
    for folder in (first, second):
        folder.mkdir(parents=True)
    name = "TAB_A_20250101_K_%d.csv.zip"
    (first / (name % 1)).write_bytes(packed(a__csv=b"k;v\n1;a\n2;b\n3\n"))
    (first / (name % 2)).write_bytes(packed(a__csv=b"k;v\n4;c\n"))
    (first / (name % 3)).write_bytes(packed(a__csv=b"k;v\n5;d\n"))
    (second / (name % 1)).write_bytes(packed(a__csv=b"k;w\n1;new\n"))  # its ragged line is gone
    (second / (name % 2)).write_bytes(packed(a__csv=b"k;v\n4;c;x\n"))  # only a ragged line is left

    def rows():
        table = spark.read.option("mergeSchema", "true").parquet(f"{out}/TAB_A")
        found = sorted((r["base"][-1], r["k"], r["v"], r.asDict().get("w")) for r in table.collect())
        return found, sorted((r["base"][-1], r["line"]) for r in spark.read.parquet(f"{out}/errors").collect())

    ar.Delivery.of_folder(spark, str(tmp_path / "in1")).write(out)
    before = ([("1", "1", "a", None), ("1", "2", "b", None), ("2", "4", "c", None), ("3", "5", "d", None)], [("1", "3")])
    assert rows() == before
    ar.Delivery.of_folder(spark, str(tmp_path / "in1")).write(out)
    assert rows() == before
    kept = sorted((tmp_path / "out/TAB_A").glob("base=*_3/*.parquet"))
    for _ in range(2):
        ar.Delivery.of_folder(spark, str(tmp_path / "in2")).write(out)
        assert rows() == ([("1", "1", None, "new"), ("3", "5", "d", None)], [("2", "4;c;x")])
    assert sorted((tmp_path / "out/TAB_A").glob("base=*_3/*.parquet")) == kept


def test_names(spark):
    names = [
        ("d/DEPOT_ENERBIL5_20250516_K_20250716110858726.csv.ZIP", "DEPOT_ENERBIL5", dt.date(2025, 5, 16), "K",
         dt.datetime(2025, 7, 16, 11, 8, 58, 726000), "DEPOT_ENERBIL5_20250516_K_20250716110858726"),
        ("PLA_BPKD_20250516_2_20250515174420841.csv.ZIP", "PLA_BPKD", dt.date(2025, 5, 16), "2",
         dt.datetime(2025, 5, 15, 17, 44, 20, 841000), "PLA_BPKD_20250516_2_20250515174420841"),
        ("RBES_PARAMTECHZAS_20251214__20240612194246664.csv.zip", "RBES_PARAMTECHZAS", dt.date(2025, 12, 14), "",
         dt.datetime(2024, 6, 12, 19, 42, 46, 664000), "RBES_PARAMTECHZAS_20251214__20240612194246664"),
        ("nodate.csv.zip", None, None, None, None, "nodate"),
        ("BAD_99999999_K_1.csv.zip", "BAD", None, None, None, "BAD_99999999_K_1"),
    ]
    df = spark.createDataFrame([(n[0],) for n in names], "p string")
    p = F.col("p")
    got = df.select(
        "p", archive_table(p), business_date(p), delivery_flag(p), version_time(p).cast("timestamp_ntz"), archive_base(p)
    ).collect()
    assert sorted(map(tuple, got), key=str) == sorted(names, key=str)
