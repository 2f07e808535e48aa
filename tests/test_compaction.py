"""Small files of a real folder are packed by size and rewritten; nothing is lost when a run ends early."""

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import maintenance
from lakeloom.operators.maintenance import Compaction, compact_files


def sizes(folder):
    return sorted(f.stat().st_size for f in folder.glob("*.parquet"))


def wide(spark, first, last):
    return spark.range(first, last).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))


def test_small_files_are_packed_and_large_ones_stay(spark, tmp_path):
    folder = tmp_path / "table"
    wide(spark, 0, 2000).repartition(20).write.parquet(str(folder))
    wide(spark, 2000, 9000).coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame([(9000, "y", 1)], "id bigint, x string, more int").coalesce(1).write.mode("append").parquet(str(folder))
    before, target = sizes(folder), 60_000
    large = [f.name for f in folder.glob("*.parquet") if f.stat().st_size >= target]
    done = compact_files(spark, str(folder), target)
    after = sizes(folder)
    assert done == Compaction(len(before), len(after), 2001) and len(after) <= -(-sum(before[:-1]) // target) + 2 + len(large)
    assert set(large) <= {f.name for f in folder.glob("*.parquet")} and len(large) == 1
    back = spark.read.option("mergeSchema", "true").parquet(str(folder))
    assert sorted(r["id"] for r in back.select("id").collect()) == list(range(9001))
    assert back.columns == ["id", "x", "more"] and back.filter("more = 1").count() == 1
    assert back.filter("id < 9000").filter(F.col("x") != F.sha2(F.col("id").cast("string"), 256)).count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["table"]
    again = compact_files(spark, str(folder), 1)
    assert again == Compaction(len(after), len(after), 0) and sizes(folder) == after


def test_a_run_that_writes_too_few_rows_leaves_the_folder(spark, tmp_path, monkeypatch):
    folder = tmp_path / "table"
    wide(spark, 0, 100).repartition(5).write.parquet(str(folder))
    before = sorted(f.name for f in folder.iterdir())
    monkeypatch.setattr(maintenance, "broadcast_if_small", lambda df: df.limit(1))
    with pytest.raises(RuntimeError, match="as it was"):
        compact_files(spark, str(folder), 1 << 20)
    assert sorted(f.name for f in folder.iterdir()) == before and [p.name for p in tmp_path.iterdir()] == ["table"]
