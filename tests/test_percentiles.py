"""Percentiles by selection give what sorting a whole key gives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators.stats import percentiles

POINTS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def brute(rows):
    by = {}
    for key, value in rows:
        if value is not None:
            by.setdefault(key, []).append(value)
    out = {}
    for key, values in by.items():
        values.sort(key=lambda v: (math.isnan(v), v))
        out[key] = (len(values), *(values[max(1, math.ceil(p * len(values))) - 1] for p in POINTS.values()))
    return out


def result(df):
    return {r["key"]: tuple(r[c] for c in ("n", *POINTS)) for r in df.collect()}


@pytest.mark.parametrize(("most", "cells"), [(10**6, 4096), (40, 4096), (60, 64)])
def test_like_brute_force(spark, most, cells):
    rnd = random.Random(5)
    draw = [lambda: rnd.random(), lambda: rnd.expovariate(1), lambda: float(rnd.randrange(5)), lambda: 10.0 ** rnd.uniform(-300, 300) * rnd.choice([-1, 1])]
    rows = [(k, None if rnd.random() < 0.1 else draw[k % 4]()) for k in (1, 2, 3, 0) for _ in range(400)]
    rows += [(None, float(i)) for i in range(300)] + [(9, None)] + [(10, 5.0)] * 200
    rows += [(11, v) for v in [math.inf] * 60 + [-math.inf] * 60 + [1.0, 2.0, 3.0] * 20]
    got = result(percentiles(spark.createDataFrame(rows, "key int, value double").repartition(4), ["key"], "value", POINTS, most, cells))
    assert got == brute(rows)


def test_nan_is_the_largest_and_long_numbers_stay_exact(spark):
    rows = [(1, v) for v in [float("nan")] * 30 + [float(i) for i in range(70)]]
    got = percentiles(spark.createDataFrame(rows, "key int, value double"), ["key"], "value", {"a": 0.7, "b": 0.71}, 10, 64).first()
    assert got["a"] == 69.0 and math.isnan(got["b"])
    near = spark.range(200).select(F.lit(1).alias("key"), (F.col("id") + (1 << 60)).alias("value"))
    got = percentiles(near, ["key"], "value", {"a": 0.5, "b": 1.0}, 10, 64).first()
    assert (got["a"], got["b"]) == ((1 << 60) + 99, (1 << 60) + 199)


def test_a_hot_key_is_not_sorted_by_one_task(spark):
    """Of a key with nine tenths of the rows no more than its cells reach one task."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("key"), F.rand(3).alias("value"))
    found = percentiles(rows, ["key"], "value", {"p50": 0.5}, 1000, 64)
    want = rows.filter("key = 1").select("value").orderBy("value").limit(18_000).agg(F.max("value")).first()[0]
    assert found.filter("key = 1").first()["p50"] == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile-rows" in plan
    paths = [line.split("[")[-1] for line in plan.splitlines() if "percentile-rows" in line]
    assert paths and spark.read.parquet(next(p for p in found.inputFiles() if "percentile-rows" in p).rpartition("/")[0]).count() <= 1000
