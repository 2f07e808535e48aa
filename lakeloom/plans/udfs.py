"""User-defined function surfaces. Groups handed to Python are bounded by construction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window, functions as F, types as T

from .registry import query

CHUNK = 1000


def make_scale(factor: float):
    """A plain UDF with its factor fixed when it is made."""

    def scale(x):
        return None if x is None else x * factor

    return F.udf(scale, "double")


@query("udf_scalar", "SELECT event_id, value * 2.5 AS scaled FROM events")
def udf_scalar(t):
    """Row-at-a-time Python function."""
    return t.events.select("event_id", make_scale(2.5)("value").alias("scaled"))


@F.pandas_udf(T.DoubleType())
def halved(x: pd.Series) -> pd.Series:
    return x / 2


@query("udf_pandas", "SELECT event_id, value / 2 AS half FROM events")
def udf_pandas(t):
    """Vectorised function over Arrow batches."""
    return t.events.select("event_id", halved("value").alias("half"))


@query("udf_map_batches", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def udf_map_batches(t):
    """Partial sums per Arrow batch in Python, merged by Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby("event_type")["value"].agg(["size", "sum"]).reset_index()

    sums = t.events.select("event_type", "value").mapInPandas(partial, "event_type string, size bigint, sum double")
    return sums.groupBy("event_type").agg(F.sum("size").alias("n"), F.round(F.sum("sum"), 4).alias("total"))


@query("udf_grouped_map", """
SELECT event_id, rank() OVER (PARTITION BY event_type, event_id // 1000 ORDER BY value DESC) AS place FROM events
""")
def udf_grouped_map(t):
    """Rank within event type and thousand of ids: a group never exceeds a thousand rows."""

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(place=pdf["value"].rank(method="min", ascending=False).astype("int64"))[["event_id", "place"]]

    chunk = F.floor(F.col("event_id") / CHUNK).alias("chunk")
    rows = t.events.select("event_id", "event_type", "value", chunk)
    return rows.groupBy("event_type", "chunk").applyInPandas(rank, "event_id bigint, place bigint")


@F.pandas_udf(T.DoubleType())
def spread(x: pd.Series) -> float:
    return float(x.max() - x.min())


@query("udaf_pandas", """
SELECT event_type, max(w) AS widest, count(*) AS chunks FROM (
  SELECT event_type, max(value) - min(value) AS w FROM events GROUP BY event_type, event_id // 1000) GROUP BY event_type
""")
def udaf_pandas(t):
    """Python aggregate per bounded chunk, combined by a built-in one."""
    chunk = F.floor(F.col("event_id") / CHUNK).alias("chunk")
    per_chunk = t.events.groupBy("event_type", chunk).agg(spread("value").alias("w"))
    return per_chunk.groupBy("event_type").agg(F.max("w").alias("widest"), F.count(F.lit(1)).alias("chunks"))


@F.pandas_udf(T.DoubleType())
def mean_of(x: pd.Series) -> float:
    return float(x.mean())


@query("udf_window_pandas", """
SELECT event_id, round(avg(value) OVER (PARTITION BY event_type, event_id // 1000 ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS smooth
FROM events
""")
def udf_window_pandas(t):
    """Python aggregate over a sliding frame of four rows."""
    chunk = F.floor(F.col("event_id") / CHUNK)
    w = Window.partitionBy("event_type", "chunk").orderBy("event_id").rowsBetween(-3, 0)
    rows = t.events.withColumn("chunk", chunk)
    return rows.select("event_id", F.round(mean_of("value").over(w), 6).alias("smooth"))


@query("udtf_split", """
SELECT part, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS part FROM part) GROUP BY part
""")
def udtf_split(t):
    """Python table function, joined laterally."""

    class Words:
        def eval(self, text: str):
            for word in (text or "").split(" "):
                yield (word,)

    words = F.udtf(Words, returnType="part string")
    t.spark.udtf.register("split_words", words)
    t.part.createOrReplaceTempView("udtf_parts")
    return t.spark.sql("""
        SELECT w.part, count(*) AS n FROM udtf_parts, LATERAL split_words(p_name) w GROUP BY w.part""")
