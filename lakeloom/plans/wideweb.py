"""Single-table queries in the manner of web-log benchmarks, over `events`, `documents` and `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query


def prop_k():
    return F.get_json_object("props", "$.k").cast("bigint")


@query("cb_q1", "SELECT count(*) AS n FROM events")
def cb_q1(t):
    return t.events.agg(F.count(F.lit(1)).alias("n"))


@query("cb_q2", "SELECT count(*) AS n FROM events WHERE event_type <> 'view' AND value > 10")
def cb_q2(t):
    return t.events.filter((F.col("event_type") != "view") & (F.col("value") > 10)).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("cb_q5", """
SELECT user_id, event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY ALL
""")
def cb_q5(t):
    return t.events.groupBy("user_id", "event_type").agg(
        F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n")
    )


@query("cb_q10", "SELECT count(DISTINCT url) AS urls FROM pages")
def cb_q10(t):
    return t.pages.agg(F.countDistinct("url").alias("urls"))


@query("cb_q15", "SELECT lang, count(*) AS n FROM documents WHERE text LIKE '%tion%' GROUP BY lang")
def cb_q15(t):
    return t.documents.filter(F.col("text").like("%tion%")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("cb_q20", """
SELECT user_id, event_type, CAST(hour(ts) AS BIGINT) AS at_hour, CAST(day(ts) AS BIGINT) AS at_day,
  CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY ALL ORDER BY n DESC, total DESC, user_id, event_type, at_hour, at_day, k LIMIT 10
""")
def cb_q20(t):
    keys = [
        "user_id",
        "event_type",
        F.hour("ts").cast("bigint").alias("at_hour"),
        F.dayofmonth("ts").cast("bigint").alias("at_day"),
        prop_k().alias("k"),
    ]
    return (
        t.events.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .orderBy(F.col("n").desc(), F.col("total").desc(), "user_id", "event_type", "at_hour", "at_day", "k")
        .limit(10)
    )


@query("cb_q30", """
SELECT event_type, count(*) AS n, round(sum(value), 4) AS sum_value, round(avg(value), 6) AS avg_value,
  min(value) AS min_value, max(value) AS max_value, round(avg(user_id), 6) AS avg_user,
  min(ts) AS first_ts, max(ts) AS last_ts, sum(length(props)) :: BIGINT AS props_chars
FROM events WHERE value BETWEEN 5 AND 200 GROUP BY event_type
""")
def cb_q30(t):
    return (
        t.events.filter(F.col("value").between(5, 200))
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("value"), 4).alias("sum_value"),
            F.round(F.avg("value"), 6).alias("avg_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.round(F.avg("user_id"), 6).alias("avg_user"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.sum(F.length("props")).alias("props_chars"),
        )
    )


@query("cb_q35", """
SELECT host, count(*) AS n FROM (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
GROUP BY host HAVING count(*) > 1
""")
def cb_q35(t):
    return (
        t.pages.groupBy(F.parse_url("url", F.lit("HOST")).alias("host"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
