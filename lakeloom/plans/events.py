"""Event rules, batching, windows and bursts over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..operators.bounded import spread
from ..operators.bursts import burst_match
from ..operators.events import (
    NotificationRule, Trigger, batch_files, batch_files_by_size, batch_totals, fan_out, match_notifications, route, sessionize,
)
from ..operators.ranges import interval_join
from ..operators.stats import (
    changelog_table, latency_rollup, leaderboard, mark_late,
)
from ..sources.messages import explode_notifications, parse_json, parse_requests
from .registry import query


def prop_k():
    return F.get_json_object("props", "$.k").cast("bigint")


# Object notifications made of the events: one message per event with one or two records.
NOTIFICATION_SQL = """
SELECT event_id, CASE event_type WHEN 'error' THEN 'ObjectRemoved:Delete' WHEN 'signup' THEN 'ObjectCreated:Copy'
    ELSE 'ObjectCreated:Put' END AS event_name,
  'landing' AS bucket, event_type || '/' || user_id || '/' || event_id || CASE WHEN event_id % 3 = 0 THEN '.csv' ELSE '.parquet' END AS key,
  CAST(props->>'$.k' AS BIGINT) * 1000 AS size, 'team' || (user_id % 3) AS team
FROM events
"""


def notification_messages(t):
    """Notification JSON per event, as an object store would send it."""
    name = (
        F.when(F.col("event_type") == "error", "ObjectRemoved:Delete")
        .when(F.col("event_type") == "signup", "ObjectCreated:Copy")
        .otherwise("ObjectCreated:Put")
    )
    ending = F.when(F.col("event_id") % 3 == 0, ".csv").otherwise(".parquet")
    key = F.concat(F.concat_ws("/", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")), ending)
    record = F.struct(
        name.alias("eventName"),
        F.struct(
            F.struct(F.lit("landing").alias("name")).alias("bucket"),
            F.struct(
                key.alias("key"),
                (prop_k() * 1000).alias("size"),
                F.create_map(F.lit("team"), F.concat(F.lit("team"), (F.col("user_id") % 3).cast("string"))).alias("metadata"),
                F.create_map(F.lit("kind"), F.col("event_type")).alias("tags"),
            ).alias("object"),
        ).alias("s3"),
    )
    return spread(t.events).select("event_id", "ts", F.to_json(F.struct(F.array(record).alias("Records"))).alias("value"))


@query("notification_explode", NOTIFICATION_SQL)
def notification_explode(t):
    rows, _ = explode_notifications(notification_messages(t))
    return rows.select("event_id", "event_name", "bucket", "key", "size", F.col("metadata")["team"].alias("team"))


RULES = [
    NotificationRule("everything"),
    NotificationRule("new-csv", events=("ObjectCreated:*",), suffix=".csv"),
    NotificationRule("clicks", prefix="click/", regex=r"/\d+[02468]\.", tags={"kind": "click"}),
    NotificationRule("team1-removed", events=("ObjectRemoved:Delete",), metadata={"team": "team1"}),
]


@query("notification_filter", f"""
WITH o AS ({NOTIFICATION_SQL})
SELECT event_id, key, 'everything' AS rule FROM o UNION ALL
SELECT event_id, key, 'new-csv' FROM o WHERE event_name LIKE 'ObjectCreated:%' AND key LIKE '%.csv' UNION ALL
SELECT event_id, key, 'clicks' FROM o WHERE key LIKE 'click/%' AND regexp_matches(key, '/\\d+[02468]\\.') UNION ALL
SELECT event_id, key, 'team1-removed' FROM o WHERE event_name = 'ObjectRemoved:Delete' AND team = 'team1'
""")
def notification_filter(t):
    """Each object event once per rule it satisfies."""
    rows, _ = explode_notifications(notification_messages(t))
    return match_notifications(rows, RULES).select("event_id", "key", "rule")


TRIGGERS = [
    Trigger("audit"),
    Trigger("billing", type="purchase"),
    Trigger("alerts", type="error", extensions={"priority": "high"}),
    Trigger("eu-clicks", type="click", source="/shop/1"),
]


@query("trigger_fanout", """
WITH e AS (SELECT event_id, event_type AS type, '/shop/' || (user_id % 4) AS source,
  CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS priority FROM events)
SELECT event_id, type, source, 'audit' AS subscriber FROM e UNION ALL
SELECT event_id, type, source, 'billing' FROM e WHERE type = 'purchase' UNION ALL
SELECT event_id, type, source, 'alerts' FROM e WHERE type = 'error' AND priority = 'high' UNION ALL
SELECT event_id, type, source, 'eu-clicks' FROM e WHERE type = 'click' AND source = '/shop/1'
""")
def trigger_fanout(t):
    """Each event once per matching trigger."""
    return fan_out(cloud_events(t.events), TRIGGERS).select("event_id", "type", "source", "subscriber")


def cloud_events(events):
    return events.select(
        "event_id",
        F.col("event_type").alias("type"),
        F.concat(F.lit("/shop/"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.create_map(F.lit("priority"), F.when(F.col("value") > 20, "high").otherwise("low")).alias("extensions"),
    )


BATCH_SQL = """
WITH f AS (SELECT event_type AS table_name, ts, event_id, CAST(props->>'$.k' AS BIGINT) * 1000 AS size FROM events),
g AS (SELECT *, row_number() OVER w AS pos, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS opens
  FROM f WINDOW w AS (PARTITION BY table_name ORDER BY ts, event_id)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY table_name ORDER BY pos) AS run FROM g),
n AS (SELECT *, (row_number() OVER (PARTITION BY table_name, run ORDER BY pos) - 1) // 4 AS part FROM r)
SELECT table_name, min(ts) AS first_at, max(ts) AS last_at, count(*) AS file_count, sum(size) :: BIGINT AS total_bytes
FROM n GROUP BY table_name, run, part
"""


def arriving_files(events):
    return events.select(F.col("event_type").alias("table_name"), "ts", "event_id", (prop_k() * 1000).alias("size"))


@query("file_batches", BATCH_SQL)
def file_batches(t):
    """Ingest batches per table: closed at 4 files or after 10 minutes without one."""
    keys = ["table_name"]
    numbered = batch_files(arriving_files(t.events), keys, "ts", "size", ["event_id"], 4, 600)
    return batch_totals(numbered, keys, "ts", "size").drop("batch_start")


@query("file_batches_by_size", """
WITH f AS (SELECT event_type AS table_name, ts, event_id, CAST(props->>'$.k' AS BIGINT) * 1000 AS size FROM events),
g AS (SELECT *, sum(size) OVER (PARTITION BY table_name ORDER BY ts, event_id) - size AS before FROM f)
SELECT table_name, (before // 500000) :: BIGINT AS batch_no, count(*) AS file_count, sum(size) :: BIGINT AS total_bytes
FROM g GROUP BY ALL
""")
def file_batches_by_size_events(t):
    """The other closing rule: by accumulated size."""
    numbered = batch_files_by_size(arriving_files(t.events), ["table_name"], "ts", "size", ["event_id"], 500_000)
    return numbered.groupBy("table_name", "batch_no").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes")
    )


@query("ingest_route", f"""
SELECT table_name, first_at, file_count, total_bytes,
  CASE WHEN total_bytes < 150000 AND file_count <= 3 THEN 'light' ELSE 'heavy' END AS route FROM ({BATCH_SQL})
""")
def ingest_route(t):
    """Batches routed by bytes and number of files."""
    keys = ["table_name"]
    numbered = batch_files(arriving_files(t.events), keys, "ts", "size", ["event_id"], 4, 600)
    totals = batch_totals(numbered, keys, "ts", "size")
    return route(totals, 150_000, 3).select("table_name", "first_at", "file_count", "total_bytes", "route")


@query("dead_letter", """
SELECT 'good' AS part, count(*) AS n, sum(event_id) :: BIGINT AS ids FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'dead', count(*), sum(event_id) :: BIGINT FROM events WHERE event_type = 'error'
""")
def dead_letter(t):
    """Messages that are not JSON go to the dead letters."""
    value = F.when(F.col("event_type") == "error", F.concat(F.lit("oops "), "props")).otherwise(F.col("props"))
    good, dead = parse_json(t.events.select("event_id", value.alias("value")), "k bigint")
    tell = lambda df, part: df.agg(
        F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )
    return tell(good, "good").unionByName(tell(dead, "dead"))


@query("ingest_request", """
SELECT CASE WHEN event_type = 'view' THEN 'db.my_table' ELSE 'db.' || event_type END AS "table",
  's3://landing/' || user_id || '/' || event_id || '-' || part || '.parquet' AS file
FROM events, (SELECT unnest([0, 1]) AS part) WHERE event_type <> 'error'
""")
def ingest_request(t):
    """Requests with a list of files; no table means the default one, no files means incomplete."""
    stem = F.concat(F.lit("s3://landing/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"))
    files = F.array(F.concat(stem, F.lit("-0.parquet")), F.concat(stem, F.lit("-1.parquet")))
    request = F.struct(
        F.when(F.col("event_type") != "error", files).alias("files"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("db."), "event_type")).alias("table"),
        prop_k().alias("total_bytes"),
    )
    wanted, _, _ = parse_requests(t.events.select(F.to_json(request).alias("value")))
    return wanted


@query("interval_join_left", """
SELECT o.event_id AS order_id, o.user_id, o.ts AS order_time, p.event_id AS payment_id, p.ts AS payment_time
FROM events o LEFT JOIN events p ON p.event_type = 'click' AND p.user_id = o.user_id
  AND p.ts >= o.ts AND p.ts <= o.ts + INTERVAL 1 HOUR
WHERE o.event_type = 'purchase'
""")
def interval_join_left(t):
    """Purchases with the clicks of the same user within the next hour."""
    orders, payments = orders_and_payments(t.events)
    return interval_join(orders, payments, "user_id", "payer", "order_time", "payment_time", 3600).drop("payer")


def orders_and_payments(events):
    kind = lambda k: events.filter(F.col("event_type") == k)
    orders = kind("purchase").select(F.col("event_id").alias("order_id"), "user_id", F.col("ts").alias("order_time"))
    payments = kind("click").select(
        F.col("event_id").alias("payment_id"), F.col("user_id").alias("payer"), F.col("ts").alias("payment_time")
    )
    return orders, payments


@query("leaderboard", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY at_day ORDER BY score DESC, user_id) AS place FROM (
  SELECT date_trunc('day', ts) :: TIMESTAMP AS at_day, user_id, round(sum(value), 4) AS score FROM events GROUP BY ALL))
WHERE place <= 3
""")
def leaderboard_daily(t):
    daily = t.events.withColumn("at_day", ntz(F.date_trunc("day", "ts")))
    best = leaderboard(daily, "at_day", "user_id", F.round(F.sum("value"), 4), 3)
    return best.withColumn("place", F.col("place").cast("bigint"))


@query("latency_rollup", """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50,
  quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99,
  round(avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END), 6) AS error_rate, round(count(*) / 86400, 8) AS per_second,
  quantile_disc(value, 0.99) > 100 AS alert
FROM (SELECT ts, event_type, CASE WHEN event_type = 'error' OR event_id % 50 = 0 THEN NULL ELSE value END AS value FROM events)
GROUP BY ALL
""")
def latency_rollup_events(t):
    """Events as a request log: type is the endpoint, value the latency; some requests have none, one endpoint never has."""
    lost = (F.col("event_type") == "error") | (F.col("event_id") % 50 == 0)
    log = t.events.select("ts", "event_type", F.when(~lost, F.col("value")).alias("value"))
    rolled = latency_rollup(
        log, ["event_type"], "ts", "value", F.col("value") > 60, "1 day", 86400, alert_above=100.0
    )
    return (
        rolled.withColumn("window_start", ntz("window_start"))
        .withColumn("error_rate", F.round("error_rate", 6))
        .withColumn("per_second", F.round("per_second", 8))
    )


LATE_SQL = """
WITH a AS (SELECT *, date_trunc('day', ts + CASE WHEN CAST(props->>'$.k' AS INT) >= 90 THEN INTERVAL 60 HOUR ELSE INTERVAL 0 HOUR END) AS batch FROM events),
p AS (SELECT batch, max(ts) AS peak FROM a GROUP BY batch),
l AS (SELECT batch, max(peak) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS lim FROM p)
SELECT event_id, a.ts, coalesce(a.ts < l.lim, false) AS late FROM a JOIN l USING (batch)
"""


@query("late_rows", LATE_SQL)
def late_rows(t):
    """Rows that arrive after the watermark of earlier arrivals has passed them."""
    held = F.when(prop_k() >= 90, F.expr("INTERVAL 60 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    arrived = t.events.withColumn("batch", ntz(F.date_trunc("day", F.col("ts") + held)))
    return mark_late(arrived, "batch", "ts", "1 HOUR").select("event_id", "ts", "late")


CHANGELOG_SQL = """
SELECT user_id, value FROM (
  SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN -1 ELSE value END, ts) AS value FROM events GROUP BY user_id)
WHERE value >= 0
"""


def changes(events):
    """Value per user; an error event deletes the user's entry."""
    return events.select(
        "user_id", "ts", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )


@query("changelog_latest", CHANGELOG_SQL)
def changelog_latest(t):
    return changelog_table(changes(t.events), ["user_id"], "value", ["ts", "event_id"]).select("user_id", "value")


BURST_SQL = """
WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
o AS (SELECT a.user_id, a.pos, a.ts AS first_at, max(b.pos) AS stop, max(b.ts) AS last_at
  FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos >= a.pos AND b.ts < a.ts + INTERVAL 12 HOUR GROUP BY ALL
  HAVING max(b.pos) - a.pos + 1 >= 3),
s AS (SELECT *, (SELECT min(n.pos) FROM o n WHERE n.user_id = o.user_id AND n.pos > o.stop) AS next FROM o),
m AS (SELECT s.* FROM s JOIN (SELECT user_id, min(pos) AS pos FROM o GROUP BY user_id) f USING (user_id, pos)
  UNION ALL SELECT s.* FROM s JOIN m ON s.user_id = m.user_id AND s.pos = m.next)
SELECT user_id, first_at, last_at, stop - pos + 1 AS n FROM m
"""


@query("burst_match", BURST_SQL)
def burst_match_events(t):
    """At least three events of a user within twelve hours."""
    return burst_match(t.events, ["user_id"], "ts", ["event_id"], 3, 12 * 3600)


# ---- batch forms of the stream windows

@query("tumbling_window", """
SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end,
  count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def tumbling_window(t):
    """Events per minute and user."""
    grouped = t.events.groupBy("user_id", F.window("ts", "1 minute").alias("w"))
    return _window_rows(grouped, "user_id")


def _window_rows(grouped, *keys):
    totals = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return totals.select(
        *keys, ntz("w.start").alias("window_start"), ntz("w.end").alias("window_end"), "n", "total"
    )


@query("sliding_window", """
SELECT event_type, s AS window_start, s + INTERVAL 60 MINUTE AS window_end, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 20 MINUTE, ts), time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 20 MINUTE,
  time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 40 MINUTE]) AS s FROM events) GROUP BY ALL
""")
def sliding_window(t):
    """Hourly windows every twenty minutes."""
    grouped = t.events.groupBy("event_type", F.window("ts", "60 minutes", "20 minutes").alias("w"))
    return _window_rows(grouped, "event_type")


SESSION_SQL = """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS total
FROM s GROUP BY user_id, no
"""


@query("session_window", SESSION_SQL)
def session_window(t):
    """Sessions of a user that end after two quiet hours."""
    totals = [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")]
    return sessionize(t.events, ["user_id"], "ts", ["event_id"], 7200, totals)


@query("session_window_builtin", SESSION_SQL)
def session_window_builtin(t):
    """The same by Spark's session window."""
    return _window_rows(t.events.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")), "user_id")


@query("topic_minute_stats", """
SELECT event_type AS topic, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total,
  round(avg(value), 4) AS mean FROM events GROUP BY ALL
""")
def topic_minute_stats(t):
    """Count, sum and mean per topic and minute, by message time."""
    grouped = t.events.groupBy(F.col("event_type").alias("topic"), F.window("ts", "1 minute").alias("w"))
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 4).alias("total"),
        F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean"),
    ).select("topic", ntz("w.start").alias("window_start"), "n", "total", "mean")


@query("recent_windows", """
WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT max(ts) AS now FROM events)
SELECT w.* FROM w, m WHERE window_start >= now - INTERVAL 1 DAY AND window_start <= now
""")
def recent_windows(t):
    """Stored windows that start within the last day of the data."""
    windows = tumbling_window(t).select("user_id", "window_start", "n")
    now = t.events.agg(F.max("ts")).first()[0]
    return windows.filter(
        F.col("window_start").between(F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY"), F.lit(now).cast("timestamp_ntz"))
    )


DEDUP_SQL = "SELECT event_id, user_id, ts, event_type FROM events"


def replayed(events):
    """Every purchase and error comes twice, as after a redelivery."""
    rows = events.select("event_id", "user_id", "ts", "event_type")
    times = F.when(F.col("event_type").isin("purchase", "error"), 2).otherwise(1)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")


@query("dedup_events", DEDUP_SQL)
def dedup_events(t):
    return replayed(t.events).dropDuplicates(["event_id"])
