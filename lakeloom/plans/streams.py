"""Structured Streaming jobs run over everything available, compared with their batch forms.

A stream emits a window or an unmatched row only once the watermark has passed it; the
SQL states the same limit with the latest time of the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..operators.bounded import broadcast_if_small
from ..operators.events import fan_out
from ..operators.stats import latest_by_key
from ..session import new_path
from ..sinks.messages import as_messages, read_messages, send_messages
from ..sinks.tables import read_table
from ..sources.messages import parse_json
from ..streaming import carry, jobs, state
from ..streaming.run import each_batch, stream_table, to_table, write_in_time
from .events import (
    BATCH_SQL, BURST_SQL, CHANGELOG_SQL, DEDUP_SQL, SESSION_SQL, TRIGGERS, arriving_files, changes, cloud_events,
    orders_and_payments, replayed,
)
from .registry import query


def event_stream(t):
    """`events` as a stream; event time with zone, as watermarks need it."""
    return stream_table(t.spark, t.path("events")).withColumn("ts", F.col("ts").cast("timestamp"))


def totals():
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")]


def flat_times(df):
    return df.withColumn("window_start", ntz("window_start")).withColumn("window_end", ntz("window_end"))


@query("stream_parse_json", """
SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, 'parsed' AS part FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, NULL, 'dead' FROM events WHERE event_type = 'error'
""")
def stream_parse_json(t):
    """JSON messages of a stream parsed; what is not JSON is written to the dead letters."""
    value = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.col("props"))
    messages = event_stream(t).select("event_id", value.alias("value"))

    def write(batch, batch_id, out):
        good, dead = parse_json(batch, "k bigint")
        good.write.mode("overwrite").parquet(f"{out}/parsed/batch={batch_id}")
        dead.write.mode("overwrite").parquet(f"{out}/dead/batch={batch_id}")

    out = each_batch(messages, "messages", write)
    parsed = read_table(t.spark, f"{out}/parsed").select("event_id", "k", F.lit("parsed").alias("part"))
    dead = read_table(t.spark, f"{out}/dead")
    return parsed.unionByName(dead.select("event_id", F.lit(None).cast("bigint").alias("k"), F.lit("dead").alias("part")))


@query("stream_tumbling_window", """
WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total
  FROM events GROUP BY ALL)
SELECT *, window_start + INTERVAL 1 MINUTE AS window_end FROM w
WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 SECOND
""")
def stream_tumbling_window(t):
    windows = jobs.tumbling_window(event_stream(t), "ts", ["user_id"], "1 minute", totals(), "10 seconds")
    return flat_times(to_table(windows, "tumbling"))


@query("stream_sliding_window", """
WITH w AS (SELECT event_type, s AS window_start, count(*) AS n, round(sum(value), 4) AS total
  FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 20 MINUTE, ts), time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 20 MINUTE,
    time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 40 MINUTE]) AS s FROM events) GROUP BY ALL)
SELECT *, window_start + INTERVAL 60 MINUTE AS window_end FROM w
WHERE window_start + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 SECOND
""")
def stream_sliding_window(t):
    windows = jobs.sliding_window(
        event_stream(t), "ts", ["event_type"], "60 minutes", "20 minutes", totals(), "10 seconds"
    )
    return flat_times(to_table(windows, "sliding"))


@query("stream_session_window", f"""
SELECT * FROM ({SESSION_SQL}) WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 SECOND
""")
def stream_session_window(t):
    sessions = jobs.session_window(event_stream(t), "ts", ["user_id"], "2 hours", totals(), "10 seconds")
    return flat_times(to_table(sessions, "sessions"))


@query("stream_interval_join", """
WITH w AS (SELECT least(max(ts) FILTER (WHERE event_type = 'purchase') - INTERVAL 10 MINUTE,
  max(ts) FILTER (WHERE event_type = 'click') - INTERVAL 30 MINUTE) AS mark FROM events)
SELECT o.event_id AS order_id, o.user_id, o.ts AS order_time, p.event_id AS payment_id, p.ts AS payment_time
FROM events o LEFT JOIN events p ON p.event_type = 'click' AND p.user_id = o.user_id
  AND p.ts >= o.ts AND p.ts <= o.ts + INTERVAL 1 HOUR, w
WHERE o.event_type = 'purchase' AND (p.event_id IS NOT NULL OR o.ts + INTERVAL 1 HOUR <= mark)
""")
def stream_interval_join(t):
    """Orders with their payments within the hour; unmatched ones once the watermark has passed."""
    orders, _ = orders_and_payments(event_stream(t))
    _, payments = orders_and_payments(event_stream(t))
    joined = jobs.interval_join(
        orders, payments, "user_id", "payer", "order_time", "payment_time", "1 HOUR", "10 minutes", "30 minutes"
    )
    rows = to_table(joined.drop("payer"), "interval-join")
    return rows.withColumn("order_time", ntz("order_time")).withColumn("payment_time", ntz("payment_time"))


@query("stream_enrich", """
SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey
""")
def stream_enrich(t):
    """Stream joined with a measured-small static table: stateless."""
    nations = broadcast_if_small(t.nation.select("n_nationkey", "n_name"))
    joined = event_stream(t).join(nations, F.col("user_id") % 25 == F.col("n_nationkey"))
    return to_table(joined.select("event_id", "n_name"), "enriched")


@query("stream_dedup_events", DEDUP_SQL)
def stream_dedup_events(t):
    rows = jobs.deduplicate(replayed(event_stream(t)), ["event_id"], "ts", "1 hour")
    return to_table(rows, "dedup").withColumn("ts", ntz("ts"))


@query("stream_trigger_fanout", """
SELECT subscriber, count(*) AS n, sum(event_id) :: BIGINT AS ids FROM (
  SELECT event_id, 'audit' AS subscriber FROM events UNION ALL
  SELECT event_id, 'billing' FROM events WHERE event_type = 'purchase' UNION ALL
  SELECT event_id, 'alerts' FROM events WHERE event_type = 'error' AND value > 20 UNION ALL
  SELECT event_id, 'eu-clicks' FROM events WHERE event_type = 'click' AND user_id % 4 = 1) GROUP BY subscriber
""")
def stream_trigger_fanout(t):
    """Events delivered to one folder per matching subscriber."""
    out = jobs.deliver(fan_out(cloud_events(event_stream(t)), TRIGGERS), "fanout")
    return read_table(t.spark, out).groupBy("subscriber").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


@query("stream_changelog", CHANGELOG_SQL)
def stream_changelog(t):
    """Latest value per user kept as state; an error event deletes it."""
    updates = state.changelog_updates(changes(event_stream(t)), "user_id", "value", "ts", "event_id")
    out = new_path(t.spark, "changelog")

    def write(batch, batch_id, folder):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    each_batch(updates, "changelog", write, "update")
    newest = latest_by_key(read_table(t.spark, out).drop("batch"), ["user_id"], ["at", "tie"])
    return newest.filter(F.col("value").isNotNull()).select("user_id", "value")


@query("order_tracker", """
SELECT user_id, count(*) AS total, count(*) AS held FROM events WHERE event_type = 'purchase' GROUP BY user_id
""")
def order_tracker(t):
    """Purchases counted per user in keyed state, next to a list that expires."""
    out = new_path(t.spark, "tracker")
    orders = event_stream(t).filter(F.col("event_type") == "purchase")
    tracked = state.track_orders(orders, "user_id", "event_id", quiet_ms=3_600_000)

    def write(batch, batch_id, folder):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    each_batch(tracked, "tracker", write, "update", idle_batches=False)
    return read_table(t.spark, out).groupBy("user_id").agg(F.max("total").alias("total"), F.max("held").alias("held"))


@query("stream_file_batches", f"""
SELECT * FROM ({BATCH_SQL}) WHERE file_count >= 4 OR last_at + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events)
""")
def stream_file_batches(t):
    """Ingest batches of a stream that are full or timed out."""
    done = carry.batch_stream(
        arriving_files(event_stream(t)), ["table_name"], "ts", "size", ["event_id"], max_files=4, timeout_seconds=600
    )
    return done.withColumn("first_at", ntz("first_at")).withColumn("last_at", ntz("last_at"))


@query("stream_burst_match", f"""
SELECT * FROM ({BURST_SQL}) WHERE first_at + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events)
""")
def stream_burst_match(t):
    """Bursts of a stream whose time span is over."""
    rows = event_stream(t).select("user_id", "ts", "event_id")
    return carry.burst_stream(rows, ["user_id"], "ts", ["event_id"], min_events=3, span_seconds=12 * 3600)


# ---- streams that take a bounded part of their input at a time

SLICES = 4


def events_in_time(t, **bound):
    """(`events` as a stream over several triggers, in time order; the seconds of a trigger)."""
    path = new_path(t.spark, "events-in-time")
    step = write_in_time(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", path, SLICES)
    return stream_table(t.spark, path, **bound), step


@query("stream_three_way_join", """
SELECT o.event_id AS order_id, o.user_id, o.ts AS order_time, p.event_id AS payment_id, p.ts AS payment_time,
  v.event_id AS view_id, v.ts AS view_time
FROM events o JOIN events p ON p.event_type = 'click' AND p.user_id = o.user_id AND p.ts BETWEEN o.ts AND o.ts + INTERVAL 12 HOUR
JOIN events v ON v.event_type = 'view' AND v.user_id = o.user_id AND v.ts BETWEEN o.ts AND o.ts + INTERVAL 6 HOUR
WHERE o.event_type = 'purchase'
""")
def stream_three_way_join(t):
    """Orders, payments and views of a user joined as three streams, a file of each per trigger."""
    events, step = events_in_time(t, maxFilesPerTrigger=1)
    orders, payments = orders_and_payments(events)
    views = events.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("view_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("view_time")
    )
    delay = f"{step} seconds"
    joined = jobs.interval_chain(orders, "user_id", "order_time", delay, [
        jobs.Leg(payments, "payer", "payment_time", "12 HOUR", delay),
        jobs.Leg(views, "viewer", "view_time", "6 HOUR", delay),
    ])
    rows = to_table(joined, "three-way-join")
    return rows.withColumns({c: ntz(c) for c in ("order_time", "payment_time", "view_time")})


@query("stream_windows_by_file", f"""
WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total
  FROM events GROUP BY ALL), s AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)
SELECT w.*, window_start + INTERVAL 1 HOUR AS window_end FROM w, s
WHERE epoch_us(window_start + INTERVAL 1 HOUR) <= hi - ceil(((hi - lo) // {SLICES} + 1) / 1e6) * 1000000
""")
def stream_windows_by_file(t):
    """Windows over a stream that reads one file per trigger."""
    events, step = events_in_time(t, maxFilesPerTrigger=1)
    return flat_times(to_table(jobs.tumbling_window(events, "ts", ["event_type"], "1 hour", totals(), f"{step} seconds"), "by-file"))


@query("stream_dedup_by_bytes", DEDUP_SQL)
def stream_dedup_by_bytes(t):
    """Replayed events dropped from a stream that reads a bounded number of bytes per trigger."""
    events, step = events_in_time(t, maxBytesPerTrigger=1 << 16)
    rows = jobs.deduplicate(replayed(events), ["event_id"], "ts", f"{step + 3600} seconds")
    return to_table(rows, "by-bytes").withColumn("ts", ntz("ts"))


@query("message_sink", """
SELECT event_type AS topic, CAST(user_id AS VARCHAR) AS key, event_id, value, 'events/' || event_type AS source
FROM events WHERE event_type IN ('purchase', 'error')
""")
def message_sink(t):
    """Events sent as JSON messages keyed by user, a topic per type; two of the topics read back."""
    events, _ = events_in_time(t, maxFilesPerTrigger=1)
    attributes = {"id": F.col("event_id"), "source": F.concat(F.lit("events/"), "event_type")}
    messages = as_messages(events, F.col("event_type"), F.col("user_id"), ["event_id", "value"], attributes)
    back = read_messages(t.spark, send_messages(messages, "message-sink"), ["purchase", "error"])
    good, _ = parse_json(back, "event_id bigint, value double")
    return good.select("topic", "key", "event_id", "value", F.col("headers")["ce_source"].alias("source"))


@query("state_readback")
def state_readback(t):
    """Open windows read from a stream's checkpoint; what is in there depends on the run."""
    windows = jobs.tumbling_window(event_stream(t), "ts", ["user_id"], "1 hour", totals(), "10 days")
    run = lambda batch, batch_id, folder: batch.write.format("noop").mode("overwrite").save()
    out = each_batch(windows, "state", run)
    stored = t.spark.read.format("statestore").load(f"{out}/checkpoint")
    return stored.select("key.user_id", ntz("key.window.start").alias("window_start"), "value.count", "partition_id")
