"""Mapping-driven history loads and time lookups over `events`, `customer` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..functions.fixed import EXTRACT_TIME, LOAD_TIME, VALID_FROM, VALID_TO
from ..operators.history import as_of, as_of_join, current
from ..operators.lookup import Calendar, period_lookup
from ..operators.mapping import MapRow, load_rejects, load_target, project_mapping, typed_projection
from .registry import query

# The raw events as a source of user states.
STATE_MAP = [
    MapRow("events", "user_state", "user_id", "user_id", primary_key=True),
    MapRow("events", "user_state", "event_id", "event_id"),
    MapRow("events", "user_state", "event_type", "state"),
    MapRow("events", "user_state", "value", "amount", "DECIMAL", 12, 2),
    MapRow("events", "user_state", "value", "level"),
    # This row loses its target to one above; its condition holds all the same.
    MapRow("events", "user_state", "value", "state", condition="where value > 1 OR event_type = 'error'"),
]


def raw_events(t):
    return t.events.withColumn(EXTRACT_TIME, F.col("ts"))


def user_history(t):
    loaded = load_target(
        {"events": raw_events(t)}, STATE_MAP, "user_state", ties={"events": ["event_id"]}
    )
    return loaded.drop(LOAD_TIME).withColumn("amount", F.col("amount").cast("double"))


HISTORY_SQL = f"""
SELECT user_id, event_id, event_type AS state, value AS level, round(value, 2) AS amount, ts AS {EXTRACT_TIME},
  ts AS {VALID_FROM}, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS {VALID_TO}
FROM events WHERE value > 1 OR event_type = 'error'
"""


@query("scd2_history", HISTORY_SQL)
def scd2_history(t):
    """Every user state with its validity interval."""
    return user_history(t)


@query("scd2_current", f"SELECT * FROM ({HISTORY_SQL}) WHERE {VALID_TO} IS NULL")
def scd2_current(t):
    return current(user_history(t))


@query("scd2_as_of", f"""
SELECT * FROM ({HISTORY_SQL}) WHERE {VALID_FROM} <= TIMESTAMP '2024-01-15 12:00:00'
  AND ({VALID_TO} IS NULL OR {VALID_TO} > TIMESTAMP '2024-01-15 12:00:00')
""")
def scd2_as_of(t):
    return as_of(user_history(t), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


@query("mapped_projection", """
SELECT o_orderkey AS order_no, o_custkey AS customer_no, CAST(o_custkey AS VARCHAR) AS customer_code,
  o_orderstatus AS status, round(o_totalprice, 1) AS total FROM orders
""")
def mapped_projection(t):
    """One source column feeds two targets; a second row for the same target is ignored."""
    rows = [
        MapRow("orders", "order_facts", "o_orderkey", "order_no"),
        MapRow("orders", "order_facts", "o_custkey", "customer_no"),
        MapRow("orders", "order_facts", "o_orderstatus", "status", "STRING"),
        MapRow("orders", "order_facts", "o_custkey", "customer_code", "STRING"),
        MapRow("orders", "order_facts", "o_totalprice", "total", "DECIMAL", 14, 1),
        MapRow("orders", "order_facts", "o_orderpriority", "status", "STRING"),
    ]
    return project_mapping(t.orders, rows).withColumn("total", F.col("total").cast("double"))


@query("typed_projection", """
WITH src AS (SELECT event_id, CAST(value AS VARCHAR) AS amount,
  CASE WHEN event_type = 'view' THEN 'n/a' WHEN event_type = 'click' THEN '' ELSE CAST(user_id AS VARCHAR) END AS who FROM events)
SELECT 'good' AS part, count(*) AS n, sum(TRY_CAST(who AS INT)) :: BIGINT AS who,
  round(sum(TRY_CAST(amount AS DECIMAL(9,3)) :: DOUBLE), 4) AS amount FROM src WHERE who <> 'n/a'
UNION ALL SELECT 'rejected', count(*), NULL, round(sum(CAST(amount AS DOUBLE)), 4) FROM src WHERE who = 'n/a'
""")
def typed_projection_events(t):
    """All-text rows cast by the mapping; rows with an unreadable value are set apart."""
    text = t.events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("value").cast("string").alias("amount"),
        F.when(F.col("event_type") == "view", F.lit("n/a"))
        .when(F.col("event_type") == "click", F.lit(""))
        .otherwise(F.col("user_id").cast("string"))
        .alias("who"),
    )
    rows = [
        MapRow("t", "t", "id", "event_id", "BIGINT"),
        MapRow("t", "t", "amount", "amount", "DECIMAL", 9, 3),
        MapRow("t", "t", "who", "who", "INT"),
    ]
    good, rejected = typed_projection(text, rows)
    n = F.count(F.lit(1)).alias("n")
    total = F.round(F.sum(F.col("amount").cast("double")), 4).alias("amount")
    return good.agg(F.lit("good").alias("part"), n, F.sum("who").cast("bigint").alias("who"), total).unionByName(
        rejected.agg(F.lit("rejected").alias("part"), n, F.lit(None).cast("bigint").alias("who"), total)
    )


@query("multi_source_load", f"""
SELECT c_custkey AS party_id, c_name AS party_name, c_mktsegment AS segment, TIMESTAMP '2024-01-01' AS {EXTRACT_TIME},
  TIMESTAMP '2024-01-01' AS {VALID_FROM}, NULL :: TIMESTAMP AS {VALID_TO} FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01', NULL FROM supplier
""")
def multi_source_load(t):
    """Two sources into one target: absent columns are NULL, history stays within a source."""
    mapping = [
        MapRow("customer", "party", "c_custkey", "party_id", primary_key=True),
        MapRow("customer", "party", "c_name", "party_name"),
        MapRow("customer", "party", "c_mktsegment", "segment"),
        MapRow("supplier", "party", "s_suppkey", "party_id"),
        MapRow("supplier", "party", "s_name", "party_name"),
        MapRow("supplier", "party", "s_suppkey", "party_id", primary_key=True),
    ]
    when = F.lit("2024-01-01").cast("timestamp_ntz")
    sources = {name: getattr(t, name).withColumn(EXTRACT_TIME, when) for name in ("customer", "supplier")}
    return load_target(sources, mapping, "party").drop(LOAD_TIME)


@query("load_rejects", """
SELECT 'events' AS source_table, 'who' AS broken, count(*) AS n, sum(event_id) :: BIGINT AS ids FROM events WHERE event_type = 'view' AND value > 1
UNION ALL SELECT 'loaded', NULL, count(*), sum(event_id) :: BIGINT FROM events WHERE event_type <> 'view' AND value > 1
""")
def load_rejects_events(t):
    """Rows a load leaves out since a text does not fit its type, next to what it loads."""
    who = F.when(F.col("event_type") == "view", F.lit("n/a")).when(F.col("event_type") == "click", F.lit(""))
    source = raw_events(t).select(
        "event_id", EXTRACT_TIME, "value", who.otherwise(F.col("user_id").cast("string")).alias("who")
    )
    mapping = [
        MapRow("events", "people", "event_id", "event_id", primary_key=True),
        MapRow("events", "people", "who", "who", "INT"),
        MapRow("events", "people", "value", "who", condition="value > 1"),
    ]
    n = F.count(F.lit(1)).alias("n")
    bad = load_rejects({"events": source}, mapping, "people").groupBy("source_table", F.array_join("broken", ",").alias("broken"))
    loaded = load_target({"events": source}, mapping, "people")
    return bad.agg(n, F.sum(F.get_json_object("row", "$.event_id").cast("bigint")).alias("ids")).unionByName(
        loaded.agg(F.lit("loaded").alias("source_table"), F.lit(None).cast("string").alias("broken"), n, F.sum("event_id").alias("ids"))
    )


def calendar(spark) -> Calendar:
    """Days of 2024 and their periods: weekdays of kind R, weekends of kind W, three grains."""
    days = spark.sql("""
        SELECT d AS doba_utc, CASE WHEN weekday(d) >= 5 THEN 'W' ELSE 'R' END AS typ_doby_kod
        FROM (SELECT explode(sequence(DATE'2024-01-01', DATE'2024-12-31')) AS d)""")
    periods = spark.sql("""
        SELECT concat_ws('-', kind, grain, hm) AS id, hm AS czas_do_utc, kind AS typ_doby_kod,
          grain AS ziarno_czasu_kod, market AS okres_rb_kod, int(minute >= 1380) AS zmiana_doby_lokalnej
        FROM (SELECT kind, grain, market, minute,
                     format_string('%02d:%02d', minute div 60, minute % 60) AS hm
              FROM (SELECT explode(array('R', 'W')) AS kind)
              LATERAL VIEW inline(array(struct('PT5M', 'OPCR', 5), struct('PT15M', 'OREB', 15),
                                        struct('PT60M', 'ONMB', 60))) g AS grain, market, step
              LATERAL VIEW explode(sequence(0, 1439, step)) m AS minute)""")
    return Calendar(days, periods)


@query("period_lookup", """
WITH src AS (SELECT event_id,
    CASE event_id % 4 WHEN 0 THEN 'PT5M' WHEN 1 THEN 'PT15M' WHEN 2 THEN 'PT60M' ELSE 'P1D' END AS grain,
    time_bucket(CASE event_id % 4 WHEN 0 THEN INTERVAL 5 MINUTE WHEN 1 THEN INTERVAL 15 MINUTE ELSE INTERVAL 60 MINUTE END, ts) AS slot
  FROM events)
SELECT event_id, grain,
  CASE WHEN grain <> 'P1D' THEN (CASE WHEN isodow(slot) >= 6 THEN 'W' ELSE 'R' END) || '-' || grain || '-' || strftime(slot, '%H:%M') END AS okres_w_dobie_id,
  CAST(CASE WHEN grain <> 'P1D' AND hour(slot) = 23 THEN CAST(slot AS DATE) + 1 ELSE CAST(slot AS DATE) END AS VARCHAR) AS doba_pl
FROM src
""")
def period_lookup_events(t):
    """Period and local day of each event; the unknown grain keeps its rows without a period."""
    nth = F.col("event_id") % 4
    grain = (
        F.when(nth == 0, "PT5M").when(nth == 1, "PT15M").when(nth == 2, "PT60M").otherwise("P1D")
    )
    step = F.when(nth == 0, 300).when(nth == 1, 900).otherwise(3600)
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    src = t.events.select(
        "event_id",
        grain.alias("grain"),
        ntz(F.timestamp_seconds(second - F.pmod(second, step))).alias("at"),
    )
    found = period_lookup(src, "at", "grain", calendar(t.spark))
    return found.select("event_id", "grain", "okres_w_dobie_id", F.col("doba_pl").cast("string").alias("doba_pl"))


@query("as_of_join", """
WITH f AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts AS v_ts, event_id AS v_id, event_type AS state FROM events WHERE event_type <> 'purchase')
SELECT f.event_id, f.user_id, f.ts, f.value, v.v_id, v.state FROM f ASOF LEFT JOIN v
  ON f.user_id = v.user_id AND f.ts >= v.v_ts
""")
def as_of_join_events(t):
    """State of the user at each purchase."""
    facts = t.events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    versions = t.events.filter(F.col("event_type") != "purchase").select(
        "user_id", F.col("ts").alias("v_ts"), F.col("event_id").alias("v_id"), F.col("event_type").alias("state")
    )
    return as_of_join(facts, versions, ["user_id"], "ts", "v_ts", ["v_id", "state"], ["v_id"])
