"""Joins, aggregates, windows, set operations: Spark's own operators, one query per family."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions.columns import micros
from ..operators.bounded import broadcast_if_small
from ..operators.ranges import band_join
from ..operators.stats import latest_by_key, null_profile
from ..session import new_path
from ..sinks.tables import write_bucketed
from .registry import query


def count_rows():
    return F.count(F.lit(1)).alias("n")


# ---- joins

@query("broadcast_enrich", """
SELECT n_name, r_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL
""")
def broadcast_enrich(t):
    """Fact rows looked up in two measured-small dimensions: no shuffle of the facts."""
    nations = t.nation.join(broadcast_if_small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        t.customer.join(broadcast_if_small(nations), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "r_name", "c_mktsegment")
        .agg(count_rows(), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    )


@query("merge_join_hint", """
SELECT o_orderstatus, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
""")
def merge_join_hint(t):
    """Sort-merge join of two large tables, asked for by hint."""
    return (
        t.lineitem.join(t.orders.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_orderstatus", "l_returnflag")
        .agg(count_rows(), F.round(F.sum("l_quantity"), 2).alias("qty"))
    )


@query("hash_join_hint", """
SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS price
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
""")
def hash_join_hint(t):
    """Shuffled hash join, asked for by hint."""
    return (
        t.lineitem.join(t.part.hint("shuffle_hash"), F.col("p_partkey") == F.col("l_partkey"))
        .groupBy("p_brand")
        .agg(count_rows(), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    )


@query("bucketed_join", """
SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
""")
def bucketed_join(t):
    """Join of two tables bucketed alike: neither side is shuffled."""
    names = {}
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        names[name] = f"bucketed_{name}_{uuid.uuid4().hex}"
        write_bucketed(getattr(t, name), names[name], key, new_path(t.spark, names[name]))
    orders, lines = t.spark.table(names["orders"]), t.spark.table(names["lineitem"])
    return (
        lines.hint("merge")
        .join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_orderpriority")
        .agg(count_rows(), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    )


@query("theta_join_band", """
SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN nation ON o_totalprice >= n_nationkey * 20000.0 AND o_totalprice < n_nationkey * 20000.0 + 30000.0
GROUP BY n_name
""")
def theta_join_band(t):
    """Range join of orders with overlapping price bands, as a hash join on buckets."""
    bands = t.nation.select(
        "n_name",
        (F.col("n_nationkey") * 20000.0).alias("low"),
        (F.col("n_nationkey") * 20000.0 + 30000.0).alias("high"),
    )
    return (
        band_join(t.orders.select("o_totalprice"), bands, "o_totalprice", "low", "high", 10000.0)
        .groupBy("n_name")
        .agg(count_rows(), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query("semi_anti_join", """
SELECT 'semi' AS kind, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL
SELECT 'anti', count(*), round(sum(c_acctbal), 2) FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
""")
def semi_anti_join(t):
    pending = t.orders.filter(F.col("o_orderstatus") == "P")
    cond = F.col("c_custkey") == F.col("o_custkey")

    def side(how):
        return t.customer.join(pending, cond, f"left_{how}").agg(
            F.lit(how).alias("kind"), count_rows(), F.round(F.sum("c_acctbal"), 2).alias("balance")
        )

    return side("semi").unionByName(side("anti"))


# ---- aggregates

@query("group_count", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def group_count(t):
    return t.documents.groupBy("lang", "source").agg(count_rows())


@query("null_profile", """
WITH e AS (SELECT event_id, nullif(event_type, 'error') AS event_type,
  CASE WHEN value > 20 THEN value END AS value, ts FROM events)
SELECT 'event_id' AS "column", count(*) - count(event_id) AS nulls, count(*) AS rows FROM e UNION ALL
SELECT 'event_type', count(*) - count(event_type), count(*) FROM e UNION ALL
SELECT 'value', count(*) - count(value), count(*) FROM e UNION ALL
SELECT 'ts', count(*) - count(ts), count(*) FROM e
""")
def null_profile_events(t):
    return null_profile(
        t.events.select(
            "event_id",
            F.nullif("event_type", F.lit("error")).alias("event_type"),
            F.when(F.col("value") > 20, F.col("value")).alias("value"),
            "ts",
        )
    )


@query("null_filters", """
SELECT count(*) FILTER (WHERE quality IS NOT NULL) AS labelled, count(*) FILTER (WHERE quality IS NULL) AS unlabelled
FROM documents LEFT JOIN labels USING (doc_id)
""")
def null_filters(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.agg(
        F.count(F.when(F.col("quality").isNotNull(), 1)).alias("labelled"),
        F.count(F.when(F.col("quality").isNull(), 1)).alias("unlabelled"),
    )


SALES = "FROM lineitem GROUP BY"
SUMS = "count(*) AS n, round(sum(l_quantity), 2) AS qty"


@query("rollup_sales", f"""
SELECT l_returnflag, l_linestatus, {SUMS}, grouping(l_returnflag) :: INT AS g1, grouping(l_linestatus) :: INT AS g2
{SALES} ROLLUP (l_returnflag, l_linestatus)
""")
def rollup_sales(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(
        count_rows(),
        F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.grouping("l_returnflag").cast("int").alias("g1"),
        F.grouping("l_linestatus").cast("int").alias("g2"),
    )


@query("cube_sales", f"""
SELECT l_returnflag, l_linestatus, {SUMS},
  (grouping(l_returnflag) * 2 + grouping(l_linestatus)) :: BIGINT AS gid
{SALES} CUBE (l_returnflag, l_linestatus)
""")
def cube_sales(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(
        count_rows(), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().cast("bigint").alias("gid")
    )


@query("grouping_sets_sales", f"""
SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS BIGINT) AS y, {SUMS}
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, year(l_shipdate)), ())
""")
def grouping_sets_sales(t):
    t.lineitem.createOrReplaceTempView("sales_lines")
    return t.spark.sql(f"""
        SELECT l_returnflag, l_linestatus, y, {SUMS}
        FROM (SELECT *, CAST(year(l_shipdate) AS BIGINT) AS y FROM sales_lines)
        GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, y), ())""")


@query("agg_collections", """
SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts,
  count(*) AS kinds FROM (
  SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id
""")
def agg_collections(t):
    """Lists per key hold one entry per event type, however many events the key has."""
    counted = t.events.groupBy("user_id", "event_type").agg(count_rows())
    entry = F.concat_ws(":", "event_type", F.col("n").cast("string"))
    return counted.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("counts"),
        F.size(F.collect_set("event_type")).cast("bigint").alias("kinds"),
    )


@query("agg_statistics", """
SELECT l_returnflag, mode(l_linestatus) AS usual_status, regr_count(l_extendedprice, l_quantity) :: BIGINT AS pairs,
  round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(corr(l_quantity, l_discount), 6) AS corr_qd,
  round(stddev_samp(l_quantity), 6) AS sd_qty, round(var_pop(l_discount), 8) AS var_disc,
  bool_and(l_quantity > 0) AS all_positive, bool_or(l_discount = 0.1) AS any_tenth
FROM lineitem GROUP BY l_returnflag
""")
def agg_statistics(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.mode("l_linestatus").alias("usual_status"),
        F.regr_count("l_extendedprice", "l_quantity").alias("pairs"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
        F.round(F.corr("l_quantity", "l_discount"), 6).alias("corr_qd"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd_qty"),
        F.round(F.var_pop("l_discount"), 8).alias("var_disc"),
        F.every(F.col("l_quantity") > 0).alias("all_positive"),
        F.some(F.col("l_discount") == 0.1).alias("any_tenth"),
    )


@query("agg_approx")
def agg_approx(t):
    """Sketches; the values are estimates, so there is no SQL to compare with."""
    return t.events.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("users_hll"),
        F.hll_sketch_estimate(F.hll_sketch_agg("user_id", F.lit(12))).alias("users_sketch"),
        F.theta_sketch_estimate(F.theta_sketch_agg("user_id")).alias("users_theta"),
        F.percentile_approx("value", [0.5, 0.95, 0.99], 1000).alias("tails"),
        F.length(F.count_min_sketch("user_id", F.lit(0.01), F.lit(0.95), F.lit(7))).alias("cms_bytes"),
    )


@query("latest_by_key", """
SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value, count(*) AS n
FROM events GROUP BY user_id
""")
def latest_by_key_events(t):
    """Running counter and last value per key."""
    rows = t.events.select("user_id", "ts", "event_id", "event_type", "value")
    return latest_by_key(rows, ["user_id"], ["ts", "event_id"], count_rows()).drop("event_id")


# ---- windows

@query("win_ranking", """
SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rnk, dense_rank() OVER v AS drnk,
  ntile(4) OVER w AS quarter, round(percent_rank() OVER v, 6) AS pct, round(cume_dist() OVER v, 6) AS cume
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey),
  v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def win_ranking(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    v = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select(
        "o_custkey",
        "o_orderkey",
        F.row_number().over(w).cast("bigint").alias("rn"),
        F.rank().over(v).cast("bigint").alias("rnk"),
        F.dense_rank().over(v).cast("bigint").alias("drnk"),
        F.ntile(4).over(w).cast("bigint").alias("quarter"),
        F.round(F.percent_rank().over(v), 6).alias("pct"),
        F.round(F.cume_dist().over(v), 6).alias("cume"),
    )


@query("win_offset", """
SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after2,
  nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
  first_value(event_type) OVER w AS first_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def win_offset(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.events.select(
        "event_id",
        F.lag("value").over(w).alias("before"),
        F.lead("value", 2).over(w).alias("after2"),
        F.nth_value("value", 2).over(whole).alias("second"),
        F.first("event_type").over(w).alias("first_type"),
    )


@query("win_frames", """
SELECT event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running,
  round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def win_frames(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    by_time = Window.partitionBy("user_id").orderBy("at")
    return t.events.withColumn("at", micros("ts")).select(
        "event_id",
        F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"),
        F.round(F.avg("value").over(w.rowsBetween(-2, 2)), 4).alias("smooth"),
        F.count(F.lit(1)).over(by_time.rangeBetween(-86_400_000_000, 0)).alias("last_day"),
    )


@query("last_n_per_key", """
SELECT event_type, event_id, ts, n FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
WHERE n <= 100
""")
def last_n_per_key(t):
    """Newest 100 messages per topic; each task passes on its own newest 100 only."""
    newest = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return (
        t.events.withColumn("n", F.row_number().over(newest))
        .filter(F.col("n") <= 100)
        .select("event_type", "event_id", "ts", F.col("n").cast("bigint").alias("n"))
    )


# ---- sets, pivots, CTEs

@query("set_ops", """
SELECT 'union' AS op, count(*) AS n, sum(k) :: BIGINT AS keys FROM (
  SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'intersect', count(*), sum(k) :: BIGINT FROM (
  SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL
SELECT 'except', count(*), sum(k) :: BIGINT FROM (
  SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL
SELECT 'except_all', count(*), sum(k) :: BIGINT FROM (
  SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier)
""")
def set_ops(t):
    status = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    parts = {
        "union": t.customer.select(F.col("c_nationkey").alias("k"))
        .union(t.supplier.select("s_nationkey"))
        .distinct(),
        "intersect": status("F").intersect(status("P")),
        "except": t.customer.select(F.col("c_custkey").alias("k")).subtract(status("P")),
        "except_all": t.lineitem.select(F.col("l_suppkey").alias("k")).exceptAll(t.supplier.select("s_suppkey")),
    }
    frames = [
        df.agg(F.lit(op).alias("op"), count_rows(), F.sum("k").cast("bigint").alias("keys")) for op, df in parts.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query("pivot_events", """
SELECT date_trunc('day', ts) :: TIMESTAMP AS at_day,
  count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error,
  count(*) FILTER (WHERE event_type = 'view') AS "view"
FROM events GROUP BY ALL
""")
def pivot_events(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at_day")
    kinds = ["click", "error", "view"]
    counted = t.events.groupBy(day).pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return counted.fillna(0, kinds)


@query("cte_precedence", """
WITH t AS (SELECT max(value) AS v FROM events)
SELECT * FROM (WITH t AS (SELECT min(value) AS v FROM events) SELECT v FROM t)
""")
def cte_precedence(t):
    """The inner of two equally named common table expressions wins."""
    t.events.createOrReplaceTempView("cte_events")
    return t.spark.sql("""
        WITH t AS (SELECT max(value) AS v FROM cte_events)
        SELECT * FROM (WITH t AS (SELECT min(value) AS v FROM cte_events) SELECT v FROM t)""")
