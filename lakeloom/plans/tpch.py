"""Decision-support queries over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("tpch_q1", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
  round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
  round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL
""")
def q1(t):
    """Pricing summary."""
    return (
        t.lineitem.filter(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(revenue()), 4).alias("sum_disc_price"),
            F.round(F.sum(revenue() * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 4).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query("tpch_q3", """
SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15'
  AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
""")
def q3(t):
    """Unshipped orders of largest value."""
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    buyers = t.customer.filter(F.col("c_mktsegment") == "BUILDING")
    orders = t.orders.filter(F.col("o_orderdate") < day)
    lines = t.lineitem.filter(F.col("l_shipdate") > day)
    open_orders = orders.join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return (
        lines.join(open_orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_orderkey", "o_orderdate")
        .agg(F.round(F.sum(revenue()), 4).alias("revenue"))
        .orderBy(F.col("revenue").desc(), "o_orderdate", "l_orderkey")
        .limit(10)
    )


@query("tpch_q5", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
  AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
  AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
GROUP BY n_name
""")
def q5(t):
    """Revenue of local suppliers."""
    orders = t.orders.filter(
        (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    )
    nations = t.nation.join(
        t.region.filter(F.col("r_name") == "ASIA"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi"
    )
    sellers = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    bought = orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return (
        t.lineitem.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(
            bought,
            (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")),
        )
        .groupBy("n_name")
        .agg(F.round(F.sum(revenue()), 4).alias("revenue"))
        .orderBy(F.col("revenue").desc())
    )


@query("tpch_q6", """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
  AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24
""")
def q6(t):
    """Forecast of a revenue change."""
    return (
        t.lineitem.filter(
            (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
            & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
            & F.col("l_discount").between(0.05, 0.07)
            & (F.col("l_quantity") < 24)
        )
        .agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))
    )


@query("tpch_q9", """
SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_profit
FROM part, supplier, lineitem, orders, nation
WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
  AND s_nationkey = n_nationkey AND p_name LIKE '%widget%'
GROUP BY ALL
""")
def q9(t):
    """Revenue of matching parts by nation and year (the tables hold no supply cost)."""
    parts = t.part.filter(F.col("p_name").like("%widget%"))
    sellers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        t.lineitem.join(parts, F.col("p_partkey") == F.col("l_partkey"), "left_semi")
        .join(sellers, F.col("s_suppkey") == F.col("l_suppkey"))
        .join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.col("n_name").alias("nation"), F.year("o_orderdate").cast("bigint").alias("o_year"))
        .agg(F.round(F.sum(revenue()), 4).alias("sum_profit"))
        .orderBy("nation", F.col("o_year").desc())
    )


@query("tpch_q13", """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer
  LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT'
  GROUP BY c_custkey) GROUP BY c_count
""")
def q13(t):
    """Customers by number of orders."""
    orders = t.orders.filter(F.col("o_orderpriority") != "1-URGENT")
    # Counting before the join keeps a customer with very many orders to one row.
    counts = orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("_n"))
    return (
        t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
        .groupBy(F.coalesce("_n", F.lit(0)).alias("c_count"))
        .agg(F.count(F.lit(1)).alias("custdist"))
        .orderBy(F.col("custdist").desc(), F.col("c_count").desc())
    )


@query("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 180)
  AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY ALL ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100
""")
def q18(t):
    """Largest orders by quantity."""
    large = (
        t.lineitem.groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("_qty"))
        .filter(F.col("_qty") > 180)
    )
    return (
        t.orders.join(large, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            "c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice",
            F.round("_qty", 2).alias("sum_qty"),
        )
        .orderBy(F.col("o_totalprice").desc(), "o_orderdate", "o_orderkey")
        .limit(100)
    )


@query("ds_window_cte", """
WITH spend AS (
  SELECT c_mktsegment, c_custkey, CAST(year(o_orderdate) AS BIGINT) AS o_year, sum(o_totalprice) AS total
  FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment, o_year ORDER BY total DESC, c_custkey) AS place,
    sum(total) OVER (PARTITION BY c_mktsegment, o_year) AS segment_total FROM spend)
SELECT c_mktsegment, o_year, c_custkey, round(total, 2) AS total,
  round(100 * total / segment_total, 4) AS share, place FROM placed WHERE place <= 3
""")
def ds_window_cte(t):
    """Best customers per segment and year with their share."""
    spend = (
        t.orders.groupBy("o_custkey", F.year("o_orderdate").cast("bigint").alias("o_year"))
        .agg(F.sum("o_totalprice").alias("total"))
        .join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    )
    spend.createOrReplaceTempView("customer_spend")
    return t.spark.sql("""
        WITH segment AS (
          SELECT c_mktsegment, o_year, sum(total) AS segment_total FROM customer_spend
          GROUP BY c_mktsegment, o_year),
        placed AS (
          SELECT c_mktsegment, o_year, c_custkey, total,
            row_number() OVER (PARTITION BY c_mktsegment, o_year ORDER BY total DESC, c_custkey) AS place
          FROM customer_spend)
        SELECT p.c_mktsegment, p.o_year, c_custkey, round(total, 2) AS total,
          round(100 * total / segment_total, 4) AS share, place
        FROM placed p JOIN segment s ON p.c_mktsegment = s.c_mktsegment AND p.o_year = s.o_year
        WHERE place <= 3""")
