"""File ingest: CSV union, zipped deliveries, merged Parquet, writers, scripts."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import ntz
from ..functions.names import archive_base, archive_table, business_date, delivery_flag, version_time
from ..session import new_path, settle
from ..sinks.tables import append_table, check_compat, ingest_files, read_table, replace_table, write_checked, write_partitioned
from ..sources import archives as ar
from ..sources.files import batch_glob, file_profile, read_csv_union, scan_merged
from ..sources.sqlscript import run_script
from .registry import query


def count_rows():
    return F.count(F.lit(1)).alias("n")


@query("csv_union_employees", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS age, c_mktsegment AS department,
  lower(c_name) || '@example.com' AS email, NULL :: VARCHAR AS full_name FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL, 'Sales', NULL, NULL FROM supplier
UNION ALL SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0'), NULL, CAST(p_size AS VARCHAR), p_type, NULL, p_name FROM part
""")
def csv_union_employees(t):
    """Three CSV folders of different headers as one table of text columns."""
    root = new_path(t.spark, "employees")
    text = lambda c: F.col(c).cast("string")
    t.customer.select(
        text("c_custkey").alias("id"), F.col("c_name").alias("name"), text("c_nationkey").alias("age"),
        F.col("c_mktsegment").alias("department"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
    ).write.csv(f"{root}/employees_added", header=True)
    t.supplier.select(
        text("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Sales").alias("department")
    ).write.csv(f"{root}/employees_deleted", header=True)
    t.part.select(
        F.lpad(text("p_partkey"), 8, "0").alias("id"), F.col("p_name").alias("full_name"),
        text("p_size").alias("age"), F.col("p_type").alias("department"),
    ).write.csv(f"{root}/employees_renamed", header=True)
    names = ("employees_added", "employees_deleted", "employees_renamed")
    return read_csv_union(t.spark, [f"{root}/{n}" for n in names])


# ---- zipped deliveries made of the events: at most ROWS_PER_ARCHIVE rows per archive

ROWS_PER_ARCHIVE = 1000
ARCHIVE_NAME_SQL = (
    "upper(event_type) || '_20240131_K_20240201' || lpad(CAST(event_id // 1000 AS VARCHAR), 9, '0')"
)


@F.pandas_udf(T.BinaryType())
def _zip(headers: pd.Series, lines: pd.Series, encodings: pd.Series) -> pd.Series:
    def pack(header, rows, encoding):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("data.csv", "\r\n".join([header, *rows, ""]).encode(encoding))
        return out.getvalue()

    return pd.Series([pack(*row) for row in zip(headers, lines, encodings)])


def event_archives(t) -> DataFrame:
    """(path, length, content): archives per event type and thousand of ids.

    `view` files are Latin-1, `signup` files of odd number have one column less and padded
    header names, every 50th line has a field too many.
    """
    number = F.floor(F.col("event_id") / ROWS_PER_ARCHIVE).cast("long")
    short = (F.col("event_type") == "signup") & (F.col("number") % 2 == 1)
    name = F.concat(
        F.upper("event_type"), F.lit("_20240131_K_20240201"), F.lpad(F.col("number").cast("string"), 9, "0")
    )
    text = lambda c: F.col(c).cast("string")
    line = F.concat_ws(
        ";", text("event_id"), text("user_id"),
        F.when(~short, F.concat(F.lit("é"), F.col("event_type"))),
        F.when(F.col("event_id") % 50 == 0, F.concat(text("value"), F.lit(";x"))).otherwise(text("value")),
    )
    packed = (
        t.events.withColumn("number", number)
        .withColumn("short", short)
        .groupBy("event_type", "number", "short", name.alias("name"))
        # A group is one archive of at most a thousand ids.
        .agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("rows"))
    )
    header = F.when(F.col("short"), "event_id; user_id ; value").otherwise("event_id;user_id;note;value")
    encoding = F.when(F.col("event_type") == "view", "latin-1").otherwise("utf-8")
    content = _zip(header, F.col("rows.line"), encoding)
    archives = packed.select(
        F.concat(F.lit("in/20240201/"), "name", F.lit(".csv.ZIP")).alias("path"), content.alias("content")
    ).select("path", F.length("content").cast("long").alias("length"), "content")
    # Packed once, as delivered files would be; reading names does not pack again.
    return settle(archives, "archives")


LINES_SQL = f"""
SELECT {ARCHIVE_NAME_SQL} AS base, upper(event_type) AS "table", event_id,
  row_number() OVER (PARTITION BY event_type, event_id // 1000 ORDER BY event_id) AS line_no,
  event_id || ';' || user_id || ';' || CASE WHEN event_type = 'signup' AND (event_id // 1000) % 2 = 1 THEN '' ELSE 'é' || event_type || ';' END
    || value || CASE WHEN event_id % 50 = 0 THEN ';x' ELSE '' END AS line
FROM events
"""


@query("zip_lines", f'SELECT base, "table", line_no, line FROM ({LINES_SQL})')
def zip_lines(t):
    """Lines of every archive, unpacked and decoded on the executors."""
    lines = ar.zip_lines(event_archives(t)).filter(F.col("line").isNotNull())
    path = F.col("path")
    return lines.select(archive_base(path).alias("base"), archive_table(path).alias("table"), "line_no", "line")


@query("zip_table_load", """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN (event_id // 1000) % 2 = 0 THEN 'ésignup' END AS note, CAST(value AS VARCHAR) AS value
FROM events WHERE event_type = 'signup' AND event_id % 50 <> 0
""")
def zip_table_load(t):
    """One delivery table: two header layouts united, ragged lines left out."""
    return ar.Delivery(event_archives(t), ["SIGNUP"]).table("SIGNUP").select("event_id", "user_id", "note", "value")


@query("ragged_quarantine", f'SELECT base, "table", line_no, line FROM ({LINES_SQL}) WHERE event_id % 50 = 0')
def ragged_quarantine(t):
    """Lines whose number of fields differs from their header's."""
    return ar.Delivery(event_archives(t)).quarantine().select("table", "base", "line_no", "line")


@query("archive_inventory", """
SELECT upper(event_type) AS "table", count(DISTINCT event_id // 1000) AS archives FROM events GROUP BY event_type
""")
def archive_inventory(t):
    """Archives per delivery table."""
    return ar.inventory(event_archives(t)).select("table", "archives")


@query("archive_name_parse", """
SELECT event_id, 'DEPOT_' || upper(event_type) AS "table", strftime(ts, '%Y-%m-%d') AS business_date,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'K' END AS flag, date_trunc('millisecond', ts) AS version_time,
  'DEPOT_' || upper(event_type) || '_' || strftime(ts, '%Y%m%d') || '_' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'K' END
    || '_' || strftime(ts, '%Y%m%d%H%M%S%g') AS base
FROM events
""")
def archive_name_parse(t):
    """Table, business date, flag and version time from the name of an archive per event."""
    path = F.concat(
        F.lit("in/20240201/DEPOT_"), F.upper("event_type"), F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit("_"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise("K"), F.lit("_"),
        F.date_format("ts", "yyyyMMddHHmmssSSS"), F.when(F.col("event_id") % 2 == 0, ".csv.ZIP").otherwise(".CSV.zip"),
    )
    named = t.events.select("event_id", path.alias("path"))
    p = F.col("path")
    return named.select(
        "event_id", archive_table(p).alias("table"), business_date(p).cast("string").alias("business_date"),
        delivery_flag(p).alias("flag"), ntz(version_time(p)).alias("version_time"), archive_base(p).alias("base"),
    )


@query("latest_delivery", """
SELECT upper(event_type) AS "table", upper(event_type) || '_20240131_' || user_id AS base,
  max('in/' || strftime(ts, '%Y%m%d') || '/' || upper(event_type) || '_20240131_' || user_id || '.csv.zip') AS path, count(*) - 1 AS replaced
FROM events GROUP BY event_type, user_id
""")
def latest_delivery(t):
    """Of several deliveries with one name, the one in the last folder counts."""
    base = F.concat(F.upper("event_type"), F.lit("_20240131_"), F.col("user_id").cast("string"))
    path = F.concat(F.lit("in/"), F.date_format("ts", "yyyyMMdd"), F.lit("/"), base, F.lit(".csv.zip"))
    return ar.latest_delivery(t.events.select(path.alias("path")))


# ---- Parquet and other formats

@query("parquet_merge_scan", """
SELECT batch, count(*) AS n, count(o_totalprice) AS priced, sum(o_orderkey) :: BIGINT AS keys,
  round(sum(o_totalprice), 2) AS total FROM (
  SELECT '01' AS batch, o_orderkey, NULL AS o_totalprice FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT '02', o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F') GROUP BY batch
""")
def parquet_merge_scan(t):
    """Batches of different columns scanned as one table, with the file each row came from."""
    root = new_path(t.spark, "batches")
    done = F.col("o_orderstatus") == "F"
    t.orders.filter(done).select("o_orderkey").write.parquet(f"{root}/01/orders")
    t.orders.filter(~done).select("o_orderkey", "o_totalprice").write.parquet(f"{root}/02/orders")
    merged = scan_merged(t.spark, batch_glob(root, "all", "orders"))
    batch = F.regexp_extract("source", r"/(\d+)/orders/[^/]+$", 1).alias("batch")
    return merged.groupBy(batch).agg(
        count_rows(), F.count("o_totalprice").alias("priced"), F.sum("o_orderkey").alias("keys"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


@query("file_profile", """
SELECT 'orders.parquet' AS file_name, count(*) AS record_count FROM orders
UNION ALL SELECT 'lineitem.parquet', count(*) FROM lineitem
""")
def file_profile_tables(t):
    """Rows per data file."""
    profiles = [file_profile(t.spark, t.path(name)) for name in ("orders", "lineitem")]
    return profiles[0].unionByName(profiles[1]).select("file_name", "record_count")


@query("formats_roundtrip", """
SELECT format, count(*) AS n, sum(o_orderkey) :: BIGINT AS keys, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last_day
FROM orders, (SELECT unnest(['parquet', 'orc', 'json', 'csv']) AS format) GROUP BY format
""")
def formats_roundtrip(t):
    """The same rows written and read in four formats."""
    out = None
    for form in ("parquet", "orc", "json", "csv"):
        path = new_path(t.spark, f"orders-{form}")
        t.orders.write.format(form).save(path)
        back = t.spark.read.schema(t.orders.schema).format(form).load(path)
        part = back.agg(
            F.lit(form).alias("format"), count_rows(), F.sum("o_orderkey").alias("keys"),
            F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last_day"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("sql_script_last", """
SELECT o_orderstatus, count(*) AS n, 'a;b' AS mark FROM orders GROUP BY o_orderstatus
""")
def sql_script_last(t):
    """A script of several statements; semicolons in strings and comments do not end one."""
    t.orders.createOrReplaceTempView("script_orders")
    script = """
        -- states; of orders
        CREATE OR REPLACE TEMPORARY VIEW script_states AS
          SELECT o_orderstatus, count(*) AS n FROM script_orders GROUP BY o_orderstatus;
        /* a comment; with a semicolon */
        SHOW TABLES;
        SELECT o_orderstatus, n, 'a;b' AS mark FROM script_states;
    """
    return run_script(t.spark, script)[-1][1]


# ---- writers

@query("write_roundtrip", "SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def write_roundtrip(t):
    """Replacing a table replaces its rows and its columns."""
    path = new_path(t.spark, "orders")
    replace_table(t.customer, path)
    replace_table(t.orders.filter(F.col("o_orderstatus") != "F"), path)
    return read_table(t.spark, path)


@query("append_roundtrip", "SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def append_roundtrip(t):
    """Rows appended to a table of the same columns, given in another order."""
    path = new_path(t.spark, "customer")
    replace_table(t.customer, path)
    more = t.customer.filter(F.col("c_mktsegment") == "BUILDING")
    append_table(more.select(*reversed(more.columns)), path)
    return read_table(t.spark, path)


@query("write_validation", """
SELECT 'orders' AS table_name, count(*) AS written, count(*) AS found, 'PASSED' AS status FROM orders
UNION ALL SELECT 'events', count(*), count(*), 'PASSED' FROM events
""")
def write_validation(t):
    """Rows written against rows read back."""
    rows = []
    for name in ("orders", "events"):
        check = write_checked(getattr(t, name), new_path(t.spark, name))
        rows.append((name, check.written, check.found, "PASSED" if check.passed else "FAILED"))
    return t.spark.createDataFrame(rows, "table_name string, written bigint, found bigint, status string")


@query("schema_gate", """
SELECT mode, CASE WHEN mode IN ('BACKWARD', 'NONE') THEN 'accepted' ELSE 'rejected' END AS decision, count(*) AS n FROM events,
  (SELECT unnest(['STRICT', 'BACKWARD', 'FORWARD', 'FULL', 'NONE']) AS mode) GROUP BY ALL
""")
def schema_gate(t):
    """Batches of a wider id type and an extra optional column against each compatibility mode."""
    old = T.StructType.fromDDL("event_id int, ts timestamp_ntz, value double")
    batch = t.events.select("event_id", "ts", "value", F.col("event_type").alias("kind"))
    out = None
    for mode in ("STRICT", "BACKWARD", "FORWARD", "FULL", "NONE"):
        verdict = "rejected" if check_compat(old, batch.schema, mode) else "accepted"
        part = batch.agg(F.lit(mode).alias("mode"), F.lit(verdict).alias("decision"), count_rows())
        out = part if out is None else out.unionByName(part)
    return out


@query("partition_pruned_scan", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem
WHERE l_returnflag = 'R' GROUP BY ALL
""")
def partition_pruned_scan(t):
    """A table partitioned by a key; a filter on the key reads one folder."""
    path = new_path(t.spark, "lineitem")
    write_partitioned(t.lineitem, "l_returnflag", path)
    back = t.spark.read.parquet(path).filter(F.col("l_returnflag") == "R")
    return back.groupBy("l_returnflag", "l_linestatus").agg(count_rows(), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("ingest_append", """
SELECT 'db.' || lower(o_orderstatus) AS "table", count(*) AS n, sum(o_orderkey) :: BIGINT AS keys FROM orders GROUP BY o_orderstatus
""")
def ingest_append(t):
    """Files named by requests appended to their tables, read back per table."""
    root = new_path(t.spark, "ingest")
    requests = None
    for status in ("F", "O", "P"):
        for half in (0, 1):
            path = f"{root}/landing/{status}/{half}"
            part = (F.col("o_orderstatus") == status) & (F.col("o_orderkey") % 2 == half)
            t.orders.filter(part).write.parquet(path)
            listed = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
            files = listed.select(F.lit(f"db.{status.lower()}").alias("table"), F.col("path").alias("file"))
            requests = files if requests is None else requests.unionByName(files)
    done = ingest_files(requests, lambda table: f"{root}/tables/{table}")
    out = None
    for table in sorted(done):
        part = read_table(t.spark, f"{root}/tables/{table}").agg(
            F.lit(table).alias("table"), count_rows(), F.sum("o_orderkey").alias("keys")
        )
        out = part if out is None else out.unionByName(part)
    return out
