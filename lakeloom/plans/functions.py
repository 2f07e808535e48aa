"""One query per family of scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import json_schema
from .registry import query


@query("fn_string", """
SELECT p_partkey, upper(p_name) AS up, array_to_string(list_transform(string_split(p_name, ' '),
    lambda w : upper(w[1]) || lower(w[2:])), ' ') AS title,
  translate(p_name, 'aeiou', '12345') AS coded, lpad(CAST(p_size AS VARCHAR), 4, '0') AS size4,
  substring(p_brand, 7) AS brand_no, length(p_name) :: BIGINT AS n, reverse(p_type) AS rev,
  base64(encode(p_name)) AS b64, p_name LIKE '%ring' AS is_ring, replace(p_name, ' ', '_') AS snake,
  printf('%s-%03d', p_type, p_size) AS label, md5(p_name) AS digest, position('o' IN p_name) :: BIGINT AS at_o
FROM part
""")
def fn_string(t):
    return t.part.select(
        "p_partkey",
        F.upper("p_name").alias("up"),
        F.initcap("p_name").alias("title"),
        F.translate("p_name", "aeiou", "12345").alias("coded"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size4"),
        F.expr("substring(p_brand, 7)").alias("brand_no"),
        F.length("p_name").cast("bigint").alias("n"),
        F.reverse("p_type").alias("rev"),
        F.base64(F.encode("p_name", "UTF-8")).alias("b64"),
        F.col("p_name").like("%ring").alias("is_ring"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("snake"),
        F.format_string("%s-%03d", "p_type", "p_size").alias("label"),
        F.md5("p_name").alias("digest"),
        F.locate("o", "p_name").cast("bigint").alias("at_o"),
    )


@query("fn_regex", """
SELECT doc_id, regexp_extract(text, '([A-Za-z]+)\\.', 1) AS before_stop,
  len(regexp_extract_all(text, '[0-9]+')) :: BIGINT AS numbers,
  length(regexp_replace(text, '[AEIOUaeiou]', '', 'g')) :: BIGINT AS consonants,
  regexp_matches(text, '(?i)tion') AS has_tion
FROM documents
""")
def fn_regex(t):
    return t.documents.select(
        "doc_id",
        F.regexp_extract("text", r"([A-Za-z]+)\.", 1).alias("before_stop"),
        F.regexp_count("text", F.lit("[0-9]+")).cast("bigint").alias("numbers"),
        F.length(F.regexp_replace("text", "[AEIOUaeiou]", "")).cast("bigint").alias("consonants"),
        F.col("text").rlike("(?i)tion").alias("has_tion"),
    )


@query("fn_regex_lookaround")
def fn_regex_lookaround(t):
    """Look-ahead and look-behind, which the SQL engine to compare with does not have."""
    return t.documents.groupBy("lang").agg(
        F.sum(F.regexp_count("text", F.lit(r"(?<=\s)\p{L}+(?=\.)"))).alias("before_stop"),
        F.sum(F.regexp_count("text", F.lit(r"\b(?!the\b)\p{L}+"))).alias("not_the"),
    )


@query("fn_datetime", """
SELECT event_id, CAST(ts AS DATE) :: VARCHAR AS d, strftime(ts, '%H:%M') AS hm, (CAST(ts AS DATE) + 1) :: VARCHAR AS tomorrow,
  CAST(year(ts) AS BIGINT) AS y, CAST(quarter(ts) AS BIGINT) AS q, CAST(dayofyear(ts) AS BIGINT) AS doy,
  CAST(isodow(ts) AS BIGINT) AS dow, date_trunc('hour', ts) AS h, date_trunc('month', ts) :: DATE :: VARCHAR AS m,
  last_day(ts) :: VARCHAR AS month_end, ts + INTERVAL 90 MINUTE AS later,
  date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) :: BIGINT AS days, epoch_us(ts) :: BIGINT AS us,
  make_timestamp(2024, 2, CAST(1 + event_id % 28 AS BIGINT), 12, 30, 15.5) AS made
FROM events
""")
def fn_datetime(t):
    at = F.col("ts")
    return t.events.select(
        "event_id",
        at.cast("date").cast("string").alias("d"),
        F.date_format("ts", "HH:mm").alias("hm"),
        F.date_add(at.cast("date"), 1).cast("string").alias("tomorrow"),
        F.year("ts").cast("bigint").alias("y"),
        F.quarter("ts").cast("bigint").alias("q"),
        F.dayofyear("ts").cast("bigint").alias("doy"),
        (F.weekday("ts") + 1).cast("bigint").alias("dow"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"),
        F.trunc("ts", "month").cast("string").alias("m"),
        F.last_day("ts").cast("string").alias("month_end"),
        (at + F.expr("INTERVAL 90 MINUTES")).alias("later"),
        F.date_diff(at.cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("days"),
        F.unix_micros(at.cast("timestamp")).alias("us"),
        F.make_timestamp_ntz(
            F.lit(2024), F.lit(2), (1 + F.col("event_id") % 28).cast("int"), F.lit(12), F.lit(30),
            F.lit(15.5).cast("decimal(8,6)"),
        ).alias("made"),
    )


@query("fn_math", """
SELECT event_id, round(sqrt(value), 6) AS root, CASE WHEN value > 0 THEN round(ln(value), 6) END AS logn, floor(value) :: BIGINT AS lo,
  ceil(value) :: BIGINT AS hi, round(pow(value, 2), 4) AS sq, (event_id % 7) :: BIGINT AS rem, sign(value - 20) :: INT AS sgn,
  round(value / 3, 2) AS third, CASE WHEN user_id <> 0 THEN value / user_id END AS per_user,
  greatest(value, 20.0) AS at_least, bit_count(event_id) :: INT AS bits, (event_id & 255) :: BIGINT AS low_byte,
  NULL :: BIGINT AS overflow
FROM events
""")
def fn_math(t):
    value = F.col("value")
    return t.events.select(
        "event_id",
        F.round(F.sqrt("value"), 6).alias("root"),
        F.round(F.ln("value"), 6).alias("logn"),
        F.floor("value").alias("lo"),
        F.ceil("value").alias("hi"),
        F.round(F.pow("value", F.lit(2)), 4).alias("sq"),
        (F.col("event_id") % 7).alias("rem"),
        F.signum(value - 20).cast("int").alias("sgn"),
        F.round(value / 3, 2).alias("third"),
        F.try_divide("value", F.col("user_id").cast("double")).alias("per_user"),
        F.greatest("value", F.lit(20.0)).alias("at_least"),
        F.bit_count("event_id").alias("bits"),
        F.col("event_id").bitwiseAND(255).alias("low_byte"),
        F.try_add(F.col("event_id") + 1, F.lit((1 << 63) - 1)).alias("overflow"),
    )


@query("fn_cast", """
SELECT c_custkey, trunc(c_acctbal) :: BIGINT AS whole_b, CAST(CAST(c_acctbal AS DECIMAL(14,1)) AS VARCHAR) AS dec1,
  TRY_CAST(substring(c_name, 10) AS BIGINT) AS number, TRY_CAST(c_name AS BIGINT) AS not_a_number,
  CAST(c_nationkey AS VARCHAR) AS text, CAST('2024-02-' || lpad(CAST(1 + c_nationkey AS VARCHAR), 2, '0') AS DATE) :: VARCHAR AS d,
  TRY_CAST('2024-02-' || CAST(20 + c_nationkey AS VARCHAR) AS DATE) :: VARCHAR AS maybe_d, c_nationkey > 0 AS flag
FROM customer
""")
def fn_cast(t):
    tail = F.expr("substring(c_name, 10)")
    return t.customer.select(
        "c_custkey",
        F.col("c_acctbal").cast("bigint").alias("whole_b"),
        F.col("c_acctbal").cast("decimal(14,1)").cast("string").alias("dec1"),
        tail.try_cast("bigint").alias("number"),
        F.col("c_name").try_cast("bigint").alias("not_a_number"),
        F.col("c_nationkey").cast("string").alias("text"),
        F.concat(F.lit("2024-02-"), F.lpad((1 + F.col("c_nationkey")).cast("string"), 2, "0"))
        .cast("date").cast("string").alias("d"),
        F.concat(F.lit("2024-02-"), (20 + F.col("c_nationkey")).cast("string"))
        .try_cast("date").cast("string").alias("maybe_d"),
        F.col("c_nationkey").cast("boolean").alias("flag"),
    )


@query("fn_conditional", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE 'O' END AS code,
  coalesce(nullif(event_type, 'error'), 'failed') AS state, event_type NOT IN ('click', 'view') AS other,
  value NOT BETWEEN 5 AND 50 AS outside, CASE WHEN value > 100 THEN value END AS large,
  CASE WHEN nullif(event_type, 'view') IS NULL THEN 1 ELSE 0 END AS is_null,
  (nullif(event_type, 'view') IS NOT DISTINCT FROM NULL) AS same_null
FROM events
""")
def fn_conditional(t):
    kind = F.col("event_type")
    hidden = F.nullif("event_type", F.lit("view"))
    return t.events.select(
        "event_id",
        F.when(kind == "click", "C").when(kind == "view", "V").otherwise("O").alias("code"),
        F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("failed")).alias("state"),
        (~kind.isin("click", "view")).alias("other"),
        (~F.col("value").between(5, 50)).alias("outside"),
        F.when(F.col("value") > 100, F.col("value")).alias("large"),
        F.when(hidden.isNull(), 1).otherwise(0).alias("is_null"),
        hidden.eqNullSafe(F.lit(None)).alias("same_null"),
    )


@query("fn_json", """
SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' AS missing,
  '{"id":' || event_id || ',"type":"' || event_type || '"}' AS message,
  len(json_keys(props)) :: BIGINT AS n_keys
FROM events
""")
def fn_json(t):
    parsed = F.from_json("props", "k bigint")
    return t.events.select(
        "event_id",
        parsed["k"].alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("message"),
        F.size(F.json_object_keys("props")).cast("bigint").alias("n_keys"),
    )


@query("fn_json_tuple", """
SELECT event_type, sum(CAST(props->>'$.k' AS BIGINT)) :: BIGINT AS total FROM events GROUP BY event_type
""")
def fn_json_tuple(t):
    read = t.events.select("event_type", F.json_tuple("props", "k").alias("k"))
    return read.groupBy("event_type").agg(F.sum(F.col("k").cast("bigint")).alias("total"))


@query("fn_array", """
SELECT vec_id, len(embedding) :: BIGINT AS dims, round(list_sum(list_transform(embedding, lambda x : x :: DOUBLE * x)), 4) AS sq,
  len(list_filter(embedding, lambda x : x > 0)) :: BIGINT AS positive, round(list_max(embedding) :: DOUBLE, 5) AS top,
  round(embedding[3] :: DOUBLE, 5) AS third, len(embedding[2:5]) :: BIGINT AS cut, list_contains(embedding, 0.0) AS has_zero
FROM embeddings
""")
def fn_array(t):
    v = F.col("embedding")
    wide = F.transform(v, lambda x: x.cast("double"))
    return t.embeddings.select(
        "vec_id",
        F.size(v).cast("bigint").alias("dims"),
        F.round(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x), 4).alias("sq"),
        F.size(F.filter(v, lambda x: x > 0)).cast("bigint").alias("positive"),
        F.round(F.array_max(v).cast("double"), 5).alias("top"),
        F.round(F.element_at(v, 3).cast("double"), 5).alias("third"),
        F.size(F.slice(v, 2, 4)).cast("bigint").alias("cut"),
        F.array_contains(v, F.lit(0.0).cast("float")).alias("has_zero"),
    )


@query("fn_generators", """
SELECT lang, word, count(*) AS n, sum(pos) :: BIGINT AS positions FROM (
  SELECT lang, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents)
GROUP BY lang, word
""")
def fn_generators(t):
    words = t.documents.select("lang", F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))
    return words.groupBy("lang", "word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").cast("bigint").alias("positions")
    )


@query("fn_stack", """
SELECT kind, count(*) AS n, round(sum(amount), 2) AS total FROM (
  SELECT 'price' AS kind, l_extendedprice AS amount FROM lineitem UNION ALL
  SELECT 'quantity', l_quantity FROM lineitem) GROUP BY kind
""")
def fn_stack(t):
    t.lineitem.createOrReplaceTempView("stack_lines")
    return t.spark.sql("""
        SELECT kind, count(*) AS n, round(sum(amount), 2) AS total
        FROM (SELECT stack(2, 'price', l_extendedprice, 'quantity', l_quantity) AS (kind, amount) FROM stack_lines)
        GROUP BY kind""")


@query("fn_map", """
SELECT event_id, event_type || '=' || value AS pair, 2 :: BIGINT AS n, value AS looked_up, true AS has_key
FROM events
""")
def fn_map(t):
    pairs = F.create_map(F.col("event_type"), F.col("value"), F.lit("-"), F.lit(0.0))
    return t.events.select(
        "event_id",
        F.concat(F.element_at(F.map_keys(pairs), 1), F.lit("="), F.element_at(F.map_values(pairs), 1).cast("string")).alias("pair"),
        F.size(pairs).cast("bigint").alias("n"),
        pairs[F.col("event_type")].alias("looked_up"),
        F.map_contains_key(pairs, F.col("event_type")).alias("has_key"),
    )


@query("fn_url", """
SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
  nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS ref,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, 'a b&c' AS decoded
FROM pages
""")
def fn_url(t):
    part = lambda name: F.parse_url("url", F.lit(name))
    return t.pages.select(
        "page_id",
        part("PROTOCOL").alias("scheme"),
        part("HOST").alias("host"),
        part("PATH").alias("path"),
        part("QUERY").alias("query"),
        part("REF").alias("ref"),
        F.parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"),
        F.url_decode(F.lit("a+b%26c")).alias("decoded"),
    )


@query("fn_special", """
SELECT event_id, true AS nan_equal, true AS nan_largest, isnan(CASE WHEN value > 50 THEN 'NaN' :: DOUBLE ELSE value END) AS is_nan,
  1500000 :: BIGINT AS interval_us, 0.0 :: DOUBLE AS zero_key
FROM events
""")
def fn_special(t):
    nan = F.lit(float("nan"))
    gap = F.expr("INTERVAL '1.5' SECOND")
    return t.events.select(
        "event_id",
        (nan == nan).alias("nan_equal"),
        (nan > F.col("value")).alias("nan_largest"),
        F.isnan(F.when(F.col("value") > 50, nan).otherwise(F.col("value"))).alias("is_nan"),
        (F.unix_micros((F.col("ts") + gap).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("interval_us"),
        F.element_at(F.map_keys(F.create_map(F.col("value") * F.lit(-0.0), F.lit(1))), 1).alias("zero_key"),
    )


@query("fn_string_more", """
SELECT c_custkey, c_name AS there_and_back, format('{:,.2f}', c_acctbal) AS formatted, c_name AS inner_text,
  2 :: BIGINT AS n_sentences, split_part(c_name, '#', 2) AS tail, c_mktsegment || '|' || c_nationkey AS joined,
  levenshtein(c_mktsegment, 'BUILDING') :: BIGINT AS distance, left(c_name, 3) || right(c_name, 3) AS ends,
  ascii(c_mktsegment) :: BIGINT AS code, repeat('x', 1 + c_nationkey % 3) AS xs
FROM customer
""")
def fn_string_more(t):
    return t.customer.select(
        "c_custkey",
        F.decode(F.unbase64(F.base64(F.encode("c_name", "UTF-8"))), "UTF-8").alias("there_and_back"),
        F.format_number("c_acctbal", 2).alias("formatted"),
        F.xpath_string(F.concat(F.lit("<a><b>"), "c_name", F.lit("</b></a>")), F.lit("a/b")).alias("inner_text"),
        F.size(F.sentences(F.concat(F.lower("c_mktsegment"), F.lit(" sells. Who buys?")))).cast("bigint").alias("n_sentences"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"),
        F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("joined"),
        F.levenshtein("c_mktsegment", F.lit("BUILDING")).cast("bigint").alias("distance"),
        F.concat(F.left("c_name", F.lit(3)), F.right("c_name", F.lit(3))).alias("ends"),
        F.ascii("c_mktsegment").cast("bigint").alias("code"),
        F.repeat(F.lit("x"), (1 + F.col("c_nationkey") % 3)).alias("xs"),
    )


@query("fn_datetime_more", """
SELECT o_orderkey, CAST(date_part('month', o_orderdate) AS BIGINT) AS m, CAST(extract(week FROM o_orderdate) AS BIGINT) AS w,
  o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY AS shifted, date_trunc('quarter', o_orderdate) :: TIMESTAMP AS quarter_start,
  date_diff('month', TIMESTAMP '1995-01-01', date_trunc('month', o_orderdate)) :: DOUBLE AS months,
  o_orderdate - INTERVAL 3 HOUR AS utc, strftime(o_orderdate, '%Y/%m/%d') AS text, epoch(o_orderdate) :: BIGINT AS seconds
FROM orders
""")
def fn_datetime_more(t):
    day = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.date_part(F.lit("month"), day).cast("bigint").alias("m"),
        F.extract(F.lit("week"), day).cast("bigint").alias("w"),
        (day + F.make_interval(months=F.lit(1), days=F.lit(2))).alias("shifted"),
        F.date_trunc("quarter", day).cast("timestamp_ntz").alias("quarter_start"),
        F.months_between(F.trunc(day, "month"), F.lit("1995-01-01").cast("date")).alias("months"),
        F.to_utc_timestamp(day.cast("timestamp"), "GMT+3").cast("timestamp_ntz").alias("utc"),
        F.date_format(day, "yyyy/MM/dd").alias("text"),
        F.unix_seconds(day.cast("timestamp")).alias("seconds"),
    )


@query("fn_json_schema", "SELECT 'OBJECT<k: BIGINT>' AS schema, count(*) AS n FROM events")
def fn_json_schema(t):
    """The schema that all messages have in common, and the number of messages that parse."""
    return json_schema(t.events, "props")


@query("fn_map_arrays", """
SELECT l_returnflag, sum(l_quantity) AS quantity, round(sum(l_tax), 4) AS tax, count(*) AS n FROM lineitem GROUP BY l_returnflag
""")
def fn_map_arrays(t):
    """Maps from arrays, turned into rows again."""
    pairs = F.map_from_arrays(
        F.array(F.lit("quantity"), F.lit("tax")), F.array(F.col("l_quantity"), F.col("l_tax"))
    )
    rows = t.lineitem.select("l_returnflag", F.explode(pairs))
    value = lambda k: F.sum(F.when(F.col("key") == k, F.col("value")))
    return rows.groupBy("l_returnflag").agg(
        value("quantity").alias("quantity"),
        F.round(value("tax"), 4).alias("tax"),
        F.count(F.when(F.col("key") == "tax", 1)).alias("n"),
    )
