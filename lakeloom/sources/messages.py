"""JSON messages: parsing, dead letters, object notifications, ingest requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.fixed import DEFAULT_TABLE

# Shape of an object-store notification message.
NOTIFICATION = (
    "Records array<struct<eventName: string, s3: struct<"
    "bucket: struct<name: string>, object: struct<key: string, size: bigint, "
    "metadata: map<string, string>, tags: map<string, string>>>>>"
)

# Shape of an ingest request message.
INGEST_REQUEST = "files array<string>, table string, total_bytes bigint, file_count int, timestamp string"


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], start: str = "latest", **options: str):
    """Topic messages as (topic, partition, offset, key, value, timestamp).

    Needs the Kafka connector on the class path.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", ",".join(topics)).option("startingOffsets", start)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "timestamp",
    )


def parse_json(df: DataFrame, schema: T.StructType | str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(parsed rows, dead letters). Works on streams and tables alike.

    Parsed rows keep the other columns and gain the fields of `schema`; a dead letter
    is a message that is absent or is not JSON of that shape.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    corrupt = "_corrupt"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    # Behind the generator the parse result is a plain column: a filter on it cannot be
    # pushed down as a second parse of the same text.
    read = df.withColumn("_parsed", F.explode(F.array(F.from_json(column, full, options))))
    broken = F.col("_parsed").isNull() | F.col(f"_parsed.{corrupt}").isNotNull()
    rest = [c for c in df.columns if c != column]
    good = read.filter(~broken).select(*rest, *[F.col(f"_parsed.{f}").alias(f) for f in schema.fieldNames()])
    return good, read.filter(broken).drop("_parsed")


def explode_notifications(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(one row per changed object, dead letters)."""
    good, dead = parse_json(df, NOTIFICATION, column)
    rest = [c for c in good.columns if c != "Records"]
    rows = good.select(*rest, F.explode("Records").alias("r")).select(
        *rest,
        F.col("r.eventName").alias("event_name"),
        F.col("r.s3.bucket.name").alias("bucket"),
        F.col("r.s3.object.key").alias("key"),
        F.col("r.s3.object.size").alias("size"),
        F.col("r.s3.object.metadata").alias("metadata"),
        F.col("r.s3.object.tags").alias("tags"),
    )
    return rows, dead


def parse_requests(df: DataFrame, column: str = "value", default_table: str = DEFAULT_TABLE):
    """(one row per requested file: table, file; dead letters).

    A request must list files; without a table it goes to the default one.
    """
    good, dead = parse_json(df, INGEST_REQUEST, column)
    complete = F.coalesce(F.size("files") > 0, F.lit(False))
    files = good.filter(complete).select(
        F.coalesce("table", F.lit(default_table)).alias("table"), F.explode("files").alias("file")
    )
    return files, dead, good.filter(~complete)
