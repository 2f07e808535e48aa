"""JSON messages as files: key, topic, headers and value, one folder per topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..streaming.run import each_batch

MESSAGE = "key string, headers map<string, string>, value string"


def as_messages(df: DataFrame, topic: Column, key: Column, data: list[str], attributes: dict[str, Column], mode: str = "binary") -> DataFrame:
    """(topic, key, headers, value) of each row.

    `binary`: the value is the data as JSON and the attributes are headers. `structured`: the value is the whole
    envelope, the attributes and under `data` the data; the header tells so. NULL fields are left out of the JSON,
    as are attributes without a value.
    """
    if mode not in ("binary", "structured"):
        raise ValueError(f"no content mode {mode}")
    body = F.struct(*(F.col(c) for c in data))
    texts = {name: value.cast("string") for name, value in attributes.items()}
    if mode == "structured":
        value = F.to_json(F.struct(*(v.alias(n) for n, v in texts.items()), body.alias("data")))
        headers = F.create_map(F.lit("content-type"), F.lit("application/cloudevents+json"))
    else:
        value = F.to_json(body)
        known = F.create_map(*(x for n, v in texts.items() for x in (F.lit(f"ce_{n}"), v)))
        typed = F.create_map(F.lit("content-type"), F.lit("application/json"))
        headers = F.map_concat(typed, F.map_filter(known, lambda _, v: v.isNotNull())) if texts else typed
    return df.select(topic.cast("string").alias("topic"), key.cast("string").alias("key"), headers.alias("headers"), value.alias("value"))


def send_messages(messages: DataFrame, label: str, out: str | None = None) -> str:
    """Write a stream of messages; a batch that is replayed writes over its own files. Returns the folder.

    Messages without a topic go to the topic `unrouted`. With the folder of an earlier run, that run is continued.
    """
    routed = messages.withColumn("topic", F.coalesce("topic", F.lit("unrouted")))

    def write(batch: DataFrame, batch_id: int, folder: str) -> None:
        batch.write.mode("overwrite").partitionBy("topic").json(f"{folder}/messages/batch={batch_id}")

    return each_batch(routed, label, write, out=out)


def read_messages(spark: SparkSession, out: str, topics: list[str] | None = None) -> DataFrame:
    """Messages of some topics, or of all: batch, topic, key, headers, value. Folders of other topics are not read."""
    rows = spark.read.schema(f"{MESSAGE}, batch bigint, topic string").json(f"{out}/messages")
    return rows if topics is None else rows.filter(F.col("topic").isin(topics))


def subscribe(spark: SparkSession, out: str, topics: list[str], **options: str | int) -> DataFrame:
    """A stream of the messages of some topics, for a job that follows the one that sends them."""
    rows = spark.readStream.schema(f"{MESSAGE}, batch bigint, topic string").options(**options).json(f"{out}/messages")
    return rows.filter(F.col("topic").isin(topics))
