"""Delivery of Kafka rows to a consumer group: where it starts, resuming after a stop, and each row once in the result.

Rows have the columns of Spark's Kafka source, so a topic kept as files (an export, a replay) is read like one behind a
broker. A group is a folder: its checkpoint, the offsets where it began, and what it delivered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.batches import _files, read_batches, write_batch

#: The columns of Spark's Kafka source, without headers and the kind of timestamp.
KAFKA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
DELIVERED = "key string, value string, topic string, partition int, offset long, timestamp timestamp"


def as_kafka_rows(df: DataFrame, topic: str, partition, offset, key, value, timestamp=None) -> DataFrame:
    """Rows in Kafka's format from expressions; the time is now unless given."""
    t = F.current_timestamp() if timestamp is None else timestamp
    return df.select(key.cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit(topic).alias("topic"), partition.cast("int").alias("partition"), offset.cast("long").alias("offset"), t.alias("timestamp"))


def topic_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Kafka rows that a folder holds as Parquet."""
    return spark.readStream.schema(KAFKA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def texts_of(rows: DataFrame) -> DataFrame:
    """Kafka rows with key and value as text."""
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp")


def begin(rows: DataFrame, group: str, starting: str) -> DataFrame:
    """(topic, partition, from): the first offsets that a group gets, fixed when it first asks and read ever after.

    earliest: all rows; latest: those behind what the topic (rows, a batch) holds now. Partitions that come later start at
    their first row. A row a partition.
    """
    if starting not in ("earliest", "latest"):
        raise ValueError("a group starts at earliest or at latest")
    spark, path = rows.sparkSession, f"{group}/start"
    at, fs = _files(spark, f"{path}/_SUCCESS")
    if not fs.exists(at):
        held = rows.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("from"))
        (held if starting == "latest" else held.where("false")).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema("topic string, partition int, from long").parquet(path)


def consume(stream: DataFrame, group: str, start: DataFrame, handle: Callable[[DataFrame, int], None] | None = None) -> None:
    """Deliver all rows of a stream that the group has not got yet, at least once each; `delivered` makes that once.

    A batch's rows are written, then handle(rows, batch) is called, then the batch is marked and its offsets committed. A
    stop at any place between leads to the same batch again, which writes over its own folder.
    """
    spark = stream.sparkSession
    new = texts_of(stream).join(F.broadcast(start), ["topic", "partition"], "left").where("offset >= coalesce(from, 0)").drop("from")

    def save(df: DataFrame, batch: int) -> None:
        own = df.select("key", "value", "topic", "partition", "offset", "timestamp")
        own.write.mode("overwrite").parquet(f"{group}/rows/batch={batch}")
        if handle is not None:
            handle(spark.read.schema(DELIVERED).parquet(f"{group}/rows/batch={batch}"), batch)
        write_batch({"counts": df.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last"))}, group, batch)

    q = new.writeStream.option("checkpointLocation", f"{group}/checkpoint").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()


def delivered(spark: SparkSession, group: str) -> DataFrame:
    """What the group got: each (topic, partition, offset) once, though its producer or the stream sent it again."""
    return read_batches(spark, group, "rows", DELIVERED).dropDuplicates(["topic", "partition", "offset"])


def committed(spark: SparkSession, group: str) -> DataFrame:
    """(topic, partition, last): how far the group has come in each partition."""
    counts = read_batches(spark, group, "counts", "topic string, partition int, n long, last long")
    return counts.groupBy("topic", "partition").agg(F.max("last").alias("last"))
