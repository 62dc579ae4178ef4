"""Streams of posts, searches and visits: parse, extract, merge into tables, count and drop repeats.

Each function takes a streaming (or batch) DataFrame and gives one; `run_once` drives a query over what there is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidemark.functions import spans
from tidemark.functions.vectors import unit
from tidemark.sources.shared import new_folder

ENVELOPE = "message_type string, source_platform string, crawled_at timestamp, data struct<title: string, content: string, source_url: string, skills: array<string>>"


def kafka_source(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """The values of a Kafka topic as text; needs the connector on the class path."""
    s = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    return s.load().select(F.col("value").cast("string").alias("value"))


def kafka_rows(df: DataFrame, url: str) -> DataFrame:
    """(key, value) for a Kafka sink: the MD5 of the URL and all columns as JSON."""
    return df.select(F.md5(F.col(url).cast("binary")).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def parsed(raw: DataFrame) -> DataFrame:
    """raw (value) with the envelope's fields, and bad: true where it isn't one."""
    e = F.from_json("value", ENVELOPE)
    df = raw.withColumn("e", e)
    bad = F.col("e").isNull() | F.col("e.message_type").isNull() | F.col("e.data").isNull()
    return df.select("value", bad.alias("bad"), "e.message_type", "e.source_platform", "e.crawled_at", "e.data.title", "e.data.content", "e.data.source_url", "e.data.skills")


def extracted(raw: DataFrame, tech_terms, role_terms, places) -> DataFrame:
    """Well-formed messages with the entities of title and content; given skills join the techs."""
    df = parsed(raw).where("not bad").drop("value", "bad")
    df = spans.extract(df, F.concat_ws(" ", "title", "content"), tech_terms, role_terms, places)
    return df.withColumn("techs", F.array_union("techs", F.coalesce("skills", F.array().cast("array<string>"))))


def vectors_of(df: DataFrame, dim: int = 64) -> DataFrame:
    """(source_url, embedding): hashed words of title and content, of length 1; blank texts are zeros."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "title", "content")), r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    # sorted, with each place once more before its words: a count is the way from one place to the next
    marks = F.sequence(F.lit(0).cast("long"), F.lit(dim).cast("long"))
    df = df.select("source_url", F.sort_array(F.concat(hashed, marks)).alias("at"))
    first = [F.array_position("at", F.lit(i).cast("long")) for i in range(dim + 1)]
    counts = F.array(*[(b - a - 1).cast("double") for a, b in zip(first[:-1], first[1:])])
    return df.select("source_url", unit(counts).alias("embedding"))


def unique_visits(visits: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, ip) once each; state is kept for `late` behind the newest event."""
    v = visits.withColumn("day", F.to_date("ts"))
    if v.isStreaming:
        return v.withWatermark("ts", late).dropDuplicatesWithinWatermark(["day", "ip"]).select("day", "ip")
    return v.select("day", "ip").distinct()


def daily_keywords(searches: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, keyword, searches) in tumbling windows of a day."""
    s = searches.withWatermark("ts", late) if searches.isStreaming else searches
    return s.groupBy(F.window("ts", "1 day").alias("w"), "keyword").agg(F.count(F.lit(1)).alias("searches")).select(F.to_date("w.start").alias("day"), "keyword", "searches")


def mention_counts(mentions: DataFrame) -> DataFrame:
    """(name, mentions): a running count by name; messages are made unique before they get here."""
    return mentions.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source holds now; the rows it gave, as a table in the shared folder, with the batch.

    A batch that is run again after a failure writes over its own folder, so nothing counts twice.
    """
    folder = new_folder(stream.sparkSession, "stream")
    return run_into(stream, mode, folder, lambda df, b: df.write.mode("overwrite").parquet(f"{folder}/rows/batch={b}"))


def run_into(stream: DataFrame, mode: str, folder: str, save: Callable[[DataFrame, int], None]) -> DataFrame:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema.add("batch", IntegerType())).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
