"""Exact de-duplication as a stateful stream over digests, with disk-backed state and a check of the full bytes."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_UPPER, new_folder, stored

#: Settings of the stream: state in RocksDB on the executors' disks, its change log in the checkpoint folder.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text that equality is about: A-Z in lower case, all else as it is; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())


def _digests(size: int):
    schema = pa.schema([("id", pa.int64()), ("file", pa.string()), ("digest", pa.binary())])

    def run(batches):
        for b in batches:
            out = [hashlib.sha256((x.as_py() or b"").lower()).digest()[:size] for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], schema=schema)

    return run


def digest_table(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int = 32) -> DataFrame:
    """A stored table (id, file, digest, row): SHA-256 of each whole normalised text; row numbers the rows apart."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.input_file_name().alias("file"), F.col(text_col).cast("string").cast("binary").alias("text"))
    df = df.mapInArrow(_digests(digest_bytes), "id long, file string, digest binary")
    return stored(df.withColumn("row", F.monotonically_increasing_id()), "digests")


def stream_groups(spark: SparkSession, source: DataFrame, sink: str, checkpoint: str, trigger: dict) -> None:
    """Run the stateful query over a stream of (id, file, digest, row): the state holds, for each digest and without
    expiry, the identifier that stays, where its content lies, and the count so far. Each batch appends what changed to
    the sink. Spark sums rows by digest before they are shuffled, so a digest of many copies loads no single task.
    """
    state = source.groupBy("digest").agg(F.max(F.struct("id", "row", "file")).alias("keep"), F.count(F.lit(1)).alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure writes over its own folder
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(**trigger).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, max_bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """(id, digest, row, keep_id, keep_row, n) of every row: the row of its group of equal texts that stays, and the group's size.

    Texts are equal when their whole normalised bytes are; null counts as empty. The row with the largest id stays; of
    rows that repeat that id, one (null ids stay only where all of the group are null). Digests find candidate groups
    through the state; then rows of one digest are compared by their bytes, and those that only share a digest are grouped
    by them. An empty table gives an empty table. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    each = digest_table(docs, id_col, text_col, digest_bytes)
    folder = new_folder(spark, "exact-dedup")
    source = spark.readStream.schema(each.schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(each.inputFiles()[0].rsplit("/", 1)[0]) if each.head(1) else None
    if source is None:
        return each.select("id", "digest", "row", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n"))
    stream_groups(spark, source, f"{folder}/updates", f"{folder}/state", {"availableNow": True})
    # both columns only grow from batch to batch
    updates = spark.read.parquet(f"{folder}/updates")
    groups = stored(updates.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n")), "groups")

    # the check of the bytes: copies are put together before they are shuffled, so that a hot text is a row for each task
    whole = normalised(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.input_file_name().alias("f"), whole.alias("t"))
    texts = texts.withColumn("d", F.substring(F.unhex(F.sha2(F.col("t"), 256)), 1, digest_bytes))
    split = texts.groupBy("d", "t").count().groupBy("d").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("d")
    split = stored(split, "collisions")
    out = each.join(groups, "digest").select("id", "digest", "row", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "n")
    if not split.head(1):
        return out
    # rows that only share a digest are grouped by their bytes; rows that repeat an id within a file meet each other's
    # texts here, and the digest tells them apart
    found = each.join(split, F.col("digest") == F.col("d"), "left_semi")
    found = found.join(texts.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("file") == F.col("f")) & (F.col("digest") == F.col("d")))
    rest = stored(found.select("id", "row", "digest", "t").dropDuplicates(["row", "t"]), "hits")
    again = rest.groupBy("t").agg(F.max(F.struct("id", "row")).alias("keep"), F.countDistinct("row").alias("n"))
    rest = rest.join(again, "t")
    rest = rest.select("id", "digest", "row", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "n")
    return out.join(split, F.col("digest") == F.col("d"), "left_anti").unionByName(rest)


EXACT_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select doc_id, sha256(t) as text_sha256, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""
