"""Stages of corpus_pipeline.py. Each takes (spark, docs, sf_dir); all but the last return docs' own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, mixing, packing, quality, simhash
from tidemark.llm.common import stored

#: Documents scored below this are rejected.
LEAST_QUALITY = 0.3


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects. A rejected text is one scored below LEAST_QUALITY.

    Rows with a null id, and rows that repeat one, are judged by their own text; null texts as empty ones. Without labels
    every text has a score of 0.5 and stays. No rows: no rows.
    """
    weights = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free(docs, "_score")
    return quality.score_column(docs, "text", weights, score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose id is in `kept` (id); of rows that repeat an id, all. Sorted and merged at any size: the ids grow
    with the input."""
    name = _free(docs, "_kept_id")
    return docs.hint("merge").join(kept.withColumnRenamed("id", name), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the largest id.

    Where ids repeat, rows are told apart by their normalised text, and of those equal in both one stays. Null texts are
    equal to empty ones; a null id stays only where all ids of its group are null. No rows: no rows.
    """
    found = stored(exact_dedup.exact_groups(docs), "exact")
    kept = found.where("row = keep_row")
    if not found.groupBy("id").count().where("count > 1").head(1):
        return _keep(docs, kept.select("id"))
    digest, i, d = (_free(docs, x) for x in ("_digest", "_i", "_d"))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(digest) == F.col(d))
    left = docs.withColumn(digest, F.unhex(F.sha2(exact_dedup.normalised(F.col("text")), 256)))
    left = left.join(kept.select(F.col("id").alias(i), F.col("digest").alias(d)), same, "left_semi")
    return left.dropDuplicates(["doc_id", digest]).drop(digest)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints stays, that with the smallest id. Null ids stay; where that
    id repeats, all its rows do. Null and empty texts are near-equal to each other. No rows: no rows."""
    found = simhash.simhash_components(docs)
    return _keep(docs, found.where("id is null or id = component_id").select("id").distinct())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or a few times. Rows that repeat an id, null ones too,
    are told apart by source and text, and of those equal in all three each counts: together they are taken as often as the
    mix takes them, so it keeps its budget. Texts without words, null ones too, are never taken. No rows: no rows."""
    key, i, n, copy, r = (_free(docs, x) for x in ("_key", "_i", "_n", "_copy", "_repeated"))
    again = stored(docs.groupBy(F.col("doc_id").alias(r)).count().where("count > 1").select(r, F.lit(True).alias(n)), "repeated")
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    if again.head(1):
        docs = docs.join(again, F.col("doc_id").eqNullSafe(F.col(r)), "left")
        told = F.concat_ws(":", own, F.sha2(F.concat_ws("\0", F.coalesce("source", F.lit("\1")), F.coalesce("text", F.lit(""))), 256))
        docs = docs.withColumn(key, F.when(F.col(n), told).otherwise(own)).drop(r, n)
    else:
        docs = docs.withColumn(key, own)
    taken = mixing.mix(docs, key).groupBy(F.col("id").alias(i)).agg(F.sum("copies").cast("int").alias(n))
    one = docs.dropDuplicates([key]) if again.head(1) else docs
    mixed = one.hint("merge").join(taken.where(F.col(n) > 0), F.col(key) == F.col(i))
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(key, i, n, copy)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences. Null texts are empty; each row is packed, whether
    its id is null or repeats or not. No rows: no rows."""
    return packing.pack_documents(docs).withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})
