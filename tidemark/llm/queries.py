"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import centroids, ctph, exact_dedup, language_id, mixing, packing, passages, quality, runs, sanitise, simhash, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"), with_spans=False)
    return found.withColumnRenamed("id", "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumnRenamed("id", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumnRenamed("id", "doc_id")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprint_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    kept = F.col("row") == F.col("keep_row")
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered_vectors(table(spark, sf_dir, "embeddings"))
    written = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(written, 256).alias("centroid_sha256"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.with_loops(table(spark, sf_dir, "documents")), "id", "text")
    return runs.run_digests(found).withColumnRenamed("id", "doc_id")


def op13_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.span_digests(sanitise.sanitised_spans(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


_ALL = (op1_language_id, op2_quality, op3_toxicity, op4_fingerprints, op5_simhash, op6_packing, op7_exact_dedup, op8_mixing, op9_url_filter, op10_passages, op11_centroids, op12_runs, op13_sanitise)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op7_exact_dedup": exact_dedup.EXACT_SQL, "op8_mixing": mixing.MIX_SQL, "op11_centroids": centroids.CENTROIDS_SQL, "op13_sanitise": sanitise.SANITISE_SQL}
