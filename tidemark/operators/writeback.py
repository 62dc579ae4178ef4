"""Clusters written back to the graph: each run is a generation, which replaces the one before as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.vectors import near_clusters
from tidemark.sources.batches import _files, write_batch, written_batches

TABLES = {"clusters": "cluster_id long, name string, size long", "edges": "type string, src long, dst long, score double"}


def cluster_edges(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(type, src, dst, score): BELONGS_TO with score 1 of each row (id, cluster_id, vec) that is not noise, and NEAR_CLUSTER
    of rows to other clusters from `threshold` on."""
    own = rows.where("cluster_id <> -1").select(F.lit("BELONGS_TO").alias("type"), F.col("id").alias("src"), F.col("cluster_id").alias("dst"), F.lit(1.0).alias("score"))
    near = near_clusters(rows, threshold).select(F.lit("NEAR_CLUSTER").alias("type"), F.col("id").alias("src"), F.col("cluster_id").alias("dst"), "score")
    return own.unionByName(near)


def write_generation(folder: str, rows: DataFrame, names: DataFrame, threshold: float = 0.7) -> int:
    """Write the nodes and edges of a run, count them, and remove the runs before; the generation's number.

    rows: (id, cluster_id, vec); names: (cluster_id, name), where a cluster has one. Readers see the run before until this
    one is whole. RuntimeError, and the run before stays, if what stands in the tables is not what rows say.
    """
    spark = rows.sparkSession
    done = written_batches(spark, folder)
    number = max(done, default=-1) + 1
    sizes = rows.where("cluster_id <> -1").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    nodes = sizes.join(names, "cluster_id", "left").select("cluster_id", F.coalesce("name", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).alias("name"), "size")
    edges = cluster_edges(rows, threshold)

    def verify() -> None:
        written = {r["type"]: r["n"] for r in spark.read.parquet(f"{folder}/edges/batch={number}").groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
        want = rows.where("cluster_id <> -1").count()
        held = spark.read.parquet(f"{folder}/clusters/batch={number}").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if not written.get("BELONGS_TO", 0) == want == held:
            raise RuntimeError(f"{want} members, but {written.get('BELONGS_TO', 0)} BELONGS_TO edges and clusters of {held} together")

    write_batch({"clusters": nodes, "edges": edges}, folder, number, verify)
    for old in done:
        # marks first: a generation without its mark is invisible
        for path in (f"{folder}/marks/{old}", *(f"{folder}/{t}/batch={old}" for t in TABLES)):
            at, fs = _files(spark, path)
            fs.delete(at, True)
    return number


def read_generation(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of `clusters` or `edges` of the last whole generation; none yet: no rows."""
    done = written_batches(spark, folder)
    if not done:
        return spark.createDataFrame([], TABLES[table])
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}/batch={done[-1]}")
