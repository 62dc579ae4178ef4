"""Tables that a job writes for itself and reads again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder if Spark runs in one process, else
    ValueError: the executors of a cluster don't see each other's own folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark, "_tidemark_root", None)
        if root is None:
            root = spark._tidemark_root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it again: loops keep a short lineage, and lost executors cost no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, dealt: bool = False) -> DataFrame:
    """Like stored, in a file for each bucket of the keys: joins and groups by these keys read it without a shuffle.
    dealt: rows already lie in so many partitions by these keys."""
    spark = df.sparkSession
    path, table = new_folder(spark, name), f"tidemark_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)
