"""Tables that a stream writes batch by batch: all tables of a batch become visible together, and only once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_batch(tables: dict[str, DataFrame], folder: str, batch: int, verify: Callable[[], None] | None = None) -> None:
    """Write each table to folder/name/batch=N and, last, the batch's mark. A batch that died before its mark is invisible;
    when it is run again, it writes over what it left. verify() may look at the tables and raise before the mark."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    if verify is not None:
        verify()
    mark, fs = _files(next(iter(tables.values())).sparkSession, f"{folder}/marks/{batch}")
    fs.create(mark, True).close()


def written_batches(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the batches that are whole."""
    at, fs = _files(spark, f"{folder}/marks")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []


def read_batches(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The rows of a table in all whole batches, with `batch`; no batch: no rows."""
    done = written_batches(spark, folder)
    if not done:
        return spark.createDataFrame([], f"{schema}, batch int")
    reader = spark.read.schema(f"{schema}, batch int").option("basePath", f"{folder}/{name}")
    return reader.parquet(*[f"{folder}/{name}/batch={b}" for b in done])
