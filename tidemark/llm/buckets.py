"""Links inside buckets of candidates, for joins by blocks or bands.

A bucket holds the rows that share a key. Its links are cut down to a spanning forest before they leave the task, so a
bucket of n rows gives at most n - 1 edges whatever its shape. A bucket beyond `limit` rows is not worked on in one
task: it is dealt out again as pairs of chunks, which compare the same rows in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

Linker = Callable[[np.ndarray, list], list]
OUT = "src long, dst long, hot_key long, hot_rows long"
_SCHEMA = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("hot_key", pa.int64()), ("hot_rows", pa.int64())])


def _runs(batches: Iterator[pa.RecordBatch], limit: int):
    """(key, row count, ids, payload) of each key with two rows or more; ids are None beyond the limit.

    Batches arrive sorted by key; one bucket of at most `limit` rows is held at a time.
    """
    held: tuple | None = None  # key, rows, list of id parts, list of payload parts
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        ids, load = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        cut = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        last = len(starts) - 1
        # single rows in the middle of a batch are alone for certain
        for k in np.flatnonzero((ends - starts > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)):
            s, e, key = int(starts[k]), int(ends[k]), int(keys[starts[k]])
            if held is not None and held[0] != key:
                if held[1] > 1:
                    yield held
                held = None
            if held is None:
                held = (key, 0, [], [])
            rows = held[1] + e - s
            if rows > limit:
                held = (key, rows, None, None)
            else:
                held[2].append(ids[s:e])
                held[3].append(load.slice(s, e - s))
                held = (key, rows, held[2], held[3])
    if held is not None and held[1] > 1:
        yield held


def _forest(link: Linker, limit: int):
    def run(batches):
        src, dst, hot, rows = [], [], [], []
        for key, n, ids, load in _runs(batches, limit):
            if ids is None:
                hot.append(key)
                rows.append(n)
            else:
                parts = np.concatenate(ids)
                for i, j in link(parts, load):
                    src.append(int(parts[i]))
                    dst.append(int(parts[j]))
            if len(src) + len(hot) > 50_000:
                yield _out(src, dst, hot, rows)
                src, dst, hot, rows = [], [], [], []
        yield _out(src, dst, hot, rows)

    return run


def _out(src, dst, hot, rows):
    none, nil = [None] * len(hot), [None] * len(src)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (src + none, dst + none, nil + hot, nil + rows)], schema=_SCHEMA)


def bucket_links(rows: DataFrame, link: Linker, limit: int = 20_000, name: str = "links") -> DataFrame:
    """Edges (src, dst) that `link` finds within each bucket of rows (key long, id long, payload).

    link(ids, payload parts) gives index pairs that span each bucket's components. Buckets beyond `limit` rows come back
    as markers; their rows are dealt to pairs of chunks, so that every two of them still meet once. No rows: no edges.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.toDF("key", "id", "payload")
    found = stored(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_forest(link, limit), OUT), name)
    edges = found.where("src is not null").select("src", "dst")
    hot = found.where("hot_key is not null").select(F.col("hot_key").alias("key"), F.ceil(F.col("hot_rows") / F.lit(limit / 2)).cast("long").alias("chunks"))
    if not hot.head(1):
        return edges
    dealt = rows.join(hot, "key").withColumn("c", F.pmod(F.xxhash64("id"), "chunks"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pair = F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o"))
    dealt = dealt.select(pair.alias("key"), "id", "payload").distinct()
    more = dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_forest(link, 1 << 40), OUT)
    return edges.unionByName(stored(more.select("src", "dst"), name + "-hot"))
