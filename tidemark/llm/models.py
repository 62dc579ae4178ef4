"""How the text classifiers are fitted and applied: a fit reads a bounded sample in one task, a score runs everywhere."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_sample


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, balanced: bool = False) -> DataFrame:
    """(id, text, label) of at most `rows` labelled documents, by hash; balanced: half of them of each label, as far as there are.

    Labels that are null, and ids that are null or have two different labels, are left out. The ids are a bounded
    sample and so are broadcast: no text is shuffled before it is chosen.
    """
    one = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    one = one.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").drop("top")
    if balanced:
        some = hashed_sample(one.where("label = 1"), "id", rows // 2).unionByName(hashed_sample(one.where("label = 0"), "id", rows // 2))
    else:
        some = hashed_sample(one, "id", rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(some), "id")


def fitted(sample: DataFrame, fit: Callable[[list, list], dict]) -> dict[str, np.ndarray]:
    """fit(texts, labels) on a bounded sample (id, text, label), in one task and in the order of the ids' hashes."""

    def run(batches):
        table = pa.Table.from_batches(list(batches))
        texts, labels = ([], []) if not table.num_columns else ([x or "" for x in table.column(0).to_pylist()], table.column(1).to_pylist())
        buffer = io.BytesIO()
        np.savez_compressed(buffer, **fit(texts, labels))
        yield pa.RecordBatch.from_arrays([pa.array([buffer.getvalue()], pa.binary())], names=["model"])

    one = sample.select("text", "label", F.xxhash64("id").alias("h")).repartition(1).sortWithinPartitions("h", "text").select("text", "label")
    rows = one.mapInArrow(run, "model binary").collect()
    if not rows:  # no rows reached the task
        buffer = io.BytesIO()
        np.savez_compressed(buffer, **fit([], []))
        rows = [(buffer.getvalue(),)]
    with np.load(io.BytesIO(rows[0][0])) as got:
        return dict(got)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
