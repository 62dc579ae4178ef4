"""Retrieval for a table of questions: word-overlap ranking, threshold with fallback, and context text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions.text import clipped


#: Questions whose words a task holds at once; more are worked on block by block.
BLOCK = 2048
#: Documents that a task counts together.
STEP = 256


def words(text_col: str) -> Column:
    """The distinct lower-case words of a text; none of a null one."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def overlap_scores(queries: DataFrame, docs: DataFrame, least: float = 0.0, k: int | None = None) -> DataFrame:
    """(query_id, id, score): the share of a question's distinct words that a document holds, where it is above 0 and not
    below `least`; with k only the k best documents of each question, ties by id.

    All words count, however many documents hold them. Questions are a request's rows: they are dealt to blocks of about
    BLOCK by hash, and each task counts a block's words in its own documents, so no word brings its documents together, and
    with k at most tasks x k rows a question are shuffled. Questions of one id are taken as one; rows of documents that
    repeat an id are scored each by itself; rows without an id, and questions without a word, have no score.
    """
    asked = queries.where("id is not null").select("id", words("text").alias("words")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    asked = asked.where(F.size("words") > 0)
    blocks = -(-asked.count() // BLOCK)
    texts = docs.where("id is not null").select("id", words("text").alias("words"))
    shape = StructType([StructField("query_id", queries.schema["id"].dataType), StructField("id", docs.schema["id"].dataType), StructField("hits", LongType()), StructField("size", LongType())])
    out = docs.sparkSession.createDataFrame([], shape)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()  # about BLOCK questions
        if not block.empty:
            out = out.unionByName(texts.mapInPandas(_counter(block, least, k), shape))
    scores = out.select("query_id", "id", F.round(F.col("hits") / F.col("size"), 6).alias("score")).where(F.col("score") >= least)
    if k is None:
        return scores
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _counter(block: pd.DataFrame, least: float, k: int | None):
    """A function over batches of documents (id, words): rows of shared words with the questions of a block."""
    qid, size = block["id"].to_numpy(), block["words"].map(len).to_numpy()
    holders: dict[str, list[int]] = {}
    for i, ws in enumerate(block["words"]):
        for w in ws:
            holders.setdefault(w, []).append(i)
    # a little below the least score, which is compared once more when it has been rounded
    floor = np.maximum(size * (least - 1e-5), 1)

    def rows(hits: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        q, d = np.nonzero(hits >= floor[:, None])
        return pd.DataFrame({"query_id": qid[q], "id": ids[q, d], "hits": hits[q, d], "size": size[q]})

    def count(batches):
        lists = {w: np.array(at) for w, at in holders.items()}
        best = None
        for pdf in batches:
            for s in range(0, len(pdf), STEP):
                part = pdf.iloc[s : s + STEP]
                found = [[lists[w] for w in ws if w in lists] for ws in part["words"]]
                hits = np.stack([np.bincount(np.concatenate(f), minlength=len(qid)) if f else np.zeros(len(qid), np.int64) for f in found], axis=1)
                ids = np.broadcast_to(part["id"].to_numpy(), hits.shape)
                if k is None:
                    yield rows(hits, ids)
                    continue
                if best is not None:
                    hits, ids = np.hstack([best[0], hits]), np.hstack([best[1], ids])
                top = np.lexsort((ids, -hits), axis=1)[:, :k]
                best = np.take_along_axis(hits, top, 1), np.take_along_axis(ids, top, 1)
        if best is not None:
            yield rows(*best)

    return count


def rerank(scores: DataFrame, threshold: float = 0.4, k: int = 5, fallback: int = 3) -> DataFrame:
    """(query_id, id, score, rank, low_confidence): the k best above the threshold; a question without any gets its best
    `fallback` ones, marked."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = F.max("score").over(W.partitionBy("query_id"))
    df = scores.withColumns({"rank": F.row_number().over(order), "low_confidence": best < threshold})
    good = ~F.col("low_confidence") & (F.col("score") >= threshold) & (F.col("rank") <= k)
    return df.where(good | (F.col("low_confidence") & (F.col("rank") <= fallback))).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"), "low_confidence")


def context(ranked: DataFrame, docs: DataFrame, chars: int = 800) -> DataFrame:
    """(query_id, context): numbered blocks of the ranked documents' titles and clipped texts."""
    d = docs.select("id", "title", "text")
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), clipped("text", chars))
    j = ranked.join(d, "id").select("query_id", F.struct("rank", block.alias("b")).alias("x"))
    return j.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("context"))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row over a log (answered boolean, seconds, score): share answered and means."""
    return runs.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("answered").cast("int")), 6).alias("answered_rate"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.avg("score"), 6).alias("mean_score"))
