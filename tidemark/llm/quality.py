"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordTable, crc_mod, once, slices
from tidemark.llm.models import fitted, labelled_sample, sigmoid

#: Labelled rows that the fit reads at most, hash buckets as a power of two, and the scale of n-gram frequencies.
FIT_ROWS, BITS, SCALE = 6000, 18, 10.0
#: Step size, its damping, and the two penalties of the updates; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.002, 0.002, 3
TOKEN = re.compile(r"\w+|[^\w\s]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - BITS)


def _shape(token: str) -> str:
    """What a token looks like: punctuation as it is, words by their case and whether they hold digits."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:4]
    if any(c.isdigit() for c in token):
        return "0" if token.isdigit() else "a0"
    return "AA" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"


def _hashes(words: list[str]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([(h(w.lower().encode("utf-8", "surrogatepass")), h(_shape(w))) for w in words], dtype=np.uint64)


def _table() -> WordTable:
    return once(("quality",), lambda: WordTable(_hashes, 2, np.uint64))


def ngrams(texts: list[str], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, a row for each of their kinds, and the number of tokens of each text.

    Kinds: one and two words; one, two and three token shapes, in which a token that repeats the one before is marked.
    """
    tokens: list[str] = []
    lens = np.zeros(len(texts), np.int64)
    for i, x in enumerate(texts):
        got = TOKEN.findall(x)
        lens[i] = len(got)
        tokens += got
    if not tokens:
        return np.zeros((5, 0), np.int64), lens
    rows = table.lookup(tokens)
    word, shape = table.data[rows, 0], table.data[rows, 1]
    first = np.zeros(len(tokens), bool)
    first[(np.cumsum(lens) - lens)[lens > 0]] = True
    before = np.where(first, _C, np.concatenate([word[:1], word[:-1]]))
    shape = shape + _C * ((before == word) & ~first).astype(np.uint64)
    s1 = np.where(first, _C, np.concatenate([shape[:1], shape[:-1]]))
    s2 = np.where(first, _C, np.concatenate([s1[:1], s1[:-1]]))
    kinds = (word * _A, (before * _B + word) * _A, (shape + _B) * _A, (s1 * _B + shape + _A) * _A, ((s2 * _C + s1) * _B + shape) * _A)
    return np.stack([((k ^ (k >> np.uint64(31))) * _B >> _SHIFT).astype(np.int64) for k in kinds]), lens


def fit_ftrl(texts: list[str], labels: list[int]) -> dict[str, np.ndarray]:
    """Weights (the last one is the bias) by FTRL-proximal, one document after the other."""
    table = WordTable(_hashes, 2, np.uint64)
    n = (1 << BITS) + 1
    z, square = np.zeros(n), np.zeros(n)
    rows = []
    for s, e in slices(texts):
        buckets, lens = ngrams(texts[s:e], table)
        ends = np.cumsum(lens)
        for k, y in enumerate(labels[s:e]):
            at, count = np.unique(buckets[:, ends[k] - lens[k] : ends[k]], return_counts=True)
            rows.append((np.append(at, n - 1), np.append(count * (SCALE / max(1, lens[k])), 1.0), y))
        table.trim()

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(square[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) > L1, w, 0.0)

    for _ in range(PASSES):
        for at, x, y in rows:
            w = weights(at)
            g = (sigmoid(float(w @ x)) - y) * x
            more = square[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(square[at])) / ALPHA * w
            square[at] = more
    return {"weights": weights(np.arange(n)).astype(np.float32)}


def score_texts(texts: list[str], weights: np.ndarray, table: WordTable) -> np.ndarray:
    """Sparse dot products: the mean weight of a text's n-grams, times SCALE, through the logistic function."""
    buckets, lens = ngrams(texts, table)
    total = np.concatenate([[0.0], np.cumsum(weights[buckets].sum(axis=0, dtype=np.float64))])
    ends = np.cumsum(lens)
    return sigmoid(weights[-1] + SCALE * (total[ends] - total[ends - lens]) / np.maximum(lens, 1))


def score_column(docs: DataFrame, text_col: str, weights: np.ndarray, name: str = "score") -> DataFrame:
    """docs with its columns as they are and one more for the score. The name must not be one of docs' own."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index(text_col)

    def run(batches):
        table = _table()
        for batch in batches:
            texts = [x or "" for x in batch.column(place).cast(pa.string()).to_pylist()]
            out = np.zeros(len(texts))
            for s, e in slices(texts):
                out[s:e] = score_texts(texts[s:e], shared.value, table)
                table.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights from at most fit_rows labelled rows, those with crc32(id as text) mod 5 = 0 held out."""
    known = labels.where(crc_mod(id_col, 5) != 0)
    return fitted(labelled_sample(docs, known, id_col, text_col, label_col, fit_rows), fit_ftrl)["weights"]


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) of every row; score is the likelihood of label 1, predicted 1 from threshold on.

    Only the text decides a score: equal texts get equal ones. Null or empty texts get the bias alone. Rows with a null
    id are scored like any other. Without labels all scores are 0.5. An empty table gives an empty table. Other columns
    of docs are not read.
    """
    weights = fit_quality(docs, labels, id_col, text_col, label_col, fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = score_column(rows, "text", weights)
    return scored.select("id", (crc_mod("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
