"""A caller's model over windows of texts: scored in Arrow batches, merged where windows overlap, failures counted.

A model is anything callable with a window's words that gives spans (begin, end, label, score), places counted in words of
the window. `load` makes it; it runs once in each Python worker, where the model is held under its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

Model = Callable[[list[str]], Iterable[tuple[int, int, str, float]]]
_SPAN = pa.struct([("start", pa.int64()), ("words", pa.list_(pa.string())), ("label", pa.string()), ("score", pa.float64()), ("edge", pa.bool_())])
_SCORED = pa.schema([("id", pa.int64()), ("chunk", pa.int64()), ("failed", pa.string()), ("spans", pa.list_(_SPAN))])
SCORED = "id long, chunk long, failed string, spans array<struct<start: long, words: array<string>, label: string, score: double, edge: boolean>>"
_models: dict[str, Model] = {}


def word_windows(df: DataFrame, id_col: str, text_col: str, size: int = 480, overlap: int = 50) -> DataFrame:
    """(id, chunk, start, text): windows of `size` white-space words, joined by spaces, each beginning `overlap` words before the end of the
    one before; the last ends with the text. Null and blank texts have none. A text's windows are rows of their own, so a
    long text is not scored by one task alone."""
    if not 0 <= overlap < size:
        raise ValueError("windows must be longer than their overlap")
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "")
    step = size - overlap
    each = df.select(F.col(id_col).cast("long").alias("id"), words.alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.ceil((F.size("all") - size) / step), F.lit(0)).cast("long")
    cut = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.array_join(F.slice("all", (i * step + 1).cast("int"), F.lit(size)), " "))
    each = each.select("id", F.posexplode(cut).alias("chunk", "text"))
    return each.select("id", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * step).cast("long").alias("start"), "text")


def _whole(spans: Iterable, n: int) -> list[tuple[int, int, str, float]]:
    """The well-formed spans of a window of n words; those of one label that share words are one."""
    good = sorted((str(label).upper(), b, e, float(score)) for b, e, label, score in spans if label and score is not None and 0 <= b < e <= n)
    out: list[tuple[int, int, str, float]] = []
    for label, b, e, score in good:
        if out and out[-1][2] == label and b < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), label, max(score, out[-1][3]))
        else:
            out.append((b, e, label, score))
    return out


def _score(load: Callable[[], Model], name: str, overlap: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            if name not in _models:
                _models.clear()
                _models[name] = load()  # a model that can't be loaded fails the task, not the rows
            model = _models[name]
            failed, spans = [], []
            for start, text in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist()):
                words = text.split(" ")
                try:
                    found = _whole(model(words), len(words))
                    inner = range(overlap if start else 0, len(words) - overlap + 1)
                    spans.append([{"start": start + b, "words": words[b:e], "label": label, "score": score, "edge": b not in inner or e not in inner} for b, e, label, score in found])
                    failed.append(None)
                except Exception as e:  # noqa: BLE001  the window is lost, its text's other windows stay
                    spans.append([])
                    failed.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("chunk"), pa.array(failed, pa.string()), pa.array(spans, _SCORED.field("spans").type)], schema=_SCORED)

    return run


def scored_windows(windows: DataFrame, load: Callable[[], Model], name: str, overlap: int = 50) -> DataFrame:
    """(id, chunk, failed, spans) of each window: what the model finds, places counted in the whole text, and whether a span
    reaches into the words that the window shares with others (`overlap`, as they were cut with). `failed` says why where
    the model raised. Spans without a label or score, or outside their window, are dropped."""
    return windows.mapInArrow(_score(load, name, overlap), SCORED)


def merged_entities(scored: DataFrame) -> DataFrame:
    """(id, label, start, words, score): spans of one label that share words, as they do where windows overlap, are one,
    with the best score and all their words. Spans that only touch stay apart. Only those at the edges of windows are
    shuffled; the others are whole."""
    found = scored.select("id", F.explode("spans").alias("s")).select("id", "s.label", "s.start", "s.words", "s.score", "s.edge")
    inner = found.where(~F.col("edge")).select("id", "label", "start", "words", F.round("score", 2).alias("score"))
    each = found.where("edge")
    each = each.withColumn("end", F.col("start") + F.size("words"))
    order = W.partitionBy("id", "label").orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    each = each.withColumn("reach", reach).withColumn("first", F.coalesce((F.col("start") >= F.col("reach")).cast("int"), F.lit(1)))
    each = each.withColumn("entity", F.sum("first").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # pieces that lie inside another add no words; those left follow each other
    adds = F.coalesce(F.col("end") > F.col("reach"), F.lit(True)) | (F.col("first") == 1)
    piece = F.when(adds, F.struct("start", "words"))
    whole = each.groupBy("id", "label", "entity").agg(F.min("start").alias("start"), F.max("score").alias("score"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    joined = F.aggregate(
        "pieces",
        F.array().cast("array<string>"),
        lambda acc, p: F.concat(acc, F.slice(p.words, (F.col("start") + F.size(acc) - p.start + 1).cast("int"), F.greatest(F.size(p.words) - (F.col("start") + F.size(acc) - p.start).cast("int"), F.lit(0)))),
    )
    return inner.unionByName(whole.select("id", "label", "start", joined.alias("words"), F.round("score", 2).alias("score")))


def model_entities(df: DataFrame, load: Callable[[], Model], name: str, id_col: str = "id", text_col: str = "text", size: int = 480, overlap: int = 50, least_words: int = 1) -> DataFrame:
    """(id, entities, chunks, failed) of every different id of df: a model's entities of its text, the number of windows
    and how many of them the model failed on.

    entities: array of (label, entity, start, score) in the order of their place; of those that are equal by label and
    lower-case text the first stays. Entities of fewer than `least_words` words are left out after windows are merged.
    Blank and null texts have none and no window. A text whose windows all failed keeps its row. Rows with a null id are
    one text after another under that id; an empty table gives an empty table.
    """
    scored = stored(scored_windows(word_windows(df, id_col, text_col, size, overlap), load, name, overlap), "scored")
    counts = scored.groupBy("id").agg(F.count(F.lit(1)).alias("chunks"), F.count("failed").alias("failed"))
    found = merged_entities(scored).where(F.size("words") >= least_words).withColumn("entity", F.array_join("words", " "))
    found = found.groupBy("id", "label", F.lower("entity").alias("key")).agg(F.min_by(F.struct("start", "entity", "score"), "start").alias("e"))
    found = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("e.start", "label", "e.entity", "e.score"))).alias("x"))
    entities = F.transform("x", lambda x: F.struct(x.label.alias("label"), x.entity.alias("entity"), x.start.alias("start"), x.score.alias("score")))
    found = found.select(F.col("id").alias("i"), entities.alias("entities"))
    ids = df.select(F.col(id_col).cast("long").alias("id")).distinct()
    counts = counts.withColumnRenamed("id", "c")
    out = ids.join(counts, ids.id.eqNullSafe(counts.c), "left").join(found, ids.id.eqNullSafe(found.i), "left")
    none = F.array().cast(found.schema["entities"].dataType)
    return out.select("id", F.coalesce("entities", none).alias("entities"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce("failed", F.lit(0)).cast("long").alias("failed"))


def word_bucket(word: str) -> str:
    """The bucket of a word in any case: four hexadecimal digits."""
    return hashlib.md5(word.lower().encode()).hexdigest()[:4]


def fit_tagger(df: DataFrame, text_col: str, label_col: str, none: str | None = None) -> dict[str, str]:
    """A tagger's table (bucket, label) from labelled texts: the label in whose texts a bucket's words stand most often,
    of equals the first by name; words of the label `none` are not tagged. All rows with a text and a label count; 65,536
    buckets at most reach the driver."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"\s+"), lambda w: w != "")
    each = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), F.explode(words).alias("w"))
    # buckets are few, so words are summed before they are shuffled
    counts = each.groupBy(F.substring(F.md5(F.col("w").cast("binary")), 1, 4).alias("bucket"), "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("bucket").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label"))
    return {r["bucket"]: r["label"] for r in best.collect() if r["label"] != none}


class RunTagger:
    """A fitted tagger as a model: runs of words with one label are spans; words of unknown buckets end a run."""

    def __init__(self, table: dict[str, str], known: int = 500_000):
        self.table, self.known, self.words = table, known, {}

    def __call__(self, words: Sequence[str]) -> list[tuple[int, int, str, float]]:
        seen = self.words
        new = [w for w in words if w not in seen]
        if len(seen) + len(new) > self.known:
            seen.clear()
            new = words
        for w in new:
            seen[w] = self.table.get(word_bucket(w))
        out: list[tuple[int, int, str, float]] = []
        for i, label in enumerate(map(seen.__getitem__, words)):
            if label is not None:
                if out and out[-1][1] == i and out[-1][2] == label:
                    out[-1] = (out[-1][0], i + 1, label, 1.0)
                else:
                    out.append((i, i + 1, label, 1.0))
        return out
