"""Filters, orders, caps and calendars that reports share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contains_any(col: str, terms: Sequence[str]) -> Column:
    """Case-insensitive: a null holds nothing."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower(col), F.lit(t.lower()))
    return F.coalesce(hit, F.lit(False))


def is_any(col: str, names: Sequence[str]) -> Column:
    """Case-insensitive membership; null is no member."""
    return F.coalesce(F.lower(col).isin([n.lower() for n in names]), F.lit(False))


def with_labels(nodes: DataFrame, labels: Sequence[str], label: str = "label") -> DataFrame:
    """Nodes that have any of the labels."""
    return nodes.where(F.col(label).isin(*labels))


def in_window(df: DataFrame, day: str, as_of: str, months: int) -> DataFrame:
    """Rows of the last `months` months before the date, and none later than the date's own month. Null days go."""
    first = F.add_months(F.to_date(F.lit(as_of)), -months)
    return df.where((F.to_date(day) >= first) & (F.trunc(day, "MM") <= F.trunc(F.lit(as_of).cast("date"), "MM")))


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null."""
    return df.dropna(subset=list(columns))


def matching_nodes(nodes: DataFrame, least_pay: float | None = None, least_sentiment: float | None = None, place: str | None = None) -> DataFrame:
    """Nodes of a graph result (pay, sentiment, location) that meet every condition that is given; a node without the
    value of a condition doesn't meet it."""
    for value, bound in (("pay", least_pay), ("sentiment", least_sentiment)):
        if bound is not None:
            nodes = nodes.where(F.col(value) >= bound)
    return nodes if place is None else nodes.where(contains_any("location", [place]))


def named(df: DataFrame, name: str, blacklist: Sequence[str], longer_than: int) -> DataFrame:
    """Rows with a name longer than that many characters and not on the blacklist, by lower case."""
    return df.where((F.length(F.trim(name)) > longer_than) & ~F.lower(F.trim(name)).isin([b.lower() for b in blacklist]))


def without_keys(properties: Column, heavy: Sequence[str] = ("content",)) -> Column:
    """A map of properties without the heavy ones."""
    return F.map_filter(properties, lambda k, _: ~k.isin(*heavy))


def capped(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first rows in an order that leaves no ties open."""
    return df.orderBy(*order).limit(limit)


def reranked(scored: DataFrame, group: Sequence[str], threshold: float = 0.4, top: int = 5, fallback: int = 3) -> DataFrame:
    """The best `top` rows (id, score) of each group with a score of threshold or more; where none passes, the best
    `fallback` ones, marked as low_confidence. Ties go by id."""
    order = W.partitionBy(*group).orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(top, fallback))
    ranked = ranked.withColumn("low_confidence", F.max("score").over(W.partitionBy(*group)) < threshold)
    passes = (F.col("score") >= threshold) & (F.col("rank") <= top)
    return ranked.where(F.when(F.col("low_confidence"), F.col("rank") <= fallback).otherwise(passes))


def month_spine(df: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """(month, n): rows of each month between two dates, months without any included."""
    months = df.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "MM"), F.trunc(F.lit(last).cast("date"), "MM"), F.expr("interval 1 month"))).alias("month"))
    n = df.groupBy(F.trunc(day, "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return months.join(n, "month", "left").na.fill(0, ["n"])


def previous(df: DataFrame, value: str, order: str, back: int, *group: str) -> Column:
    """The value so many rows before, within the group."""
    return F.lag(value, back).over(W.partitionBy(*group).orderBy(order))


def rate(new: Column, old: Column) -> Column:
    """(new - old) / old in per cent; null where old is null or not above zero."""
    return F.when(old > 0, (new - old) / old * 100)


def month_label(day: Column) -> Column:
    """T{month}/{year}."""
    return F.concat(F.lit("T"), F.month(day).cast("string"), F.lit("/"), F.year(day).cast("string"))


def people(c: Column, stop: Sequence[str] = ()) -> Column:
    """Pairs of neighbouring capitalised words of which neither is a stop word; each pair once, in order."""
    words = F.filter(F.split(c, r"[^\p{L}]+"), lambda w: w != "")
    name = lambda w: F.rlike(w, F.lit(r"^\p{Lu}\p{Ll}+$")) & ~F.lower(w).isin(*[s.lower() for s in stop] or [""])
    pairs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.struct(w.alias("a"), F.get(words, i + 1).alias("b")))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: name(p["a"]) & name(p["b"])), lambda p: F.concat_ws(" ", p["a"], p["b"])))


def relinked(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges (a, b) between the canonical ids (id, canonical) of their ends, each once, without loops."""
    at = lambda end: canonical.select(F.col("id").alias(end), F.col("canonical").alias("to_" + end))
    moved = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
    return moved.where("a <> b").distinct()
