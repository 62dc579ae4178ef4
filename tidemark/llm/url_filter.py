"""URL filter: rules on host and path first, then the ratio of two character models. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_UPPER, stored

#: Fixed values of the contract: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: History of the longest context, number of symbols that an unseen one is one of, rows of the model up to which it is
#: broadcast, and the width of a calibration bin.
ORDER, SYMBOLS, BROADCAST_ROWS, BIN = 3, 256, 500_000, 0.02
START, END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or null; of equally long ones, block."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _positions(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each symbol of host and path, the end mark included, with t (START in front) and its place i in it."""
    t = F.concat(F.lit(START * ORDER), "host", "path", F.lit(END))
    return df.select(*keep, t.alias("t")).withColumn("i", F.explode(F.sequence(F.lit(ORDER + 1), F.length("t"))))


def _gram(k: int) -> Column:
    return F.substring("t", F.col("i") - k, F.lit(k + 1))


def fit(urls: DataFrame) -> DataFrame:
    """The two models as one table, from urls (host, path, accepted boolean, and weight, if a row stands for several): s, and for each class (a: accepted, r: rejected)
    lp, the log-probability of the last symbol of s after the rest, and lam, the log of what s as a context leaves to
    shorter ones (Witten-Bell). Null: not seen in that class."""
    urls = urls if "weight" in urls.columns else urls.withColumn("weight", F.lit(1))
    grams = _positions(urls, "accepted", "weight").select("accepted", "weight", F.explode(F.array(*[_gram(k) for k in range(ORDER + 1)])).alias("s"))
    n = {c: F.sum(F.when(F.col("accepted") == (c == "a"), F.col("weight")).otherwise(0)) for c in "ar"}
    counts = stored(grams.groupBy("s").agg(n["a"].alias("a"), n["r"].alias("r")), "grams")
    head = counts.withColumn("ctx", F.expr("substring(s, 1, length(s) - 1)"))
    sums = head.groupBy("ctx").agg(*[f.alias(x + c) for c in "ar" for x, f in (("n", F.sum(c)), ("kinds", F.count(F.when(F.col(c) > 0, 1))))])
    sums = stored(sums, "contexts")
    lower = None
    levels = []
    for k in range(ORDER + 1):
        level = head.where(F.length("s") == k + 1).join(sums, "ctx")
        if lower is None:
            level = level.withColumns({f"q{c}": F.lit(1.0 / SYMBOLS) for c in "ar"})
        else:
            level = level.withColumn("tail", F.expr("substring(s, 2)")).join(lower.select(F.col("s").alias("tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr")), "tail")
        p = {f"p{c}": F.when(F.col(c) > 0, (F.col(c) + F.col("kinds" + c) * F.col("q" + c)) / (F.col("n" + c) + F.col("kinds" + c))) for c in "ar"}
        lower = stored(level.withColumns(p).select("s", "pa", "pr"), f"order{k}")
        levels.append(lower)
    probs = reduce(DataFrame.unionByName, levels)
    lam = {f"lam{c}": F.when(F.col("n" + c) > 0, F.log(F.col("kinds" + c) / (F.col("n" + c) + F.col("kinds" + c)))) for c in "ar"}
    lams = sums.select(F.col("ctx").alias("s"), *[v.alias(k) for k, v in lam.items()])
    both = probs.select("s", F.log("pa").alias("lpa"), F.log("pr").alias("lpr")).join(lams, "s", "full_outer")
    return stored(both, "url-model")


def score(urls: DataFrame, model: DataFrame, key: str = "row") -> DataFrame:
    """(key, score): the difference of the two log-likelihoods for each symbol of a URL.

    The model is broadcast while it is small; a larger one is joined by shuffles.
    """
    small = model.count() <= BROADCAST_ROWS
    root = model.where("s = ''").select("lama", "lamr").first()
    at = _positions(urls, key)
    cur = {}
    for c in "ar":
        lam = root["lam" + c] if root is not None and root["lam" + c] is not None else 0.0
        cur[c] = F.lit(lam - math.log(SYMBOLS))
    for k in range(ORDER + 1):
        g = model.select(F.col("s").alias(f"g{k}"), F.col("lpa").alias(f"lpa{k}"), F.col("lpr").alias(f"lpr{k}"))
        at = at.withColumn(f"g{k}", _gram(k)).join(F.broadcast(g) if small else g, f"g{k}", "left")
        if k:
            x = model.select(F.col("s").alias(f"x{k}"), F.col("lama").alias(f"lama{k}"), F.col("lamr").alias(f"lamr{k}"))
            at = at.withColumn(f"x{k}", F.substring("t", F.col("i") - k, F.lit(k))).join(F.broadcast(x) if small else x, f"x{k}", "left")
        for c in "ar":
            back = cur[c] + F.coalesce(f"lam{c}{k}", F.lit(0.0)) if k else cur[c]
            cur[c] = F.coalesce(f"lp{c}{k}", back)
    return at.select(key, (cur["a"] - cur["r"]).alias("d")).groupBy(key).agg(F.avg("d").alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score, in steps of BIN, above which (score, accepted) rows (with a weight, if one stands for several) are best called accepted, by the mean of both classes'
    shares of right calls; the one nearest zero of equals, 0 where a class is missing. Scores are gathered to a bounded number of bins."""
    w = F.col("weight") if "weight" in scored.columns else F.lit(1)
    bins = scored.groupBy(F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-2000)), F.lit(2000)).alias("b")).agg(F.sum(F.when(F.col("accepted"), w).otherwise(0)).alias("a"), F.sum(F.when(~F.col("accepted"), w).otherwise(0)).alias("r"))
    below, all_rows = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = F.try_divide(F.sum("a").over(all_rows) - F.coalesce(F.sum("a").over(below), F.lit(0)), F.sum("a").over(all_rows))
    share = share + F.try_divide(F.coalesce(F.sum("r").over(below), F.lit(0)), F.sum("r").over(all_rows))
    best = bins.withColumn("right", F.round(share, 9)).where("right is not null").orderBy(F.desc("right"), F.abs("b"), "b").first()
    return best["b"] * BIN if best is not None else 0.0


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row: the longest rule's verdict, else the models'.

    The URLs that rules allow or block are the labelled rows. All of them teach the models; models of four fifths of them,
    by hash, are held against the rest to set the threshold (0 where that leaves a class without URLs). Null URLs, and those without ://, have an
    empty host and path, no rule, and are judged by their only symbol, the end mark. Without URLs of both classes all
    scores of the rest are as the models of nothing give them (0 at threshold 0: allow). Repeated rows are judged alike
    and returned as often as they came; an empty table gives an empty table. Other columns are not read.
    """
    url = F.col(url_col).cast("string")
    df = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    df = stored(df.withColumns({"rule": rule, "said": verdict, "row": F.monotonically_increasing_id()}), "urls")
    # equal URLs, which have equal rules, count by their number
    labelled = df.where("said is not null").groupBy("host", "path", (F.col("said") == "allow").alias("accepted")).agg(F.count(F.lit(1)).alias("weight"))
    labelled = labelled.withColumns({"row": F.xxhash64("host", "path"), "held": F.pmod(F.xxhash64("path", "host"), F.lit(5)) == 0})
    labelled = stored(labelled, "labelled-urls")
    taught, held = labelled.where("not held"), labelled.where("held")
    line = 0.0
    if taught.agg(F.count_distinct("accepted")).first()[0] == 2:
        line = threshold(score(held.select("row", "host", "path"), fit(taught)).join(held.select("row", "accepted", "weight"), "row"))
    model = fit(labelled)
    out = df.join(score(df, model), "row", "left")
    said = F.coalesce("said", F.when(F.col("score") >= line, "allow").otherwise("block"))
    return out.select("id", "host", "path", "rule", said.alias("verdict"), "score")
