"""Entities in texts: dictionary phrases by regular expression in Spark, overlapping patterns by a vectorised function."""

from __future__ import annotations

import bisect
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.patterns import DATES, PAY

#: A text without any of these holds no date and no pay by those patterns. Digits and spaces are those of Python, whose
#: matcher runs the patterns: digits of all scripts, and no-break, thin and other spaces.
HINT = r"(?iu)\p{Nd}|(?:qu[yý]|th[ứu])[\s\p{Z}\x1c-\x1f\x85]|lương|salary"
ENTITY = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))


def ordered_spans(text: str, patterns: Sequence[re.Pattern], group: bool) -> list[str]:
    """What the patterns find, without overlaps: of two that overlap, the one whose pattern comes first stays. group: the
    first group, where set."""
    found = [(m.start(), m.end(), m) for p in patterns for m in p.finditer(text)]
    if len(found) < 2:
        kept = [m for _, _, m in found]
    else:
        begins: list[int] = []  # of the stretches that are taken, in order, and where they end
        ends: list[int] = []
        kept = []
        for begin, end, m in found:
            at = bisect.bisect_left(begins, end)
            if at == 0 or ends[at - 1] <= begin:
                begins.insert(at, begin)
                ends.insert(at, end)
                kept.append(m)
    return [((m.group(1) if group and m.re.groups else None) or m.group()).strip() for m in kept]


def _finder(patterns: Sequence[str], group: bool):
    compiled = [re.compile(p, re.IGNORECASE) for p in patterns]
    return lambda text: ordered_spans(text, compiled, group) if text else []


def spans(c, label: str, patterns: Sequence[str], group: bool = False) -> Column:
    """array<struct<entity, label, score>> of a text by patterns in order of precedence (sequential, so not in SQL)."""
    find = _finder(patterns, group)

    @F.pandas_udf(ENTITY)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"entity": e, "label": label, "score": 1.0} for e in find(x)])

    return run(F.col(c) if isinstance(c, str) else c)


def dates_and_pay(c: Column) -> Column:
    """struct<dates, pay> of a text. Texts without a digit or a word of pay stay in the JVM: only the others are sent to
    Python, once for both."""
    dates, pay = _finder(DATES, False), _finder(PAY, True)

    @F.pandas_udf("struct<dates: array<string>, pay: array<string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"dates": [dates(x) for x in texts], "pay": [pay(x) for x in texts]})

    return run(F.when(F.rlike(c, F.lit(HINT)), c))


def phrases(c, terms: Sequence[str], any_case: bool = True) -> Column:
    """The dictionary terms in a text as whole words, the longest first, each once by lower case, in order of their place."""
    best = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    pattern = ("(?iuU)" if any_case else "(?U)") + r"(?<![\w.])(" + best + r")(?![\w.])"
    found = F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(pattern), F.lit(1))
    low = F.transform(found, lambda x: F.lower(x))
    return F.filter(found, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def organisations(c, suffixes: Sequence[str]) -> Column:
    """Words from two before to one behind a word that holds a company suffix, each stretch once."""
    words = F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != "")
    has = "(?iu)" + "|".join(re.escape(s) for s in suffixes)
    at = F.filter(F.transform(words, lambda w, i: F.when(F.rlike(w, F.lit(has)), i)), lambda i: i.isNotNull())
    parts = F.transform(at, lambda i: F.trim(F.regexp_replace(F.array_join(F.slice(words, F.greatest(i - 1, F.lit(1)), i + 2 - F.greatest(i - 1, F.lit(1)) + 1), " "), r"^[\p{Punct}]+|[\p{Punct}]+$", "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def token_windows(c, size: int = 480, overlap: int = 50) -> Column:
    """Windows of whitespace tokens; the last one ends with the text."""
    words = F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != "")
    n = F.size(words)
    last = F.greatest(F.ceil((n - size) / (size - overlap)), F.lit(0)).cast("int")
    starts = F.sequence(F.lit(0), last)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i * (size - overlap) + 1, size), " ")))


def grouped(entities: Column, labels: Sequence[str]) -> Column:
    """A map from each label to its entities, in order, each once; B- and I- in front of a label is dropped."""
    def of(label):
        hit = F.filter(entities, lambda e: F.regexp_replace(e["label"], "^[BI]-", "") == label)
        return F.array_distinct(F.transform(hit, lambda e: e["entity"]))

    return F.create_map(*[x for k in labels for x in (F.lit(k), of(k))])


def extract(df: DataFrame, text: Column, tech_terms: Sequence[str], role_terms: Sequence[str], places: Sequence[str]) -> DataFrame:
    """df with techs, roles, locations, dates and pay found in a text; the same for batches and streams."""
    df = df.withColumn("_text", F.coalesce(text, F.lit("")))
    df = df.withColumns({"techs": phrases("_text", tech_terms), "roles": phrases("_text", role_terms), "locations": phrases("_text", places)})
    df = df.withColumn("_both", dates_and_pay(F.col("_text")))
    return df.withColumns({"dates": F.col("_both.dates"), "pay": F.col("_both.pay")}).drop("_text", "_both")
