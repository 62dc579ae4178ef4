"""The library's functions in SQL: scalar functions of text, and table functions that give a row for each span.

`register(spark)` makes them temporary functions of a session. The scalar ones, and those by dictionary, are SQL themselves,
so Spark plans them like any expression; dates and pay need patterns in order of precedence and run as Python table functions.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidemark.functions.patterns import DATES, PAY
from tidemark.functions.spans import ordered_spans

#: name(parameters) -> type: expression. Texts are nullable; null counts as empty, as in the functions on columns.
SCALARS = {
    "tm_slug(s STRING) RETURNS STRING": r"regexp_replace(translate(lower(coalesce(s, '')), ' _', '--'), '[^a-z0-9-]', '')",
    "tm_post_id(url STRING) RETURNS STRING": "md5(coalesce(url, ''))",
    "tm_alias_key(s STRING) RETURNS STRING": r"trim(regexp_replace(lower(trim(coalesce(s, ''))), '[\\s._/\\-]+', ' '))",
    "tm_rate(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "CASE WHEN b > 0 THEN (a - b) / b * 100 END",
    "tm_cosine(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE": "coalesce(try_divide(aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v), sqrt(aggregate(x, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(y, 0D, (s, v) -> s + v * v))), 0D)",
}
#: Spans by dictionary: whole words in any case, the longest term first; by place, counted from 0.
TABLES = {
    "tm_phrases(body STRING, terms ARRAY<STRING>) RETURNS TABLE(place INT, entity STRING)": r"""
        SELECT pos, col FROM (SELECT posexplode(regexp_extract_all(coalesce(body, ''),
        '(?iuU)(?<![\\w.])(' || array_join(transform(array_sort(terms, (a, b) -> CASE WHEN length(a) <> length(b) THEN length(b) - length(a) WHEN a < b THEN -1 ELSE 1 END), t -> '\\Q' || t || '\\E'), '|') || ')(?![\\w.])', 1)))""",
}


def _table_function(patterns, label: str, group: bool):
    compiled = [re.compile(p, re.IGNORECASE) for p in patterns]

    class Spans:
        def eval(self, body: str):
            for place, entity in enumerate(ordered_spans(body, compiled, group) if body else []):
                yield place, entity, label

    return udtf(Spans, returnType="place int, entity string, label string")


def register(spark: SparkSession) -> None:
    """Make all functions known to SQL in this session; again: they are replaced."""
    for head, body in {**SCALARS, **TABLES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("tm_dates", _table_function(DATES, "DATE", False))
    spark.udtf.register("tm_pay", _table_function(PAY, "SALARY", True))
