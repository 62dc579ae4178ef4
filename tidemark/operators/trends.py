"""Trend and comparison queries over job posts: monthly counts, growth rates and rankings.

Every function takes and returns DataFrames and an explicit reference date. Ties are ordered by name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Industries by the terms in a lower-cased title, in this order; the first that matches counts.
INDUSTRIES = {
    "Kinh doanh phần mềm": ("kinh doanh", "sales", "telesales", "tư vấn", "presale", "business development"),
    "AI & Data": ("ai", "data", "dữ liệu", "machine learning", "trí tuệ nhân tạo", "khoa học dữ liệu"),
    "Phát triển phần mềm": ("developer", "lập trình", "engineer", "kỹ sư", "backend", "frontend", "fullstack", "java", "python", "swe"),
    "Quản lý & Lãnh đạo": ("ceo", "cfo", "cio", "coo", "cto", "cpo", "giám đốc", "director", "manager", "trưởng phòng", "trưởng nhóm", "quản lý", "phó", "lead", "tổng"),
}
OTHER = "Khác"
MONTHS = (3, 6, 12, 24)


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def first_match(text: Column, groups: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """The first group, in order, of which a term occurs in the lower-cased text."""
    low = F.lower(text)
    out = F.lit(otherwise)
    for name, terms in reversed(groups.items()):
        out = F.when(contains_any(low, terms), F.lit(name)).otherwise(out)
    return out


def rate(now: Column, before: Column) -> Column:
    """Growth in percent; null where there is no base."""
    return F.when(before > 0, F.round((now - before) / before * 100, 6))


def month_start(day: str, back: int = 0) -> date:
    y, m, _ = map(int, day.split("-"))
    n = y * 12 + m - 1 - back
    return date(n // 12, n % 12 + 1, 1)


def checked_months(months: int) -> int:
    if months not in MONTHS:
        raise ValueError(f"months must be one of {MONTHS}")
    return months


def parse_keywords(raw: DataFrame, col: str) -> DataFrame:
    """Comma-separated keywords as an array: trimmed, without blanks, each once (case counts), in order."""
    parts = F.filter(F.transform(F.split(F.col(col), ","), lambda x: F.trim(x)), lambda x: x != "")
    return raw.withColumn("keywords", F.array_distinct(parts))


def top_industries(jobs: DataFrame, as_of: str, k: int = 4, groups: Mapping[str, Sequence[str]] = INDUSTRIES, other: str = OTHER) -> DataFrame:
    """(industry, job_count, growth, mom) of the k largest industries. Jobs without title or date don't count; what lies in
    the future counts as this month."""
    this, last = F.lit(month_start(as_of)), F.lit(month_start(as_of, 1))
    df = jobs.where("title is not null and posted_at is not null").withColumn("industry", first_match(F.col("title"), groups, other))
    n = {"total": F.lit(True), "before": F.col("posted_at") < this, "now": F.col("posted_at") >= this, "last": (F.col("posted_at") >= last) & (F.col("posted_at") < this)}
    df = df.where(F.col("industry") != other).groupBy("industry").agg(*[F.count(F.when(c, 1)).alias(k) for k, c in n.items()])
    out = df.select("industry", F.col("total").alias("job_count"), rate(F.col("total"), F.col("before")).alias("growth"), rate(F.col("now"), F.col("last")).alias("mom"))
    return out.orderBy(F.desc("job_count"), "industry").limit(k)


def top_technologies(jobs: DataFrame, requires: DataFrame, techs: DataFrame, as_of: str, k: int = 10) -> DataFrame:
    """(technology, job_count): distinct jobs up to the month of as_of, technologies by lower-cased name."""
    until = F.lit(month_start(as_of, -1))
    j = jobs.where((F.col("posted_at") < until) & F.col("title").isNotNull()).select("job_id")
    t = techs.where("name is not null").select("tech_id", "name")
    df = requires.join(j, "job_id").join(t, "tech_id")
    df = df.groupBy(F.lower("name").alias("key")).agg(F.countDistinct("job_id").alias("job_count"), F.min("name").alias("technology"))
    return df.orderBy(F.desc("job_count"), "technology").limit(k).select("technology", "job_count")


def keyword_months(jobs: DataFrame, requires: DataFrame, techs: DataFrame, keywords: Sequence[str], months: int, as_of: str) -> DataFrame:
    """(year, month, keyword, job_count): distinct jobs a month for exact names without regard to case, months without
    jobs absent."""
    since, until = F.add_months(F.lit(as_of).cast("date"), -checked_months(months)), F.lit(month_start(as_of, -1))
    keys = {k.lower(): k for k in keywords}
    shown = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])
    t = techs.where(F.lower("name").isin(list(keys))).select("tech_id", F.element_at(shown, F.lower("name")).alias("keyword"))
    j = jobs.where((F.col("posted_at") >= since) & (F.col("posted_at") < until)).select("job_id", "posted_at")
    df = requires.join(t, "tech_id").join(j, "job_id")
    return df.groupBy(F.year("posted_at").cast("long").alias("year"), F.month("posted_at").cast("long").alias("month"), "keyword").agg(F.countDistinct("job_id").alias("job_count"))


def as_points(counts: DataFrame) -> DataFrame:
    """Monthly rows as (year, month, {keyword: count})."""
    pairs = F.sort_array(F.collect_list(F.struct("keyword", "job_count")))
    return counts.groupBy("year", "month").agg(F.map_from_entries(pairs).alias("counts"))


def pivot_points(counts: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Monthly rows with a column for each keyword, missing ones 0; the first column is the month as YYYY-MM."""
    df = counts.withColumn("month_label", F.format_string("%04d-%02d", "year", "month"))
    return df.groupBy("month_label").pivot("keyword", list(keywords)).sum("job_count").na.fill(0)


def spine(spark, months: int, as_of: str) -> DataFrame:
    """months + 1 month starts up to that of as_of."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(month_start(as_of, months)), F.lit(month_start(as_of)), F.expr("interval 1 month"))).alias("month"))


def compare_counts(jobs: DataFrame, keywords: Sequence[str], months: int, as_of: str) -> DataFrame:
    """(keyword, month, n) for every keyword and month of the spine; a job counts for each keyword that its title contains.

    The keywords are a request's: each is a condition of its own, so a job is read once whatever their number.
    """
    since, until = F.lit(month_start(as_of, months)), F.lit(month_start(as_of, -1))
    low = F.lower("title")
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in keywords]))
    df = jobs.where((F.col("posted_at") >= since) & (F.col("posted_at") < until) & F.col("title").isNotNull())
    df = df.select(F.explode(hits).alias("keyword"), F.trunc("posted_at", "MM").alias("month")).groupBy("keyword", "month").agg(F.count(F.lit(1)).alias("n"))
    grid = spine(jobs.sparkSession, months, as_of).select("month", F.explode(F.array(*[F.lit(k) for k in keywords])).alias("keyword"))
    return grid.join(df, ["keyword", "month"], "left").na.fill(0, ["n"])


def compare(jobs: DataFrame, keywords: Sequence[str], months: int, as_of: str) -> DataFrame:
    """(keyword, job_count, growth, mom, yoy, peak_month): totals over the window and rates at its end.

    growth is a keyword's share of the others' total in percent; mom and yoy compare the month of as_of with the one
    before and with the same month a year ago. Rates without a base are null.
    """
    spine_n = checked_months(months)
    counts = compare_counts(jobs, keywords, max(spine_n, 12), as_of)
    at = {"now": 0, "last": 1, "year": 12}
    cols = [F.sum(F.when(F.col("month") == F.lit(month_start(as_of, b)), F.col("n")).otherwise(0)).alias(k) for k, b in at.items()]
    inside = F.col("month") >= F.lit(month_start(as_of, spine_n))
    peak = F.max(F.when(inside, F.struct("n", F.expr("-unix_date(month)"), "month"))).alias("peak")
    df = counts.groupBy("keyword").agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("job_count"), *cols, peak)
    others = F.sum("job_count").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.col("job_count")  # a row for each keyword asked for
    df = df.withColumn("others", others)
    growth = F.when(F.col("others") > 0, F.round(F.col("job_count") / F.col("others") * 100, 6))
    return df.select("keyword", "job_count", growth.alias("growth"), rate(F.col("now"), F.col("last")).alias("mom"), rate(F.col("now"), F.col("year")).alias("yoy"), F.date_format("peak.month", "yyyy-MM").alias("peak_month"))


def compare_points(jobs: DataFrame, keywords: Sequence[str], months: int, as_of: str) -> DataFrame:
    """(keyword, month_label, n, growth, mom, yoy, is_last): the zero-filled series with growth against its first month above
    zero (two decimals), and the rates to the month and the year before."""
    order = W.partitionBy("keyword").orderBy("month")
    base = F.first(F.when(F.col("n") > 0, F.col("n")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    df = compare_counts(jobs, keywords, months, as_of).withColumn("base", base)
    label = F.concat(F.lit("T"), F.month("month"), F.lit("/"), F.year("month"))
    growth = F.when(F.col("base") > 0, F.round((F.col("n") - F.col("base")) / F.col("base") * 100, 2)).otherwise(0.0)
    last = F.row_number().over(W.partitionBy("keyword").orderBy(F.desc("month"))) <= 3
    return df.select("keyword", label.alias("month_label"), "n", growth.alias("growth"), rate(F.col("n"), F.lag("n", 1).over(order)).alias("mom"), rate(F.col("n"), F.lag("n", 12).over(order)).alias("yoy"), last.alias("is_last"))


def monthly_visitors(visits: DataFrame, months: int, as_of: str) -> DataFrame:
    """(month, visitors): distinct addresses in each of the last months, the present one included, zeros kept."""
    df = visits.where((F.col("ts") >= F.lit(month_start(as_of, months - 1))) & (F.col("ts") < F.lit(month_start(as_of, -1))))
    df = df.groupBy(F.trunc("ts", "MM").alias("month")).agg(F.countDistinct("ip").alias("visitors"))
    out = spine(visits.sparkSession, months - 1, as_of).join(df, "month", "left").na.fill(0, ["visitors"])
    return out.select(F.date_format("month", "yyyy-MM").alias("month"), "visitors")


def top_keywords(searches: DataFrame, k: int = 4) -> DataFrame:
    return searches.groupBy("keyword").agg(F.count(F.lit(1)).alias("searches")).orderBy(F.desc("searches"), "keyword").limit(k)


def day_totals(visits: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """One row: users, and on the day of as_of the visitors and the searches."""
    day = F.to_date("ts") == F.lit(as_of).cast("date")
    v = visits.agg(F.countDistinct(F.when(day, F.col("ip"))).alias("visits_today"), F.count(F.when(day, 1)).alias("searches_today"))
    return users.agg(F.count(F.lit(1)).alias("users")).join(v)  # one row each
