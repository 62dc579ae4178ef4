"""Joins and reports over jobs, companies, technologies and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_company(jobs: DataFrame, hires: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs with their company's name and location; jobs without one stay."""
    c = companies.select("company_id", F.col("name").alias("company"), "location")
    return jobs.join(hires, "job_id", "left").join(c, "company_id", "left")


def link_by_name(left: DataFrame, left_col: str, right: DataFrame, right_col: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of rows with the same name, each pair once."""
    r = right.select(F.col(right_col).alias("_n"), right_id)
    return left.join(r, left[left_col] == F.col("_n")).select(left_id, right_id).distinct()


def word_mentions(articles: DataFrame, text_col: str, words: DataFrame) -> DataFrame:
    """(article_id, word) for dictionary words in a text. Texts are cut into words once and joined by equality, so the cost
    does not grow with articles times dictionary."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word")
    return articles.select("article_id", token).join(words.select(F.lower("word").alias("word")).distinct(), "word").select("article_id", "word")


def counts_by_label(tables: dict[str, DataFrame], expected: list[str]) -> DataFrame:
    """(label, n, missing) for each expected label, 0 and true where there is no such table or row."""
    spark = next(iter(tables.values())).sparkSession
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("label"), "n") for k, df in tables.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    want = spark.createDataFrame([(k,) for k in expected], "label string")
    out = want.join(found, "label", "left").na.fill(0, ["n"])
    return out.withColumn("missing", F.col("n") == 0)


def popular_technologies(requires: DataFrame, techs: DataFrame, least: int) -> DataFrame:
    """(tech_id, name, degree_total) of technologies that `least` job edges or more require."""
    n = requires.groupBy("tech_id").agg(F.count(F.lit(1)).alias("degree_total")).where(F.col("degree_total") >= least)
    return techs.join(n, "tech_id").select("tech_id", "name", "degree_total")


def neighbourhood(techs: DataFrame, jobs: DataFrame, companies: DataFrame, related: DataFrame) -> DataFrame:
    """(tech_id, n_jobs, n_companies, n_related, log_jobs, log_companies, job_company_ratio), 0 where there are none."""
    out = techs.select("tech_id")
    for name, df in (("n_jobs", jobs), ("n_companies", companies), ("n_related", related)):
        out = out.join(df.groupBy("tech_id").agg(F.count(F.lit(1)).alias(name)), "tech_id", "left")
    out = out.na.fill(0)
    return out.select("*", F.round(F.log1p("n_jobs"), 6).alias("log_jobs"), F.round(F.log1p("n_companies"), 6).alias("log_companies"), F.round(F.col("n_jobs") / F.greatest("n_companies", F.lit(1)), 6).alias("job_company_ratio"))


def adjusted_skewness(x: Column) -> Column:
    """Sample skewness with the small-sample correction; null below three values or without spread."""
    n, s = F.count(x), F.skewness(x)
    return F.when((n > 2) & ~F.isnan(s), s * F.sqrt(n * (n - 1)) / (n - 2))


def temporal_stats(mentions: DataFrame, as_of: str, group: str) -> DataFrame:
    """(group, first_days, last_days, skewness, mean_value): age of the first and last mention in days, skewness of the ages
    and the mean value; -1, -1, 0 and 0 where there is no date."""
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date("at"))
    df = mentions.groupBy(group).agg(F.max(days).alias("a"), F.min(days).alias("b"), adjusted_skewness(days.cast("double")).alias("s"), F.avg("value").alias("v"))
    return df.select(group, F.coalesce("a", F.lit(-1)).cast("long").alias("first_days"), F.coalesce("b", F.lit(-1)).cast("long").alias("last_days"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("skewness"), F.round(F.coalesce("v", F.lit(0.0)), 6).alias("mean_value"))


def jaccard_to_top(requires: DataFrame, k: int = 10) -> DataFrame:
    """(tech_id, n_jobs, mean_jaccard): mean Jaccard similarity of a technology's jobs to those of each of the k most
    required ones (itself included if it is one)."""
    e = requires.select("job_id", "tech_id").distinct()
    n = e.groupBy("tech_id").agg(F.count(F.lit(1)).alias("n_jobs"))
    top = n.orderBy(F.desc("n_jobs"), "tech_id").limit(k).select(F.col("tech_id").alias("top_id"), F.col("n_jobs").alias("top_jobs"))
    held = e.join(F.broadcast(top), e.tech_id == F.col("top_id")).select("job_id", "top_id", "top_jobs")  # k technologies
    both = e.join(held, "job_id").groupBy("tech_id", "top_id", "top_jobs").agg(F.count(F.lit(1)).alias("both"))
    s = both.join(n, "tech_id").withColumn("j", F.col("both") / (F.col("n_jobs") + F.col("top_jobs") - F.col("both")))
    s = s.groupBy("tech_id").agg(F.sum("j").alias("total"))
    return n.join(s, "tech_id", "left").select("tech_id", "n_jobs", F.round(F.coalesce("total", F.lit(0.0)) / k, 6).alias("mean_jaccard"))


def smooth_tfidf(tokens: DataFrame, doc: str, token: str, least_docs: int = 2, features: int = 500) -> DataFrame:
    """(doc, token, weight): counts times ln((1 + n) / (1 + df)) + 1, L2-normalised, over the most frequent tokens that
    least_docs documents or more hold."""
    tf = tokens.groupBy(doc, token).agg(F.count(F.lit(1)).alias("tf"))
    docs = tokens.agg(F.countDistinct(doc).alias("docs"))
    df = tf.groupBy(token).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least_docs)
    df = df.orderBy(F.desc("total"), token).limit(features).join(docs)  # one row of docs
    idf = df.select(token, (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, token).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(doc)))
    return w.select(doc, token, F.round(F.col("w") / norm, 6).alias("weight"))


def noise_filter(techs: DataFrame, requires: DataFrame, least_jobs: int, blocked: list[str], patterns: list[str], allowed: list[str]) -> DataFrame:
    """Technologies that enough distinct jobs require, whose lower-cased name is not blocked and matches no pattern from its
    start, unless it is one of the allowed names."""
    n = requires.groupBy("tech_id").agg(F.countDistinct("job_id").alias("jobs"))
    low = F.lower("name")
    noisy = F.rlike("name", F.lit("(?iu)^(?:" + "|".join(patterns) + ")")) & ~low.isin(allowed) if patterns else F.lit(False)
    return techs.join(n, "tech_id", "left").na.fill(0, ["jobs"]).where((F.col("jobs") >= least_jobs) & ~low.isin(blocked) & ~noisy)


def job_batches(parts: list[DataFrame], key: str, cap: int) -> DataFrame:
    """Rows of several lists in order of priority, each key once (the first counts), cut at `cap`."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("prio", F.lit(i))
        both = p if both is None else both.unionByName(p)
    order = W.partitionBy(key).orderBy("prio", *[c for c in both.columns if c not in (key, "prio")])
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r").orderBy("prio", key).limit(cap)


def foreign_key_check(child: DataFrame, col: str, parent: DataFrame, parent_col: str, sample: int = 5) -> DataFrame:
    """One row (missing, sample): keys of the child that the parent has not, and the first few of them."""
    lost = child.select(F.col(col).alias("k")).where("k is not null").distinct().join(parent.select(F.col(parent_col).alias("k")), "k", "left_anti")
    first = lost.orderBy("k").limit(sample).agg(F.array_join(F.array_sort(F.collect_list(F.col("k").cast("string"))), ",").alias("sample"))
    return lost.agg(F.count(F.lit(1)).alias("missing")).join(first)  # one row each


def table_checks(df: DataFrame, name: str, key: list[str], required: list[str], text: list[str]) -> DataFrame:
    """(check, severity, n) of one table: empty, repeated keys, nulls in required columns, blanks in text columns; one pass
    over the rows, and one over the keys."""
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in required], *[F.count(F.when(F.trim(F.col(c)) == "", 1)).alias(f"blank_{c}") for c in text]]
    one = df.agg(*aggs)
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("repeated"))
    one = one.join(dup)  # one row each
    checks = [("not_empty", "error", F.when(F.col("rows") == 0, 1).otherwise(0).cast("long")), ("unique_key", "error", F.col("repeated"))]
    checks += [(f"null_{c}", "error", F.col(f"null_{c}")) for c in required] + [(f"blank_{c}", "warning", F.col(f"blank_{c}")) for c in text]
    rows = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("check"), F.lit(s).alias("severity"), n.alias("n")) for c, s, n in checks])).alias("x")
    return one.select(rows).select("x.*")


def confusion(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    """One row of counts and accuracy, precision, recall and F1, 0 where undefined."""
    y, p = F.col(label) == 1, predicted
    n = df.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))])
    return scores(n)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def scores(n: DataFrame) -> DataFrame:
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return n.select("*", F.round(_ratio(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(_ratio(2 * precision * recall, precision + recall), 6).alias("f1"))


def threshold_sweep(df: DataFrame, label: str, score: str, steps: int = 100) -> DataFrame:
    """(threshold, tp, fp, fn, tn, accuracy, ...) for steps + 1 thresholds from 0 to 1: one count of scores by bin, then
    running sums over the bins; rows are read once, not once for each threshold."""
    spark = df.sparkSession
    bins = df.groupBy(F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps)).alias("b")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) != 1, 1)).alias("q"))
    grid = spark.range(steps + 1).select(F.col("id").alias("b")).join(bins, "b", "left").na.fill(0)
    up = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, 0)  # steps + 1 rows
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = grid.select((F.col("b") / steps).alias("threshold"), F.sum("p").over(up).alias("tp"), F.sum("q").over(up).alias("fp"), (F.sum("p").over(all_rows) - F.sum("p").over(up)).alias("fn"), (F.sum("q").over(all_rows) - F.sum("q").over(up)).alias("tn"))
    return scores(n)
