"""Sources and sinks: posts in two JSON layouts, repair of broken JSON, pages, snapshots, tables with upserts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

POST = "struct<title: string, job_title: string, content: string, description: string, created_at: string, is_relevant: boolean>"
OBJECT = f"source_platform string, source_url string, scraped_at string, post_detail array<{POST}>"


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, content, is_relevant) of post files that hold an object with post_detail, or an array of records."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    return posts_of(raw)


def posts_of(raw: DataFrame) -> DataFrame:
    """Posts of whole files (file, value); a file that is neither layout gives none."""
    as_object = F.from_json("value", OBJECT)["post_detail"]
    as_array = F.from_json("value", f"array<{POST}>")
    posts = F.when(F.startswith("value", F.lit("[")), as_array).otherwise(as_object)
    p = raw.select("file", F.explode(posts).alias("p")).where("p is not null")
    return p.select("file", F.coalesce("p.title", "p.job_title", F.lit("")).alias("title"), F.coalesce("p.content", "p.description").alias("content"), F.col("p.is_relevant").alias("is_relevant"))


def repaired(raw: DataFrame) -> DataFrame:
    """raw (file, value) with value repaired, and fixed: 0 as it was, 1 without trailing commas, 2 salvaged object by object,
    null beyond repair."""
    good = lambda c: F.from_json(c, OBJECT)["post_detail"].isNotNull() | F.from_json(c, f"array<{POST}>").isNotNull() & F.startswith(c, F.lit("["))
    commas = F.regexp_replace("value", r",(\s*[}\]])", "$1")
    parts = F.regexp_extract_all("value", F.lit(r'(\{[^{}]*"title"\s*:[^{}]*"content"\s*:[^{}]*\})'), F.lit(1))
    salvage = F.concat(F.lit('{"post_detail":['), F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, r",(\s*})", "$1")), ","), F.lit("]}"))
    fixed = F.when(good(F.col("value")), 0).when(good(commas), 1).when(F.size(parts) > 0, 2)
    out = raw.withColumn("fixed", fixed)
    return out.withColumn("value", F.when(F.col("fixed") == 1, commas).when(F.col("fixed") == 2, salvage).otherwise(F.col("value")))


def chosen_files(files: DataFrame, today: str) -> DataFrame:
    """(path) of today's files by name; without any, of the extracted ones that aren't of the job site; else all."""
    name = F.element_at(F.split("path", "/"), -1)
    f = files.withColumn("prio", F.when(F.startswith(name, F.lit(today + "_")), 0).when(F.startswith(name, F.lit("extracted_data_")) & ~F.contains(name, F.lit("topcv")), 1).otherwise(2))
    best = F.min("prio").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # a listing of files
    return f.withColumn("best", best).where((F.col("prio") == F.col("best")) | (F.col("best") == 2)).select("path")


def write_snapshot(tables: dict[str, DataFrame], path: str, force: bool = False) -> DataFrame:
    """Write each table to path/name and, last, a manifest (name, rows); an existing snapshot is an error unless forced."""
    mode = "overwrite" if force else "errorifexists"
    spark = next(iter(tables.values())).sparkSession
    rows = None
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
        n = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        rows = n if rows is None else rows.unionByName(n)
    rows.coalesce(1).write.mode(mode).json(f"{path}/manifest")
    return spark.read.schema("name string, rows long").json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The named tables; an error that lists all missing ones."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    missing = [n for n in names if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"))]
    if missing:
        raise FileNotFoundError(f"snapshot {path} lacks {', '.join(missing)}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def append_csv(df: DataFrame, path: str, columns: Sequence[str], day: str) -> None:
    """Append the columns as CSV with headers to the day's folder; further columns are left out."""
    df.select(*columns, F.col(day).alias("crawl_date")).write.mode("append").partitionBy("crawl_date").option("header", True).csv(path)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(key)).join(old, list(key), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a new value replaces the old one unless it is null."""
    cols = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias("_" + c) for c in cols])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce("_" + c, c).alias(c) for c in cols])


def profile(nodes: DataFrame, label: str, columns: Sequence[str], samples: int = 3) -> DataFrame:
    """(label, property, total, known, samples): counts in one pass, and the least different values, whole, as samples.

    Each sample is a minimum above the one before: a pass a sample, in which values are not shuffled but compared."""
    value = F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for c in columns])
    each = nodes.select(F.col(label).alias("label"), F.explode(value).alias("x")).select("label", "x.property", "x.value")
    out = each.groupBy("label", "property").agg(F.count(F.lit(1)).alias("total"), F.count("value").alias("known"), F.min("value").alias("last"))
    out = stored(out.withColumn("found", F.array_compact(F.array("last"))), "profile")
    for _ in range(samples - 1):
        before = out.select(F.col("label").alias("l"), F.col("property").alias("p"), F.col("last").alias("b"))
        more = each.join(before, F.col("label").eqNullSafe(F.col("l")) & (F.col("property") == F.col("p")) & (F.col("value") > F.col("b")))
        more = more.groupBy(F.col("label").alias("l"), F.col("property").alias("p")).agg(F.min("value").alias("next"))
        out = out.join(more, F.col("label").eqNullSafe(F.col("l")) & (F.col("property") == F.col("p")), "left")
        out = stored(out.select("label", "property", "total", "known", F.col("next").alias("last"), F.array_compact(F.array_append("found", F.col("next"))).alias("found")), "profile")
    return out.select("label", "property", "total", "known", F.array_join("found", "|").alias("samples"))


def edge_profile(edges: DataFrame, top: int = 5) -> DataFrame:
    """(type, total, place, src_label, dst_label, n): of each type of edges (type, src_label, dst_label) the pairs of labels
    that stand most often, of equals the first by name. Labels are few, so pairs are counted exactly, before any shuffle."""
    counts = edges.groupBy("type", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("type").orderBy(F.desc("n"), "src_label", "dst_label")
    counts = counts.withColumns({"total": F.sum("n").over(W.partitionBy("type")), "place": F.row_number().over(order).cast("long")})
    return counts.where(F.col("place") <= top).select("type", "total", "place", "src_label", "dst_label", "n")


def new_urls(pages: DataFrame, seen: DataFrame, ads: Sequence[str] = ("eclick",)) -> DataFrame:
    """One page for each URL that was not processed before and is no advertisement."""
    ad = F.lit(False)
    for a in ads:
        ad = ad | F.contains("url", F.lit(a))
    return pages.where(F.col("url").isNotNull() & ~ad).dropDuplicates(["url"]).join(seen.select("url"), "url", "left_anti")


class _Page(HTMLParser):
    """Title, paragraphs and list items of a page; scripts and styles are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.paragraphs, self.items, self._open, self._skip = "", [], [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1
        elif tag in ("title", "p", "li"):
            self._close()
            self._open = (tag, [])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        elif self._open and tag == self._open[0]:
            self._close()

    def handle_data(self, data):
        if self._open and not self._skip:
            self._open[1].append(data)

    def _close(self):
        if self._open:
            text = re.sub(r"\s+", " ", "".join(self._open[1])).strip()
            if text:
                if self._open[0] == "title":
                    self.title = self.title or text
                else:
                    (self.paragraphs if self._open[0] == "p" else self.items).append(text)
            self._open = None


def parse_page(html: str) -> tuple[str, str, str]:
    """(title, paragraphs joined by blank lines, list items joined by '. ')."""
    p = _Page()
    p.feed(html)
    p.close()
    p._close()
    return p.title, "\n\n".join(p.paragraphs), ". ".join(p.items)


def pages_to_articles(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, content, items, published): tag structure by a parser for each page, fields by expressions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse_page(x or "") for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "title": [g[0] for g in got], "content": [g[1] for g in got], "items": [g[2] for g in got]})

    df = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, content string, items string")
    day = F.regexp_extract("content", r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    return df.withColumn("published", F.try_to_timestamp(day, F.lit("d/M/yyyy")))


def copied_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with new ids (a hash of label and id) and edges moved to them, by equality joins."""
    n = nodes.withColumn("new_id", F.md5(F.concat_ws(":", "label", "id").cast("binary")))
    m = n.select("id", "new_id")
    e = edges.join(m.toDF("src", "new_src"), "src").join(m.toDF("dst", "new_dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
    return n, e
