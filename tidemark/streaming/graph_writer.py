"""The graph writer: extracted articles and jobs become six tables of nodes and edges, batch by batch.

Each batch writes what its messages say; readers merge the whole batches by key. So a batch that is run again, or a message
that is delivered twice, changes nothing: edges are sets, counts are counts of edges, and of two values for one node the one
of the later message stays, in whatever order they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.sources.batches import read_batches, write_batch
from tidemark.sources.shared import stored

ENTITIES = "struct<TECH: array<string>, ORG: array<string>, LOC: array<string>>"
JOB = "struct<title: string, description: string, requirement: string, benefit: string, salary: string, source_url: string>"
DATA = f"struct<title: string, content: string, source_url: string, publish_date: string, entities: {ENTITIES}, job: {JOB}, company: struct<name: string, location: string>, skills: array<string>, technologies: array<string>>"
EXTRACTED = f"message_type string, source_platform string, extracted_at timestamp, data {DATA}"
#: The six tables. at: the time of the message that says it.
TABLES = {
    "posts": "id string, label string, name string, content string, requirement string, benefit string, salary string, url string, source_platform string, publish_date string, at timestamp",
    "technologies": "name string", "companies": "id string, name string, at timestamp, location string, location_at timestamp", "places": "name string", "skills": "name string",
    "edges": "type string, src string, dst_label string, dst string",
}


def messages(raw: DataFrame) -> DataFrame:
    """Well-formed extracted messages of raw (value): those with a URL, of an article or a job. Others are left out."""
    # a generated row is parsed once; a filter would be moved below a projection, and parse again for each condition
    e = raw.select(F.inline(F.array(F.from_json("value", EXTRACTED))))
    url = F.coalesce("data.job.source_url", "data.source_url")
    return e.withColumn("url", url).where("data is not null and url is not null and message_type in ('extracted_article', 'extracted_job')")


def company_id(name: Column) -> Column:
    return text.slug(name)


def said(m: DataFrame) -> DataFrame:
    """A row a message: the columns of its post, its edges (type, dst_label, dst), each once, and its companies (id, name,
    location). Names are cleaned here, once for all tables, and no table but posts takes the text."""
    job = F.col("message_type") == "extracted_job"
    d, j = "data.", "data.job."
    of_job = lambda c: F.when(job, F.col(j + c)).alias(c)
    none = F.array().cast("array<string>")
    each = lambda c, f=lambda x: x: F.array_distinct(F.transform(F.coalesce(c, none), f))
    filled = lambda names: F.filter(names, lambda x: F.trim(x) != "")
    company = lambda name, location: F.struct(company_id(name).alias("id"), name.alias("name"), location.cast("string").alias("location"))
    named = F.transform(each(F.col(d + "entities.ORG"), text.clean_entity), lambda x: company(x, F.lit(None)))
    posted = F.array(company(F.col(d + "company.name"), F.col(d + "company.location")))
    m = m.select(
        F.md5(F.col("url").cast("binary")).alias("id"), F.when(job, "Job").otherwise("Article").alias("label"), F.when(job, F.col(j + "title")).otherwise(F.col(d + "title")).alias("name"),
        F.when(job, F.col(j + "description")).otherwise(F.col(d + "content")).alias("content"), *[of_job(c) for c in ("requirement", "benefit", "salary")],
        "url", "source_platform", F.when(~job, F.col(d + "publish_date")).alias("publish_date"), F.col("extracted_at").alias("at"),
        F.filter(each(F.when(job, F.col(d + "technologies")).otherwise(F.col(d + "entities.TECH")), lambda x: F.upper(text.clean_entity(x))), lambda x: x != "").alias("techs"),
        filled(each(F.when(job, F.col(d + "skills")))).alias("skills"), filled(each(F.when(~job, F.col(d + "entities.LOC")))).alias("places"),
        F.filter(F.when(job, posted).otherwise(named), lambda x: (x["name"] != "") & (x["id"] != "")).alias("companies"),
    )
    is_job = F.col("label") == "Job"
    of_post, of_company = F.when(is_job, "REQUIRES").otherwise("MENTIONS"), F.when(is_job, "POSTED_BY").otherwise("MENTIONS")
    edge = lambda names, kind, label: F.transform(names, lambda x: F.struct(kind.alias("type"), F.lit(label).alias("dst_label"), x.alias("dst")))
    edges = [edge("techs", of_post, "Technology"), edge("skills", F.lit("REQUIRES"), "Skill"), edge("places", F.lit("MENTIONS"), "Location"), edge(F.array_distinct(F.coalesce("companies.id", none)), of_company, "Company")]
    # one entry at most for each name, of each label
    return m.select(*[c for c in m.columns if c not in ("techs", "skills", "places")], F.concat(*[F.coalesce(e, F.array()) for e in edges]).alias("edges"))


def batch_tables(s: DataFrame) -> dict[str, DataFrame]:
    """The rows of the six tables that messages say (as `said` gives them, or messages). Tables of names are merged here,
    which leaves few rows; posts and edges, a row or more a message, are not shuffled, since readers merge them once for all
    batches."""
    s = said(s) if "message_type" in s.columns else s
    edges = s.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select("e.type", "src", "e.dst_label", "e.dst")
    company = s.select("at", F.explode("companies").alias("c")).select("c.id", "c.name", "at", "c.location", F.col("at").alias("location_at"))
    names = lambda label: edges.where(F.col("dst_label") == label).select(F.col("dst").alias("name")).distinct()
    return {
        "posts": s.drop("edges", "companies"), "technologies": names("Technology"), "companies": merged_companies(company), "places": names("Location"), "skills": names("Skill"), "edges": edges,
    }


def latest(posts: DataFrame) -> DataFrame:
    """One row an id: of the latest message, of equally late ones the greatest row."""
    columns = TABLES["posts"].split(", ")
    names = [c.split()[0] for c in columns]
    whole = F.max(F.struct("at", *[c for c in names if c not in ("id", "at")])).alias("p")
    # dealt out before they are aggregated, so that texts are sorted once, not on both sides of the shuffle
    return posts.repartition("id").groupBy("id").agg(whole).select(*[F.col("id") if c == "id" else F.col(f"p.{c}") for c in names])


def merged_companies(rows: DataFrame) -> DataFrame:
    """One row an id: the latest name, and the latest location that is set, each with its time."""
    name = F.max(F.struct("at", "name"))
    location = F.max(F.when(F.col("location").isNotNull(), F.struct("location_at", "location")))
    return rows.groupBy("id").agg(name.alias("n"), location.alias("l")).select("id", "n.name", "n.at", "l.location", "l.location_at")


def write_graph(stream: DataFrame, folder: str, checkpoint: str, before_mark: Callable[[str, int], None] | None = None) -> None:
    """Run the writer over all that its source holds now. stream has `value`, the JSON of a message. before_mark(name, batch)
    is called before each table is written (a test can raise there)."""

    def save(df: DataFrame, batch: int) -> None:
        # six tables are made of one parsed batch
        parsed = said(messages(df.select("value"))).persist()
        tables = batch_tables(parsed)
        if before_mark is not None:
            for i, name in enumerate(tables):
                before_mark(name, batch)
                if i + 1 < len(tables):
                    tables[name].write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
        write_batch(tables, folder, batch)
        parsed.unpersist()

    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()


def distinct_edges(posts: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge once. A message says each of its edges once, so only those of posts with several messages are compared."""
    again = stored(posts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("src")), "said-again")
    return edges.join(again, "src", "left_anti").unionByName(edges.join(again, "src", "left_semi").distinct()).select(*edges.columns)


def read_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six tables as the whole batches say; technologies and skills with the number of posts that name them."""
    t = {name: read_batches(spark, folder, name, schema).drop("batch") for name, schema in TABLES.items()}
    edges = distinct_edges(t["posts"], t["edges"])
    counts = edges.groupBy("dst_label", F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("mention_count"))
    counted = lambda name, label: t[name].distinct().join(counts.where(F.col("dst_label") == label).drop("dst_label"), "name")
    return {
        "posts": latest(t["posts"]), "technologies": counted("technologies", "Technology"), "companies": merged_companies(t["companies"]),
        "places": t["places"].distinct(), "skills": counted("skills", "Skill"), "edges": edges,
    }
