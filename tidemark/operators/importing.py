"""Nodes and links of a graph from post files in two layouts: articles with entities, and job postings.

Posts have a place: their file's name, their number in it, and the place of an entity in its list. What the first or the
last mention decides is an aggregation by that place, so files are imported together and in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.sources.shared import stored

_NAMES = "array<string>"
ENTITIES = f"struct<TECH: {_NAMES}, `SKILL/TECH`: {_NAMES}, ORG: {_NAMES}, LOC: {_NAMES}, JOB_ROLE: {_NAMES}, PER: {_NAMES}>"
JOB = "struct<title: string, description: string, requirement: string, benefit: string, salary: string, due_date: string, source_url: string>"
COMPANY = "struct<name: string, field: string, size: string, location: string>"
POST = f"struct<title: string, content: string, description: string, created_at: string, entities: {ENTITIES}, job: {JOB}, company: {COMPANY}, skills: {_NAMES}, technologies: {_NAMES}>"
FILE = f"source_platform string, post_detail array<{POST}>"
UNKNOWN = "Unknown"


def placed_posts(files: DataFrame) -> DataFrame:
    """(file, pos, platform, p) of files (file, value): the posts of each in order; null entries and files that are no
    object with post_detail give none. The platform is the file's name where it isn't said."""
    f = files.select("file", F.from_json("value", FILE).alias("f"))
    each = f.select("file", F.coalesce("f.source_platform", "file").alias("platform"), F.posexplode("f.post_detail").alias("pos", "p"))
    return each.where("p is not null")


def _mentions(posts: DataFrame, names: str, kind: int) -> DataFrame:
    """(at, post, platform, name): the entries of a list of names, with their place; blank and null ones are left out."""
    at = F.struct("file", "pos", F.lit(kind).alias("kind"), "i").alias("at")
    # of a post only what the tables of mentions say of it, not its text
    title = F.coalesce("p.job.title", "p.title").alias("title")
    place = F.get("p.entities.LOC", F.lit(0)).alias("place")
    each = posts.select("file", "pos", "platform", title, place, F.posexplode(names).alias("i", "name")).where("name <> ''")
    return each.select(at, "platform", "title", "place", "name")


def _first(value: Column | str, where: Column | None = None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.min_by(value, "at") if where is None else F.min_by(F.when(where, value), F.when(where, F.col("at")))


def import_posts(files: DataFrame, as_of: str, not_companies: Sequence[str] = (), not_people: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Nodes and links of post files (file, value) of either layout, as tables:

    articles (file, pos, title, content, source, published): all posts with a title; content else description; dates that
      don't parse are as_of.
    technologies, skills (name, category, said_by): names as they are written, each once; category and platform are those
      of its first mention. Technologies are TECH, then SKILL/TECH of articles, and the technologies of jobs; skills are
      SKILL/TECH (with its category) and the skills of jobs (General).
    companies (key, name, field, size, location): each name in any case once, as first written; the first location that
      is known, where an article's companies have the first place named in it. Of articles, names above two characters;
      not_companies are left out.
    roles (key, title, level, salary, due, source_url): JOB_ROLE names and job titles in any case once, the first one's;
      levels are read from names, jobs are `mid`.
    people (name): PER names above three characters but not_people.
    article_company, job_company (title, name): the last company named under a title, the last post with it counting.
    job_skills, job_technologies (title, name, n): names under a job's title, and how often.
    Posts without a title, null entries and broken files are left out; no files: empty tables.
    """
    # files are parsed once and read by every table, which takes the columns of its own
    posts = stored(placed_posts(files), "posts")
    news = posts.where("p.job is null and p.title is not null")
    jobs = posts.where("p.job.title is not null")
    e = "p.entities."
    tech = _mentions(news, e + "TECH", 0).unionByName(skill := _mentions(news, e + "`SKILL/TECH`", 1)).unionByName(job_tech := _mentions(jobs, "p.technologies", 2))
    job_skill = _mentions(jobs, "p.skills", 1)
    category = text.tech_category("name")
    technologies = tech.withColumn("category", category).groupBy("name").agg(_first("category").alias("category"), _first("platform").alias("said_by"))
    skills = skill.withColumn("category", category).unionByName(job_skill.withColumn("category", F.lit("General")))
    skills = skills.groupBy("name").agg(_first("category").alias("category"), _first("platform").alias("said_by"))

    banned = ~F.col("name").isin(list(not_companies)) if not_companies else F.lit(True)
    orgs = _mentions(news, e + "ORG", 0).where(banned & (F.length("name") > 2))
    known = F.coalesce("place", F.lit(UNKNOWN))
    of_news = orgs.select("at", "title", "name", F.lit("Technology").alias("field"), F.lit(UNKNOWN).alias("size"), known.alias("location"))
    at_job = F.struct("file", "pos", F.lit(0).alias("kind"), F.lit(0).alias("i")).alias("at")
    of_jobs = jobs.select(at_job, F.col("p.job.title").alias("title"), F.col("p.company.name").alias("name"), F.coalesce("p.company.field", F.lit("Technology")).alias("field"), F.coalesce("p.company.size", F.lit(UNKNOWN)).alias("size"), F.coalesce("p.company.location", F.lit(UNKNOWN)).alias("location"))
    of_jobs = of_jobs.where((F.col("name") != "") & banned)
    both = of_news.unionByName(of_jobs)
    is_known = ~F.col("location").isin(UNKNOWN, "")
    companies = both.groupBy(F.lower("name").alias("key")).agg(_first("name").alias("name"), _first("field").alias("field"), _first("size").alias("size"), F.coalesce(_first("location", is_known), F.lit(UNKNOWN)).alias("location"))

    named = _mentions(news, e + "JOB_ROLE", 0).select("at", F.col("name").alias("title"), text.job_level("name").alias("level"), F.lit(None).cast("string").alias("salary"), F.lit(None).cast("date").alias("due"), F.lit("").alias("source_url"))
    posted = jobs.select(at_job, F.col("p.job.title").alias("title"), F.lit("mid").alias("level"), F.col("p.job.salary").alias("salary"), F.when(F.col("p.job.due_date") != "", text.parse_date("p.job.due_date", as_of)).cast("date").alias("due"), F.coalesce("p.job.source_url", F.lit("")).alias("source_url"))
    first = F.min_by(F.struct("title", "level", "salary", "due", "source_url"), "at").alias("r")
    roles = named.unionByName(posted).groupBy(F.lower("title").alias("key")).agg(first).select("key", "r.*")

    people = _mentions(news, e + "PER", 0).where(F.length("name") > 3).where(~F.col("name").isin(list(not_people)) if not_people else F.lit(True)).select("name").distinct()
    last = lambda df: df.groupBy("title").agg(F.max_by("name", "at").alias("name"))
    counted = lambda df: df.groupBy("title", "name").agg(F.count(F.lit(1)).alias("n"))
    articles = news.select("file", "pos", F.col("p.title").alias("title"), F.coalesce("p.content", "p.description", F.lit("")).alias("content"), text.source_name("platform").alias("source"), text.parse_date("p.created_at", as_of).alias("published"))
    return {
        "articles": articles, "technologies": technologies, "skills": skills, "companies": companies, "roles": roles, "people": people,
        "article_company": last(of_news), "job_company": last(of_jobs), "job_skills": counted(job_skill), "job_technologies": counted(job_tech),
    }
