"""The driver's tables under the names that the operators use. Every view reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reference date of all time-dependent queries; the tables hold a fixed past.
AS_OF = "2001-07-15"
EVENTS_AS_OF = "2024-01-20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as job posts; the title is the priority and the status."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"), F.col("o_orderdate").cast("timestamp").alias("posted_at"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("salary"))


def technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as technologies; names repeat, and every third one stands in upper case."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tech_id"), name.alias("name"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("trend_score"))


def requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("tech_id"))


def uses_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uses with its repeated rows."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company_id"), F.col("l_partkey").alias("tech_id"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uses_lines(spark, sf_dir).distinct()


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"), F.col("n_name").alias("location"), F.col("s_acctbal").alias("rating"))


def hires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company of each job: the least supplier of its lines."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.min("l_suppkey").alias("company_id"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first line is the title."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("article_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), "lang", "source")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("ip"), F.col("event_type").alias("keyword"), "value")


#: The same views in SQL, as leading common table expressions.
SQL = {
    "jobs": "jobs as (select o_orderkey as job_id, o_orderpriority || ' ' || o_orderstatus as title, o_orderdate as posted_at, o_custkey as user_id, o_totalprice as salary from orders)",
    "technologies": "technologies as (select p_partkey as tech_id, case when p_partkey % 3 = 0 then upper(p_name) else p_name end as name, p_type as category, p_retailprice as trend_score from part)",
    "requires": "requires as (select l_orderkey as job_id, l_partkey as tech_id from lineitem)",
    "uses": "uses as (select distinct l_suppkey as company_id, l_partkey as tech_id from lineitem)",
    "companies": "companies as (select s_suppkey as company_id, s_name as name, n_name as location, s_acctbal as rating from supplier left join nation on s_nationkey = n_nationkey)",
    "hires": "hires as (select l_orderkey as job_id, min(l_suppkey) as company_id from lineitem group by 1)",
    "articles": "articles as (select doc_id as article_id, split_part(text, chr(10), 1) as title, text as content, lang, source from documents)",
    "visits": "visits as (select ts, cast(user_id as varchar) as ip, event_type as keyword, value from events)",
}


def with_views(*names: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names)
