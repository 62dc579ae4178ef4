"""Registered queries on sources, sinks and streams (SURVEY groups A and L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import views as v
from tidemark.sources import posts
from tidemark.sources.shared import new_folder, stored
from tidemark.streaming import streams

TERMS = (("token", "license", "apache license"), ("clown", "idiot"), ("of the",))


def _files(spark, sf):
    """Documents as post files in both layouts, every seventh with a trailing comma and every eleventh broken."""
    d = v.table(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    rec = F.to_json(F.struct(F.col("t").alias("title"), F.lit("c").alias("content"), (F.col("doc_id") % 2 == 0).alias("is_relevant")))
    job = F.to_json(F.struct(F.col("t").alias("job_title"), F.lit("c").alias("description"), F.lit(True).alias("is_relevant")))
    obj = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"post_detail":['), rec, F.lit(",]}"))).when(F.col("doc_id") % 11 == 0, F.concat(F.lit('{"post_detail":[{"x": '), rec, F.lit(" , "))).otherwise(F.concat(F.lit('{"source_platform":"s","post_detail":['), rec, F.lit("]}")))
    value = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), job, F.lit("]"))).otherwise(obj)
    return d.select(F.col("doc_id").cast("string").alias("file"), value.alias("value"))


def a1_posts(spark, sf):
    p = posts.posts_of(_files(spark, sf))
    return p.groupBy("is_relevant").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("title")).alias("chars"))


def a2_repaired(spark, sf):
    r = posts.repaired(_files(spark, sf))
    return r.groupBy(F.col("fixed").cast("long").alias("fixed")).agg(F.count(F.lit(1)).alias("n"))


def a2_posts_after_repair(spark, sf):
    p = posts.posts_of(posts.repaired(_files(spark, sf)).select("file", "value"))
    return p.select(F.col("file").cast("long").alias("doc_id"), F.length("title").cast("long").alias("chars"))


def b9_relevant(spark, sf):
    p = posts.posts_of(_files(spark, sf))
    return p.where("is_relevant = true").agg(F.count(F.lit(1)).alias("n"))


def a3_dropped_fields(spark, sf):
    return v.table(spark, sf, "customer").drop("c_acctbal", "c_nationkey")


def a4_first_records(spark, sf):
    return v.table(spark, sf, "orders").orderBy("o_orderkey").limit(10_000).select("o_orderkey", "o_orderstatus")


def a5_chosen_files(spark, sf):
    """Pages as a listing of files."""
    p = v.table(spark, sf, "pages").select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/d/06_05_2026_s"), "page_id")).otherwise(F.concat(F.lit("/d/extracted_data_"), "page_id")).alias("path"))
    return posts.chosen_files(p, "06_05_2026")


def a6_snapshot(spark, sf):
    t = {"jobs": v.jobs(spark, sf), "companies": v.companies(spark, sf), "uses": v.uses(spark, sf)}
    return posts.write_snapshot(t, new_folder(spark, "snapshot"))


def a7_read_snapshot(spark, sf):
    path = new_folder(spark, "snapshot")
    posts.write_snapshot({"uses": v.uses(spark, sf)}, path)
    return posts.read_snapshot(spark, path, ["uses"])["uses"]


def a8_csv(spark, sf):
    path = new_folder(spark, "csv")
    o = v.table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy"))
    posts.append_csv(o, path, ["o_orderkey", "o_orderstatus"], "day")
    return spark.read.option("header", True).schema("o_orderkey long, o_orderstatus string, crawl_date int").csv(path).groupBy(F.col("crawl_date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def a10_json(spark, sf):
    path = new_folder(spark, "json")
    v.articles(spark, sf).select("article_id", F.substring("content", 1, 200).alias("content")).write.json(path)
    return spark.read.schema("article_id long, content string").json(path)


def a12_kafka_rows(spark, sf):
    return streams.kafka_rows(v.table(spark, sf, "pages").select("page_id", "url"), "url")


def a13_publish(spark, sf):
    """A versioned folder, then its manifest."""
    m = posts.write_snapshot({"region": v.table(spark, sf, "region"), "nation": v.table(spark, sf, "nation")}, new_folder(spark, "artifacts"), force=True)
    return m


def a14_copied_graph(spark, sf):
    t = v.technologies(spark, sf).select(F.concat(F.lit("t"), "tech_id").alias("id"), F.lit("T").alias("label"))
    c = v.companies(spark, sf).select(F.concat(F.lit("c"), "company_id").alias("id"), F.lit("C").alias("label"))
    u = v.uses(spark, sf).select(F.concat(F.lit("c"), "company_id").alias("src"), F.concat(F.lit("t"), "tech_id").alias("dst"))
    n, e = posts.copied_graph(t.unionByName(c), u)
    return e.groupBy("src").agg(F.count(F.lit(1)).alias("edges"))


def a15_profile(spark, sf):
    return posts.profile(v.table(spark, sf, "customer"), "c_mktsegment", ["c_name", "c_nationkey"])


def a15_edge_profile(spark, sf):
    """Edges of all kinds with the labels of their ends; jobs are labelled by their title, technologies by their type."""
    t = v.technologies(spark, sf).select("tech_id", F.col("category").alias("dst_label"))
    r = v.requires(spark, sf).join(v.jobs(spark, sf).select("job_id", F.col("title").alias("src_label")), "job_id").join(t, "tech_id")
    u = v.uses(spark, sf).join(v.companies(spark, sf).select("company_id", F.col("location").alias("src_label")), "company_id").join(t, "tech_id")
    e = [df.select(F.lit(kind).alias("type"), "src_label", "dst_label") for kind, df in (("REQUIRES", r), ("USES", u))]
    return posts.edge_profile(e[0].unionByName(e[1]))


def a16_articles(spark, sf):
    a = posts.pages_to_articles(v.table(spark, sf, "pages"))
    return a.select("page_id", "title", F.length("content").cast("long").alias("chars"), (F.length("items") > 0).alias("has_items"))


def a17_new_urls(spark, sf):
    p = v.table(spark, sf, "pages")
    seen = p.where("page_id % 3 = 0").select("url")
    return posts.new_urls(p.select("url"), seen, ("top",))


def a18_capped(spark, sf):
    return v.table(spark, sf, "pages").orderBy("page_id").limit(150).select("page_id", "url")


def a19_ignore(spark, sf):
    e = v.visits(spark, sf).select(F.to_date("ts").alias("day"), "ip")
    old = e.where("day < date'2024-01-10'").distinct()
    return posts.insert_or_ignore(old, e, ["day", "ip"])


def a19_upsert(spark, sf):
    c = v.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    old = c.where("c_custkey % 2 = 0")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return posts.upsert(old, new, "c_custkey")


def _stream(df, files_per_batch=4):
    """A table that is read again as a stream of files."""
    t = stored(df, "stream-source")
    return df.sparkSession.readStream.schema(t.schema).option("maxFilesPerTrigger", files_per_batch).parquet(t.inputFiles()[0].rsplit("/", 1)[0])


def _messages(spark, sf):
    d = v.table(spark, sf, "documents")
    data = F.struct(F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), F.concat(F.lit("u"), "doc_id").alias("source_url"), F.array(F.lit("Go")).alias("skills"))
    m = F.to_json(F.struct(F.lit("raw").alias("message_type"), F.col("source").alias("source_platform"), F.lit("2024-01-01T00:00:00Z").alias("crawled_at"), data.alias("data")))
    return d.select(F.when(F.col("doc_id") % 13 == 0, F.lit("{broken")).otherwise(m).alias("value"))


def l1_extraction(spark, sf):
    s = streams.extracted(_stream(_messages(spark, sf)), *TERMS)
    out = streams.run_once(s)
    return out.select("source_url", F.md5(F.col("source_url").cast("binary")).alias("key"), F.array_join("techs", "|").alias("techs"), F.array_join("roles", "|").alias("roles"))


def l2_technology_mentions(spark, sf):
    """Technology nodes from the extraction stream, each message once."""
    s = streams.extracted(_stream(_messages(spark, sf)), *TERMS).select("source_url", F.explode("techs").alias("name"))
    out = streams.run_once(s).dropDuplicates(["source_url", "name"])
    return out.groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("mentions"))


def l3_vectors(spark, sf):
    m = streams.parsed(_stream(_messages(spark, sf), 24)).where("not bad")
    out = streams.run_once(streams.vectors_of(m, 16))
    return out.select("source_url", F.array_join(F.transform("embedding", lambda x: F.format_number(x, 4)), " ").alias("embedding"))


def l5_dead_letters(spark, sf):
    out = streams.run_once(streams.parsed(_stream(_messages(spark, sf))).select("value", "bad"))
    return out.groupBy("bad").agg(F.count(F.lit(1)).alias("n"))


def l6_unique_visits(spark, sf):
    return streams.run_once(streams.unique_visits(_stream(v.visits(spark, sf)), "60 days")).select("day", "ip")


def l7_daily_keywords(spark, sf):
    """The last state of each window, as update mode gives it."""
    out = streams.run_once(streams.daily_keywords(_stream(v.visits(spark, sf)), "60 days"), "update")
    return out.groupBy("day", "keyword").agg(F.max("searches").alias("searches"))


def l8_mention_counts(spark, sf):
    out = streams.run_once(streams.mention_counts(_stream(v.visits(spark, sf)).select(F.col("keyword").alias("name"))), "update")
    return out.groupBy("name").agg(F.max("mentions").alias("mentions"))


NAMES = [n for n in list(globals()) if n[0] in "abl" and n[1].isdigit()]
QUERIES = {k: globals()[k] for k in NAMES}
ORACLES = {
    "a1_posts": "select case when doc_id % 3 = 0 then true else doc_id % 2 = 0 end as is_relevant, count(*) as n, sum(length(text))::bigint as chars from documents where doc_id % 3 = 0 or (doc_id % 7 <> 0 and doc_id % 11 <> 0) group by 1",
    "a2_repaired": "select case when doc_id % 3 = 0 then 0 when doc_id % 7 = 0 then 1 when doc_id % 11 = 0 then 2 else 0 end::bigint as fixed, count(*) as n from documents group by 1",
    "a2_posts_after_repair": "select doc_id, length(text) as chars from documents",
    "b9_relevant": "select count(*) as n from documents where doc_id % 3 = 0 or (doc_id % 7 <> 0 and doc_id % 11 <> 0 and doc_id % 2 = 0)",
    "a3_dropped_fields": "select c_custkey, c_name, c_mktsegment from customer",
    "a4_first_records": "select o_orderkey, o_orderstatus from orders order by o_orderkey limit 10000",
    "a5_chosen_files": "select '/d/06_05_2026_s' || page_id as path from pages where page_id % 5 = 0",
    "a6_snapshot": v.with_views("uses") + " select 'jobs' as name, (select count(*) from orders) as rows union all select 'companies', (select count(*) from supplier) union all select 'uses', (select count(*) from uses)",
    "a7_read_snapshot": v.with_views("uses") + " select * from uses",
    "a8_csv": "select year(o_orderdate) as year, count(*) as n from orders group by 1",
    "a10_json": "select doc_id as article_id, substr(text, 1, 200) as content from documents",
    "a12_kafka_rows": """select md5(url) as key, '{"page_id":' || page_id || ',"url":"' || url || '"}' as value from pages""",
    "a13_publish": "select 'region' as name, (select count(*) from region) as rows union all select 'nation', (select count(*) from nation)",
    "a14_copied_graph": v.with_views("uses") + " select md5('C:c' || company_id) as src, count(*) as edges from uses group by 1",
    "a15_profile": "with x as (select c_mktsegment as label, 'c_name' as property, c_name as s from customer union all select c_mktsegment, 'c_nationkey', cast(c_nationkey as varchar) from customer), g as (select label, property, count(*) as total, count(s) as known, list_sort(list_distinct(list(s)))[1:3] as l from x group by 1, 2) select label, property, total, known, array_to_string(l, '|') as samples from g",
    "a15_edge_profile": v.with_views("technologies", "requires", "jobs", "uses", "companies") + """, e as (select 'REQUIRES' as type, title as src_label, category as dst_label from requires join jobs using (job_id) join technologies using (tech_id) union all select 'USES', location, category from uses join companies using (company_id) join technologies using (tech_id)),
        n as (select type, src_label, dst_label, count(*) as n from e group by 1, 2, 3), p as (select *, sum(n) over (partition by type)::bigint as total, row_number() over (partition by type order by n desc, src_label nulls first, dst_label nulls first) as place from n) select * from p where place <= 5""",
    "a17_new_urls": "select distinct url from pages where not contains(url, 'top') and url not in (select url from pages where page_id % 3 = 0)",
    "a18_capped": "select page_id, url from pages order by page_id limit 150",
    "a19_ignore": "select distinct cast(ts as date) as day, cast(user_id as varchar) as ip from events",
    "a19_upsert": "select c_custkey, case when c_custkey % 3 = 0 then upper(c_name) else c_name end as c_name, case when c_custkey % 2 = 0 then c_mktsegment end as c_mktsegment from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0",
    "l5_dead_letters": "select doc_id % 13 = 0 as bad, count(*) as n from documents group by 1",
    "l6_unique_visits": "select distinct cast(ts as date) as day, cast(user_id as varchar) as ip from events",
    "l7_daily_keywords": "select cast(ts as date) as day, event_type as keyword, count(*) as searches from events group by 1, 2",
    "l8_mention_counts": "select event_type as name, count(*) as mentions from events group by 1",
}
#: The phrases of messages, each once by lower case: signs are doubled, so that neighbouring phrases have one each.
_MESSAGES = r"""with m as (select 'u' || doc_id as source_url, regexp_replace(substr(text, 1, 60) || ' ' || text, '([^\p{L}\p{N}_.])', '\1\1', 'g') as t from documents where doc_id % 13 <> 0),
f as (select source_url, [replace(x, '  ', ' ') for x in regexp_extract_all(t, '(?i)(?:^|[^\p{L}\p{N}_.])(apache  license|license|token)(?:[^\p{L}\p{N}_.]|$)', 1)] as techs,
  regexp_extract_all(t, '(?i)(?:^|[^\p{L}\p{N}_.])(clown|idiot)(?:[^\p{L}\p{N}_.]|$)', 1) as roles from m),
o as (select source_url, list_append([x for x, i in techs if list_position([lower(y) for y in techs], lower(x)) = i], 'Go') as techs, [x for x, i in roles if list_position([lower(y) for y in roles], lower(x)) = i] as roles from f)
"""
ORACLES["l1_extraction"] = _MESSAGES + "select source_url, md5(source_url) as key, array_to_string(techs, '|') as techs, array_to_string(roles, '|') as roles from o"
ORACLES["l2_technology_mentions"] = _MESSAGES + "select lower(name) as name, count(*) as mentions from (select distinct source_url, unnest(techs) as name from o) group by 1"
