"""Registered queries of the shared filters, orders, caps and calendars (SURVEY groups B to I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import spans, text
from tidemark.operators import basics, entities
from tidemark.plans import views as v

ROLES = ("ring", "blue ring", "widget", "red widget", "gear")


def _nodes(spark, sf):
    """Nodes of three labels with what a result shows of them."""
    t = v.technologies(spark, sf).select(F.lit("Technology").alias("label"), F.col("tech_id").alias("id"), "name")
    c = v.companies(spark, sf).select(F.lit("Company").alias("label"), F.col("company_id").alias("id"), "name")
    j = v.jobs(spark, sf).select(F.lit("Job").alias("label"), F.col("job_id").alias("id"), F.col("title").alias("name"))
    return t.unionByName(c).unionByName(j)


def b2_substring(spark, sf):
    return v.technologies(spark, sf).where(basics.contains_any("name", ["RING", "bolt"])).select("tech_id", "name")


def b3_membership(spark, sf):
    return v.technologies(spark, sf).where(basics.is_any("name", ["Blue Ring", "small widget", "RED BOLT"])).select("tech_id", "name")


def b4_labels(spark, sf):
    return basics.with_labels(_nodes(spark, sf), ["Technology", "Company"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


def b6_window(spark, sf):
    w = basics.in_window(v.jobs(spark, sf), "posted_at", v.AS_OF, 9)
    return w.groupBy(F.date_format("posted_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def b7_complete(spark, sf):
    h = v.hires(spark, sf).where("company_id > 5")
    j = v.jobs(spark, sf).join(h, "job_id", "left")
    return basics.complete(j, "title", "company_id").select("job_id", "company_id")


def b8_defaults(spark, sf):
    h = v.hires(spark, sf).where("company_id > 5").join(v.companies(spark, sf), "company_id")
    j = v.jobs(spark, sf).join(h, "job_id", "left")
    return j.select("job_id", F.coalesce("name", F.lit("")).alias("company"), F.coalesce("rating", F.lit(0.0)).alias("rating"))


def b10_matching_nodes(spark, sf):
    """Jobs as nodes, with the place of their company and its rating in place of a sentiment."""
    h = v.hires(spark, sf).join(v.companies(spark, sf), "company_id")
    n = v.jobs(spark, sf).join(h, "job_id", "left").select("job_id", F.col("salary").alias("pay"), F.col("rating").alias("sentiment"), "location")
    return basics.matching_nodes(n, 200_000, 1_000, "nation_1").select("job_id", "pay", "location")


def b11_named(spark, sf):
    return basics.named(v.companies(spark, sf), "location", ["NATION_10", "nation_2"], 8).select("company_id", "location")


def b13_without_content(spark, sf):
    a = v.articles(spark, sf)
    kept = basics.without_keys(F.create_map(F.lit("title"), "title", F.lit("content"), "content", F.lit("lang"), "lang"))
    return a.select("article_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"), kept["title"].alias("title"))


def b18_response(spark, sf):
    s = F.struct(F.col("tech_id").alias("id"), F.lower("name").alias("label"), F.round("trend_score", 2).alias("score"))
    return v.technologies(spark, sf).select(F.to_json(s).alias("node"))


def _scored(spark, sf):
    """Lines of orders as candidates: the part's discount as its score."""
    li = v.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.max(F.round(F.col("l_discount") * 5, 2)).alias("score"))


def b17_threshold(spark, sf):
    return _scored(spark, sf).where("score >= 0.40")


def f8_reranked(spark, sf):
    return basics.reranked(_scored(spark, sf), ["query_id"], 0.4).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"), "low_confidence")


def f3_month_order(spark, sf):
    n = v.jobs(spark, sf).groupBy(F.year("posted_at").alias("year"), F.month("posted_at").alias("month"), "title").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy("year", "month", "title").select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "title", "n")


def f4_capped(spark, sf):
    return basics.capped(v.jobs(spark, sf), 500, F.desc("salary"), "job_id").select("job_id", "salary")


def f9_members(spark, sf):
    """Places with the names of their companies in order."""
    return v.companies(spark, sf).groupBy("location").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("members"))


def c5_neighbours(spark, sf):
    """Both ends' neighbours of the companies of one place, whichever way an edge points."""
    u = v.uses(spark, sf).select((F.col("company_id") + 1_000_000_000).alias("a"), F.col("tech_id").alias("b"))
    both = u.unionByName(u.select(F.col("b").alias("a"), F.col("a").alias("b")))
    start = v.companies(spark, sf).where("location = 'NATION_3'").select((F.col("company_id") + 1_000_000_000).alias("a"))
    return both.join(start, "a").select(F.col("a").alias("center"), F.col("b").alias("neighbour"))


def c9_visits_by_month(spark, sf):
    s = basics.month_spine(v.visits(spark, sf), "ts", "2023-10-05", "2024-03-01")
    return s.select(F.date_format("month", "yyyy-MM").alias("month"), "n")


def c14_same_names(spark, sf):
    """Parts' types as skills that carry the name of a technology."""
    skills = v.table(spark, sf, "part").select(F.col("p_partkey").alias("skill_id"), F.lower("p_name").alias("name"))
    t = v.technologies(spark, sf).groupBy(F.lower("name").alias("name")).agg(F.min("tech_id").alias("tech_id"))
    return skills.join(t, "name").select("skill_id", "tech_id")


def c17_titles(spark, sf):
    """Jobs whose title holds a word."""
    j = v.jobs(spark, sf)
    hits = F.filter(F.array(*[F.lit(w) for w in ("URGENT", "HIGH", "low", "f")]), lambda w: F.contains(F.lower("title"), F.lower(w)))
    return j.select("job_id", F.explode(hits).alias("word"))


def e5_previous(spark, sf):
    n = v.jobs(spark, sf).groupBy("title", F.trunc("posted_at", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumns({"before": basics.previous(n, "n", "month", 1, "title"), "year_before": basics.previous(n, "n", "month", 12, "title")})
    return n.select("title", F.date_format("month", "yyyy-MM").alias("month"), "n", "before", "year_before")


def h28_rates(spark, sf):
    n = v.jobs(spark, sf).groupBy("title", F.trunc("posted_at", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("rate", basics.rate(F.col("n"), basics.previous(n, "n", "month", 1, "title")))
    return n.select("title", F.date_format("month", "yyyy-MM").alias("month"), F.round("rate", 4).alias("rate"))


def g3_missing(spark, sf):
    """Parts of which nobody returned a large number."""
    back = v.table(spark, sf, "lineitem").where("l_quantity >= 49 and l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return v.table(spark, sf, "part").select("p_partkey").exceptAll(back.distinct())


def g7_relinked(spark, sf):
    """Edges between technologies of one company, moved to the least id of their name."""
    t = v.technologies(spark, sf).select(F.col("tech_id").alias("id"), F.lower("name").alias("name"))
    canonical = t.join(t.groupBy("name").agg(F.min("id").alias("canonical")), "name").select("id", "canonical")
    li = v.table(spark, sf, "lineitem")
    edges = li.select("l_orderkey", F.col("l_partkey").alias("a")).where("l_linenumber = 1").join(li.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey")
    return basics.relinked(edges, canonical)


def h23_calendar(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return v.table(spark, sf, "orders").select("o_orderkey", F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"), F.date_format(F.trunc(d, "MM"), "yyyy-MM-dd").alias("start"), F.date_format(F.add_months(F.trunc(d, "MM"), -5), "yyyy-MM").alias("back"))


def h25_labels(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return v.table(spark, sf, "orders").select("o_orderkey", basics.month_label(d).alias("label"), (F.year(d) * 100 + F.month(d)).cast("long").alias("place"))


def h27_math(spark, sf):
    x = F.col("c_acctbal")
    return v.table(spark, sf, "customer").select("c_custkey", F.round(F.log1p(F.abs(x)), 6).alias("log"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / 10_000)).alias("clipped"), F.round(F.exp(-F.abs(x) / 5_000), 6).alias("decay"))


def h30_prefixed(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", text.prefixed("url", "query").alias("query"), text.prefixed("url", "passage").alias("passage"))


def i3_roles(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", F.array_join(spans.phrases("p_name", ROLES), "|").alias("roles"))


def i7_people(spark, sf):
    t = F.concat(F.lit("met "), F.initcap("p_name"), F.lit(" with Anna Weber, iOS and Go"))
    return v.table(spark, sf, "part").select("p_partkey", F.array_join(basics.people(t, ("Ring",)), "|").alias("people"))


def _asked(spark, sf):
    """A question about each company's jobs."""
    c = v.companies(spark, sf)
    return c.select("company_id", F.concat(F.lit("Which jobs for a Blue Ring are at "), "name", F.lit(" in "), F.coalesce("location", F.lit("")), F.lit("?")).alias("question"))


def i12_query_entities(spark, sf):
    """Companies, places and technologies that questions name, by dictionaries of all of them."""
    c = v.companies(spark, sf)
    names = c.select("name", F.lit("ORG").alias("label")).unionByName(c.select(F.col("location").alias("name"), F.lit("LOC").alias("label")))
    names = names.unionByName(v.technologies(spark, sf).select("name", F.lit("TECH").alias("label")))
    return entities.dictionary_entities(_asked(spark, sf), names, "company_id", "question").select(F.col("id").alias("company_id"), "label", "name", "n")


def _post_graph(spark, sf):
    a = v.articles(spark, sf)
    names = spark.createDataFrame([("idiot", "TECH"), ("Clown", "TECH"), ("of the", "TECH"), ("apache license", "ORG")], "name string, label string")
    found = entities.dictionary_entities(a, names, "article_id", "content")
    return entities.post_graph(a.select(F.col("article_id").alias("id"), "title", F.col("source").alias("author")), found)


def j13_nodes(spark, sf):
    return _post_graph(spark, sf)[0]


def j14_edges(spark, sf):
    """MENTIONS of technologies and organisations, and WROTE."""
    return _post_graph(spark, sf)[1]


NAMES = [n for n in list(globals()) if n[0] in "bcefghij" and n[1].isdigit()]
QUERIES = {k: globals()[k] for k in NAMES}

#: Words of each text in order, and how often each name stands among them.
MENTIONS = """w as (select article_id, ' ' || array_to_string(list_transform(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}#_+.]+'), lambda x: x <> ''), lambda x: rtrim(x, '.') || ' '), ' ') as t from articles),
k as (select unnest(['idiot', 'clown', 'of the', 'apache license']) as name, unnest(['TECH', 'TECH', 'TECH', 'ORG']) as label),
e as (select article_id, label, name, len(regexp_extract_all(t, ' ' || replace(name, ' ', '  ') || ' ')) as n from w, k where contains(t, ' ' || replace(name, ' ', '  ') || ' '))"""
ORACLES = {
    "b2_substring": v.with_views("technologies") + " select tech_id, name from technologies where contains(lower(name), 'ring') or contains(lower(name), 'bolt')",
    "b3_membership": v.with_views("technologies") + " select tech_id, name from technologies where lower(name) in ('blue ring', 'small widget', 'red bolt')",
    "b4_labels": v.with_views("technologies", "companies") + " select 'Technology' as label, count(*) as n, count(distinct name) as names from technologies union all select 'Company', count(*), count(distinct name) from companies",
    "b6_window": v.with_views("jobs") + " select strftime(posted_at, '%Y-%m') as month, count(*) as n from jobs where posted_at::date >= date '2000-10-15' and posted_at::date < date '2001-08-01' group by 1",
    "b7_complete": v.with_views("jobs", "hires") + " select job_id, company_id from jobs join hires using (job_id) where title is not null and company_id > 5",
    "b8_defaults": v.with_views("jobs", "hires", "companies") + ", h as (select job_id, name, rating from hires join companies using (company_id) where company_id > 5) select job_id, coalesce(name, '') as company, coalesce(rating, 0.0) as rating from jobs left join h using (job_id)",
    "b10_matching_nodes": v.with_views("jobs", "hires", "companies") + " select job_id, salary as pay, location from jobs join hires using (job_id) join companies using (company_id) where salary >= 200000 and rating >= 1000 and contains(lower(location), 'nation_1')",
    "b11_named": v.with_views("companies") + " select company_id, location from companies where length(location) > 8 and lower(location) not in ('nation_10', 'nation_2')",
    "b13_without_content": v.with_views("articles") + " select article_id, 'lang,title' as keys, title from articles",
    "b18_response": v.with_views("technologies") + """ select '{"id":' || tech_id || ',"label":"' || lower(name) || '","score":' || cast(round(trend_score, 2) as varchar) || '}' as node from technologies""",
    "b17_threshold": "select * from (select l_orderkey as query_id, l_partkey as id, max(round(l_discount * 5, 2)) as score from lineitem group by 1, 2) where score >= 0.40",
    "f8_reranked": "with s as (select l_orderkey as query_id, l_partkey as id, max(round(l_discount * 5, 2)) as score from lineitem group by 1, 2), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank, max(score) over (partition by query_id) < 0.4 as low_confidence from s) select * from r where case when low_confidence then rank <= 3 else rank <= 5 and score >= 0.4 end",
    "f3_month_order": v.with_views("jobs") + " select year(posted_at) as year, month(posted_at) as month, title, count(*) as n from jobs group by 1, 2, 3",
    "f4_capped": v.with_views("jobs") + " select job_id, salary from jobs order by salary desc, job_id limit 500",
    "f9_members": v.with_views("companies") + " select location, string_agg(name, ',' order by name) as members from companies group by 1",
    "c5_neighbours": v.with_views("uses", "companies") + " select company_id + 1000000000 as center, tech_id as neighbour from uses join companies using (company_id) where location = 'NATION_3'",
    "c9_visits_by_month": "with m as (select unnest(['2023-10', '2023-11', '2023-12', '2024-01', '2024-02', '2024-03']) as month), n as (select strftime(ts, '%Y-%m') as month, count(*) as n from events group by 1) select month, coalesce(n, 0) as n from m left join n using (month)",
    "c14_same_names": "with t as (select lower(p_name) as name, min(p_partkey) as tech_id from part group by 1) select p_partkey as skill_id, tech_id from part join t on lower(p_name) = name",
    "c17_titles": v.with_views("jobs") + ", w as (select unnest(['URGENT', 'HIGH', 'low', 'f']) as word) select job_id, word from jobs join w on contains(lower(title), lower(word))",
    "e5_previous": v.with_views("jobs") + ", n as (select title, date_trunc('month', posted_at) as m, count(*) as n from jobs group by 1, 2) select title, strftime(m, '%Y-%m') as month, n, lag(n, 1) over w as before, lag(n, 12) over w as year_before from n window w as (partition by title order by m)",
    "h28_rates": v.with_views("jobs") + ", n as (select title, date_trunc('month', posted_at) as m, count(*) as n from jobs group by 1, 2), b as (select *, lag(n, 1) over (partition by title order by m) as b from n) select title, strftime(m, '%Y-%m') as month, round(case when b > 0 then (n - b) / b * 100 end, 4) as rate from b",
    "g3_missing": "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 49 and l_returnflag = 'R')",
    "g7_relinked": "with c as (select p_partkey as id, min(p_partkey) over (partition by lower(p_name)) as canonical from part) select distinct x.canonical as a, y.canonical as b from lineitem p join lineitem q on p.l_orderkey = q.l_orderkey and p.l_linenumber = 1 and q.l_linenumber = 2 join c x on x.id = p.l_partkey join c y on y.id = q.l_partkey where x.canonical <> y.canonical",
    "h23_calendar": "select o_orderkey, year(o_orderdate) as year, month(o_orderdate) as month, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as start, strftime(date_trunc('month', o_orderdate) - interval 5 month, '%Y-%m') as back from orders",
    "h25_labels": "select o_orderkey, 'T' || month(o_orderdate) || '/' || year(o_orderdate) as label, year(o_orderdate) * 100 + month(o_orderdate) as place from orders",
    "h27_math": "select c_custkey, round(ln(1 + abs(c_acctbal)), 6) as log, greatest(0.0::double, least(1.0::double, c_acctbal / 10000)) as clipped, round(exp(-abs(c_acctbal) / 5000), 6) as decay from customer",
    "h30_prefixed": "select page_id, 'query: ' || url as query, 'passage: ' || url as passage from pages",
    "i3_roles": "select p_partkey, case when p_name in ('blue ring', 'red widget') then p_name when split_part(p_name, ' ', 2) in ('ring', 'widget', 'gear') then split_part(p_name, ' ', 2) else '' end as roles from part",
    "i7_people": "select p_partkey, case when contains(p_name, 'ring') then '' else upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) || '|' end || 'Anna Weber' as people from part",
    "i12_query_entities": v.with_views("companies") + " select company_id, 'ORG' as label, lower(name) as name, 1::bigint as n from companies union all select company_id, 'LOC', lower(location), 1 from companies where location is not null union all select company_id, 'TECH', 'blue ring', 1 from companies where exists (select 1 from part where lower(p_name) = 'blue ring')",
    "j13_nodes": v.with_views("articles") + ", " + MENTIONS + " select 'Article' as label, md5(cast(article_id as varchar)) as id, title as name from articles union all select distinct label, md5(label || ':' || name), name from e union all select distinct 'Person', md5('Person:' || lower(source)), lower(source) from articles where source is not null",
    "j14_edges": v.with_views("articles") + ", " + MENTIONS + " select 'MENTIONS' as type, md5(cast(article_id as varchar)) as src, md5(label || ':' || name) as dst, n as frequency from e union all select 'WROTE', md5('Person:' || lower(source)), md5(cast(article_id as varchar)), 1 from articles where source is not null",
}
