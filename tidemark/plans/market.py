"""Registered queries on joins, reports, quality and set operations (SURVEY groups B, C, D, E, F, G)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import graph, market
from tidemark.plans import views as v

WORDS = ("the", "und", "les", "para", "idiot", "apache", "license", "token")


def c2_any_edge(spark, sf):
    """Jobs joined to technologies over edges of either direction."""
    e = v.requires(spark, sf)
    both = e.select(F.concat(F.lit("j"), "job_id").alias("src"), F.concat(F.lit("t"), "tech_id").alias("dst"))
    near = graph.symmetric(both).where(F.startswith("src", F.lit("j")))
    return near.groupBy("dst").agg(F.count(F.lit(1)).alias("jobs")).select(F.substring("dst", 2, 20).cast("long").alias("tech_id"), "jobs")


def c3_job_company(spark, sf):
    j = market.with_company(v.jobs(spark, sf), v.hires(spark, sf), v.companies(spark, sf))
    return j.groupBy("location").agg(F.count(F.lit(1)).alias("jobs"), F.count("company_id").alias("with_company"))


def c4_co_use(spark, sf):
    t = v.technologies(spark, sf).where(F.lower("name") == "small ring")
    found = graph.co_use(v.uses(spark, sf), v.companies(spark, sf), t, "nation_1")
    return found.groupBy("tech_id").agg(F.countDistinct("other_id").alias("others"), F.countDistinct("company_id").alias("companies"))


def c6_link_by_name(spark, sf):
    c = v.table(spark, sf, "customer").select("c_custkey", F.regexp_replace("c_name", "Customer", "Supplier").alias("company_name"))
    return market.link_by_name(c, "company_name", v.companies(spark, sf), "name", "c_custkey", "company_id")


def c7_word_mentions(spark, sf):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return market.word_mentions(v.articles(spark, sf), "content", words).groupBy("word").agg(F.count(F.lit(1)).alias("articles"))


def c8_co_mentions(spark, sf):
    return graph.co_mentions(v.requires(spark, sf), "tech_id", "job_id", 2)


def c10_user_profile(spark, sf):
    c, n = v.table(spark, sf, "customer"), v.table(spark, sf, "nation")
    return c.join(n.where("n_nationkey < 10"), c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "c_name", "n_name")


def c12_missing_to_zero(spark, sf):
    """Dear jobs that require each technology; none for most."""
    dear = v.jobs(spark, sf).where("salary > 450000").select("job_id")
    n = v.requires(spark, sf).join(dear, "job_id").groupBy("tech_id").agg(F.count(F.lit(1)).alias("n"))
    return v.technologies(spark, sf).select("tech_id").join(n, "tech_id", "left").na.fill(0, ["n"])


def c13_foreign_keys(spark, sf):
    p = v.technologies(spark, sf).where("tech_id % 7 <> 3")
    return market.foreign_key_check(v.requires(spark, sf), "tech_id", p, "tech_id")


def c15_alias_rewrite(spark, sf):
    t = v.technologies(spark, sf)
    n = v.requires(spark, sf).groupBy("tech_id").agg(F.countDistinct("job_id").alias("n"))
    canonical = graph.canonical_ids(t, n, F.lower)
    merged = graph.rewrite_aliases(v.uses(spark, sf), canonical, ["tech_id"])
    return merged.groupBy("tech_id").agg(F.count(F.lit(1)).alias("companies"))


def c16_seed_edges(spark, sf):
    """The explicit cartesian operator: regions with the nations of a fixed list."""
    r, n = v.table(spark, sf, "region"), v.table(spark, sf, "nation").where(F.col("n_name").isin("NATION_1", "NATION_2", "NATION_3"))
    return r.crossJoin(n).select("r_name", "n_name")  # both of fixed size


def c20_result_location(spark, sf):
    j = market.with_company(v.jobs(spark, sf).where("salary > 400000"), v.hires(spark, sf), v.companies(spark, sf))
    return j.select("job_id", "company", "location")


def d9_statistics(spark, sf):
    tables = {"Job": v.jobs(spark, sf), "Technology": v.technologies(spark, sf), "Company": v.companies(spark, sf), "USES": v.uses(spark, sf)}
    return market.counts_by_label(tables, [*tables, "Person"])


def d10_popular(spark, sf):
    return market.popular_technologies(v.requires(spark, sf), v.technologies(spark, sf), 25)


def d12_neighbourhood(spark, sf):
    t = v.technologies(spark, sf)
    related = graph.co_mentions(v.requires(spark, sf), "tech_id", "job_id", 3)
    both = related.select(F.col("a").alias("tech_id")).union(related.select("b"))
    return market.neighbourhood(t, v.requires(spark, sf), v.uses(spark, sf), both)


def d13_temporal(spark, sf):
    m = v.requires(spark, sf).join(v.jobs(spark, sf), "job_id").select("tech_id", F.col("posted_at").alias("at"), F.floor("salary").cast("double").alias("value"))
    return market.temporal_stats(m, v.AS_OF, "tech_id")


def d15_jaccard(spark, sf):
    return market.jaccard_to_top(v.requires(spark, sf))


def d16_tfidf(spark, sf):
    t = v.requires(spark, sf).join(v.hires(spark, sf), "job_id").select("tech_id", F.concat(F.lit("c"), "company_id").alias("token"))
    return market.smooth_tfidf(t, "tech_id", "token")


def b12_noise(spark, sf):
    t = market.noise_filter(v.technologies(spark, sf), v.requires(spark, sf), 25, ["blue bolt"], ["s.*ring", "red"], ["red widget"])
    return t.select("tech_id", "name", "jobs")


def d17_mention_counts(spark, sf):
    t = v.technologies(spark, sf)
    m = v.requires(spark, sf).select("job_id", "tech_id").dropDuplicates()
    return m.join(t, "tech_id").groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))


def d18_bounded_lists(spark, sf):
    t = v.uses(spark, sf).join(v.technologies(spark, sf), "tech_id")
    n = t.select("company_id", F.lower("name").alias("name")).distinct()
    first = n.withColumn("k", F.row_number().over(W.partitionBy("company_id").orderBy("name"))).where("k <= 5")
    return first.groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("technologies"))


def d21_confusion(spark, sf):
    return market.confusion(_scored(spark, sf), "quality", F.col("score") >= 0.5)


def _scored(spark, sf):
    """A simple score of labelled documents: the share of letters that are small."""
    d = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels").where("quality is not null"), "doc_id")
    small = F.length(F.regexp_replace("text", "[^a-z]", ""))
    return d.select("quality", F.coalesce(small / F.length("text"), F.lit(0.0)).alias("score"))


def d22_threshold_sweep(spark, sf):
    return market.threshold_sweep(_scored(spark, sf), "quality", "score").select("threshold", "tp", "fp", "fn", "tn", "accuracy", "f1")


def d22_best_threshold(spark, sf):
    s = market.threshold_sweep(_scored(spark, sf), "quality", "score")
    return s.orderBy(F.desc("accuracy"), F.desc("f1"), "threshold").limit(1).select("threshold", "accuracy", "f1")


def d24_table_checks(spark, sf):
    d = v.table(spark, sf, "documents")
    return market.table_checks(d, "documents", ["text"], ["doc_id", "lang"], ["text", "source"])


def d25_most_required(spark, sf):
    t = v.technologies(spark, sf).select("tech_id", F.lower("name").alias("name"))
    return v.requires(spark, sf).join(t, "tech_id").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(10)


def d25_hiring(spark, sf):
    h = v.hires(spark, sf).join(v.companies(spark, sf), "company_id").groupBy("name").agg(F.count(F.lit(1)).alias("jobs"))
    return h.orderBy(F.desc("jobs"), "name").limit(10)


def d25_places(spark, sf):
    u = v.uses(spark, sf).join(v.companies(spark, sf).select("company_id", "location"), "company_id").join(v.technologies(spark, sf), "tech_id")
    g = u.groupBy("location").agg(F.countDistinct(F.lower("name")).alias("technologies"), F.countDistinct("company_id").alias("companies"))
    return g.orderBy(F.desc("technologies"), "location")


def d25_trending(spark, sf):
    j = v.jobs(spark, sf).where(F.col("posted_at") >= F.lit("2001-01-01").cast("timestamp"))
    t = v.technologies(spark, sf).select("tech_id", F.lower("name").alias("name"))
    return v.requires(spark, sf).join(j, "job_id").join(t, "tech_id").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(10)


def d26_import_stats(spark, sf):
    a = v.articles(spark, sf)
    return a.groupBy("source").agg(F.count(F.lit(1)).alias("articles"), F.countDistinct(F.lower("title")).alias("titles"), F.countDistinct("lang").alias("languages"))


def e1_first_neighbours(spark, sf):
    e = v.uses(spark, sf).select((F.col("company_id") + 1_000_000_000).alias("src"), F.col("tech_id").alias("dst"))
    return graph.first_neighbours(e, spark.range(20).select("id"))


def e2_best_node(spark, sf):
    nodes = v.technologies(spark, sf).select(F.col("tech_id").alias("id"), "name")
    keys = spark.createDataFrame([("ring",), ("Widget",), ("BLUE BOLT",), ("nothing",)], "keyword string")
    return graph.best_node(nodes, keys)


def e3_representatives(spark, sf):
    n = v.requires(spark, sf).groupBy("tech_id").agg(F.countDistinct("job_id").alias("n"))
    return graph.canonical_ids(v.technologies(spark, sf), n, F.lower)


def e9_top_required(spark, sf):
    return v.requires(spark, sf).groupBy("tech_id").agg(F.countDistinct("job_id").alias("jobs")).orderBy(F.desc("jobs"), "tech_id").limit(10)


def e7_last_months(spark, sf):
    m = v.jobs(spark, sf).groupBy("title", F.trunc("posted_at", "MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    last = F.row_number().over(W.partitionBy("title").orderBy(F.desc("m"))) <= 3
    return m.withColumn("k", last).where("k").select("title", F.date_format("m", "yyyy-MM").alias("month"), "n")


def f7_sessions(spark, sf):
    s = v.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))
    return s.orderBy(F.desc("last_turn"), "conv_id")


def f10_messages(spark, sf):
    c = v.table(spark, sf, "conversations")
    return c.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long")).select("conv_id", "place", "role", F.length("text").cast("long").alias("chars"))


def g1_related_both(spark, sf):
    r = graph.co_mentions(v.requires(spark, sf), "tech_id", "job_id", 2).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return graph.symmetric(r).groupBy("src").agg(F.count(F.lit(1)).alias("related"))


def g2_priority_merge(spark, sf):
    j = v.jobs(spark, sf).select("title", "job_id")
    one = lambda cond: j.where(cond).groupBy("title").agg(F.min("job_id").alias("job_id"))
    return market.job_batches([one("title like '%HIGH%'"), one("title like '%LOW%'"), one("true")], "title", 20).drop("prio")


def g4_array_union(spark, sf):
    t = v.table(spark, sf, "part")
    u = F.array_union(F.split("p_name", " "), F.array(F.lower("p_type"), F.substring_index("p_name", " ", 1)))
    return t.select("p_partkey", F.array_join(u, ",").alias("words"))


def g6_set_sizes(spark, sf):
    t = v.table(spark, sf, "part")
    a, b = F.split("p_name", " "), F.array(F.lit("small"), F.lit("ring"), F.lit("red"))
    return t.select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("both"), F.size(F.array_union(a, b)).cast("long").alias("any"))


def j16_canonical_snapshot(spark, sf):
    n = v.requires(spark, sf).groupBy("tech_id").agg(F.countDistinct("job_id").alias("n"))
    canonical = graph.canonical_ids(v.technologies(spark, sf), n, F.lower)
    related = graph.co_mentions(v.requires(spark, sf), "tech_id", "job_id", 2).select("a", "b")
    return graph.rewrite_aliases(related, canonical, ["a", "b"]).groupBy("a").agg(F.count(F.lit(1)).alias("related"))


NAMES = ["c2_any_edge", "c3_job_company", "c4_co_use", "c6_link_by_name", "c7_word_mentions", "c8_co_mentions", "c10_user_profile", "c12_missing_to_zero", "c13_foreign_keys", "c15_alias_rewrite", "c16_seed_edges", "c20_result_location", "d9_statistics", "d10_popular", "d12_neighbourhood", "d13_temporal", "d15_jaccard", "d16_tfidf", "b12_noise", "d17_mention_counts", "d18_bounded_lists", "d21_confusion", "d22_threshold_sweep", "d22_best_threshold", "d24_table_checks", "d25_most_required", "d25_hiring", "d25_places", "d25_trending", "d26_import_stats", "e1_first_neighbours", "e2_best_node", "e3_representatives", "e9_top_required", "e7_last_months", "f7_sessions", "f10_messages", "g1_related_both", "g2_priority_merge", "g4_array_union", "g6_set_sizes", "j16_canonical_snapshot"]
QUERIES = {k: globals()[k] for k in NAMES}

PAIRS = "pairs as (select a.tech_id as a, b.tech_id as b, count(*) as n from (select distinct * from requires) a join (select distinct * from requires) b on a.job_id = b.job_id and a.tech_id < b.tech_id group by 1, 2)"
CANON = "jn as (select tech_id, count(distinct job_id) as n from requires group by 1), canon as (select tech_id as id, first(tech_id) over (partition by lower(name) order by case when name = lower(name) then 0 else 1 end, coalesce(n, 0) desc, length(name), name, tech_id) as canonical from technologies left join jn using (tech_id))"
SCORED = "s as (select quality, coalesce(length(regexp_replace(text, '[^a-z]', '', 'g')) / length(text), 0) as score from documents join labels using (doc_id) where quality is not null)"
SWEEP = SCORED + """, t as (select i / 100.0::double as threshold, i from range(101) r(i)), b as (select quality, least(floor(score * 100 + 1e-9), 100) as b from s),
n as (select threshold, count(*) filter (where quality = 1 and b >= i) as tp, count(*) filter (where quality <> 1 and b >= i) as fp, count(*) filter (where quality = 1 and b < i) as fn, count(*) filter (where quality <> 1 and b < i) as tn from t, b group by 1),
x as (select *, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) else 0 end, 6) as f1 from n)"""
ORACLES = {
    "c2_any_edge": v.with_views("requires") + " select tech_id, count(distinct job_id) as jobs from requires group by 1",
    "c3_job_company": v.with_views("jobs", "hires", "companies") + " select location, count(*) as jobs, count(company_id) as with_company from jobs left join hires using (job_id) left join companies using (company_id) group by 1",
    "c4_co_use": v.with_views("uses", "companies", "technologies") + " select a.tech_id, count(distinct b.tech_id) as others, count(distinct a.company_id) as companies from uses a join uses b on a.company_id = b.company_id and a.tech_id <> b.tech_id join companies c on c.company_id = a.company_id and contains(lower(location), 'nation_1') join technologies t on t.tech_id = a.tech_id and lower(t.name) = 'small ring' group by 1",
    "c6_link_by_name": v.with_views("companies") + " select distinct c_custkey, company_id from customer join companies on replace(c_name, 'Customer', 'Supplier') = name",
    "c7_word_mentions": "with w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) as word from documents) select word, count(*) as articles from w where word in ('" + "', '".join(WORDS) + "') group by 1",
    "c8_co_mentions": v.with_views("requires") + ", " + PAIRS + " select * from pairs where n >= 2",
    "c10_user_profile": "select c_custkey, c_name, n_name from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 10",
    "c12_missing_to_zero": "select p_partkey as tech_id, count(k) as n from part left join (select l_partkey as k from lineitem join orders on o_orderkey = l_orderkey where o_totalprice > 450000) on k = p_partkey group by 1",
    "c13_foreign_keys": "with m as (select distinct l_partkey as k from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 7 <> 3)) select (select count(*) from m) as missing, (select string_agg(cast(k as varchar), ',' order by cast(k as varchar)) from (select k from m order by k limit 5)) as sample",
    "c15_alias_rewrite": v.with_views("requires", "technologies", "uses") + ", " + CANON + " select canonical as tech_id, count(distinct company_id) as companies from uses join canon on id = tech_id group by 1",
    "c16_seed_edges": "select r_name, n_name from region, nation where n_name in ('NATION_1', 'NATION_2', 'NATION_3')",
    "c20_result_location": v.with_views("jobs", "hires", "companies") + " select job_id, name as company, location from jobs left join hires using (job_id) left join companies using (company_id) where salary > 400000",
    "d9_statistics": v.with_views("uses") + ", x as (select 'Job' as label, (select count(*) from orders) as n union all select 'Technology', (select count(*) from part) union all select 'Company', (select count(*) from supplier) union all select 'USES', (select count(*) from uses) union all select 'Person', 0) select label, n, n = 0 as missing from x",
    "d10_popular": v.with_views("requires", "technologies") + " select tech_id, name, count(*) as degree_total from requires join technologies using (tech_id) group by 1, 2 having count(*) >= 25",
    "d12_neighbourhood": v.with_views("requires", "uses", "technologies") + ", " + PAIRS + ", r as (select a as tech_id from pairs where n >= 3 union all select b from pairs where n >= 3), x as (select tech_id, (select count(*) from requires q where q.tech_id = t.tech_id) as n_jobs, (select count(*) from uses q where q.tech_id = t.tech_id) as n_companies, (select count(*) from r q where q.tech_id = t.tech_id) as n_related from technologies t) select *, round(ln(1 + n_jobs), 6) as log_jobs, round(ln(1 + n_companies), 6) as log_companies, round(n_jobs / greatest(n_companies, 1), 6) as job_company_ratio from x",
    "d13_temporal": v.with_views("requires", "jobs") + ", x as (select tech_id, datediff('day', posted_at::date, date '2001-07-15') as d, salary from requires join jobs using (job_id)) select tech_id, max(d) as first_days, min(d) as last_days, round(coalesce(skewness(d), 0), 6) as skewness, round(avg(floor(salary)), 6) as mean_value from x group by 1",
    "d15_jaccard": v.with_views("requires") + ", e as (select distinct job_id, tech_id from requires), n as (select tech_id, count(*) as n_jobs from e group by 1), top as (select tech_id as top_id, n_jobs as top_jobs from n order by n_jobs desc, tech_id limit 10), h as (select job_id, top_id, top_jobs from e join top on tech_id = top_id), b as (select tech_id, top_id, top_jobs, count(*) as c from e join h using (job_id) group by 1, 2, 3), s as (select tech_id, sum(c / (n_jobs + top_jobs - c)) as total from b join n using (tech_id) group by 1) select tech_id, n_jobs, round(coalesce(total, 0) / 10, 6) as mean_jaccard from n left join s using (tech_id)",
    "d16_tfidf": v.with_views("requires", "hires") + ", x as (select tech_id, 'c' || company_id as token, count(*) as tf from requires join hires using (job_id) group by 1, 2), d as (select token, count(*) as df, sum(tf) as total from x group by 1 having count(*) >= 2 order by total desc, token limit 500), w as (select tech_id, token, tf * (ln((1 + (select count(distinct tech_id) from x)) / (1 + df)) + 1) as w from x join d using (token)) select tech_id, token, round(w / sqrt(sum(w * w) over (partition by tech_id)), 6) as weight from w",
    "b12_noise": v.with_views("requires", "technologies") + ", n as (select tech_id, count(distinct job_id) as jobs from requires group by 1) select tech_id, name, coalesce(jobs, 0) as jobs from technologies left join n using (tech_id) where coalesce(jobs, 0) >= 25 and lower(name) <> 'blue bolt' and not (regexp_matches(lower(name), '^(?:s.*ring|red)') and lower(name) <> 'red widget')",
    "d17_mention_counts": v.with_views("requires", "technologies") + " select name, count(*) as mentions from (select distinct * from requires) join technologies using (tech_id) group by 1",
    "d18_bounded_lists": v.with_views("uses", "technologies") + ", x as (select distinct company_id, lower(name) as n from uses join technologies using (tech_id)), r as (select *, row_number() over (partition by company_id order by n) as k from x) select company_id, string_agg(n, ',' order by n) as technologies from r where k <= 5 group by 1",
    "d21_confusion": "with " + SCORED + ", n as (select count(*) filter (where quality = 1 and score >= 0.5) as tp, count(*) filter (where quality <> 1 and score >= 0.5) as fp, count(*) filter (where quality = 1 and score < 0.5) as fn, count(*) filter (where quality <> 1 and score < 0.5) as tn from s) select *, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) as f1 from n",
    "d22_threshold_sweep": "with " + SWEEP + " select * from x",
    "d22_best_threshold": "with " + SWEEP + " select threshold, accuracy, f1 from x order by accuracy desc, f1 desc, threshold limit 1",
    "d24_table_checks": """select 'documents.not_empty' as check, 'error' as severity, case when count(*) = 0 then 1 else 0 end::bigint as n from documents
union all select 'documents.unique_key', 'error', count(*) - count(distinct text) from documents union all select 'documents.null_doc_id', 'error', count(*) - count(doc_id) from documents
union all select 'documents.null_lang', 'error', count(*) - count(lang) from documents union all select 'documents.blank_text', 'warning', count(*) filter (where trim(text) = '') from documents
union all select 'documents.blank_source', 'warning', count(*) filter (where trim(source) = '') from documents""",
    "d25_most_required": v.with_views("requires", "technologies") + " select lower(name) as name, count(*) as n from requires join technologies using (tech_id) group by 1 order by n desc, 1 limit 10",
    "d25_hiring": v.with_views("hires", "companies") + " select name, count(*) as jobs from hires join companies using (company_id) group by 1 order by jobs desc, name limit 10",
    "d25_places": v.with_views("uses", "companies", "technologies") + " select location, count(distinct lower(t.name)) as technologies, count(distinct company_id) as companies from uses join companies using (company_id) join technologies t using (tech_id) group by 1",
    "d25_trending": v.with_views("requires", "jobs", "technologies") + " select lower(name) as name, count(*) as n from requires join jobs using (job_id) join technologies using (tech_id) where posted_at >= timestamp '2001-01-01' group by 1 order by n desc, 1 limit 10",
    "d26_import_stats": v.with_views("articles") + " select source, count(*) as articles, count(distinct lower(title)) as titles, count(distinct lang) as languages from articles group by 1",
    "e1_first_neighbours": v.with_views("uses") + ", r as (select tech_id as center, company_id + 1000000000 as neighbour, row_number() over (partition by tech_id order by company_id) as k from uses where tech_id < 20) select center, neighbour from r where k <= 10",
    "e2_best_node": v.with_views("technologies") + ", k as (select unnest(['ring', 'Widget', 'BLUE BOLT', 'nothing']) as keyword), r as (select keyword, tech_id as id, name, row_number() over (partition by keyword order by case when lower(name) = lower(keyword) then 0 else 1 end, length(name), tech_id) as r from k join technologies on contains(lower(name), lower(keyword))) select keyword, id, name from r where r = 1",
    "e3_representatives": v.with_views("requires", "technologies") + ", " + CANON + " select id, canonical from canon",
    "e9_top_required": v.with_views("requires") + " select tech_id, count(distinct job_id) as jobs from requires group by 1 order by jobs desc, tech_id limit 10",
    "e7_last_months": v.with_views("jobs") + ", m as (select title, date_trunc('month', posted_at) as m, count(*) as n from jobs group by 1, 2), r as (select *, row_number() over (partition by title order by m desc) as k from m) select title, strftime(m, '%Y-%m') as month, n from r where k <= 3",
    "f7_sessions": "select conv_id, count(*) as messages, max(turn) as last_turn from conversations group by 1",
    "f10_messages": "select conv_id, row_number() over (partition by conv_id order by turn) as place, role, length(text) as chars from conversations",
    "g1_related_both": v.with_views("requires") + ", " + PAIRS + ", b as (select a as src, b as dst from pairs where n >= 2 union select b, a from pairs where n >= 2) select src, count(*) as related from b group by 1",
    "g2_priority_merge": v.with_views("jobs") + ", p as (select 0 as prio, title, min(job_id) as job_id from jobs where title like '%HIGH%' group by 2 union all select 1, title, min(job_id) from jobs where title like '%LOW%' group by 2 union all select 2, title, min(job_id) from jobs group by 2), r as (select *, row_number() over (partition by title order by prio) as k from p) select title, job_id from r where k = 1 order by prio, title limit 20",
    "g4_array_union": "with x as (select p_partkey, split(p_name, ' ') as a, [lower(p_type), split_part(p_name, ' ', 1)] as b from part) select p_partkey, array_to_string(a, ',') || case when list_contains(a, b[1]) then '' else ',' || b[1] end as words from x",
    "g6_set_sizes": "with x as (select p_partkey, split(p_name, ' ') as a from part) select p_partkey, len(list_intersect(a, ['small', 'ring', 'red'])) as both, len(list_distinct(list_concat(a, ['small', 'ring', 'red']))) as any from x",
    "j16_canonical_snapshot": v.with_views("requires", "technologies") + ", " + CANON + ", " + PAIRS + ", r as (select distinct x.canonical as a, y.canonical as b from pairs join canon x on x.id = a join canon y on y.id = b where n >= 2) select a, count(*) as related from r where a <> b group by 1",
}
