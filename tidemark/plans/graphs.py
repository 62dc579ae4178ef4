"""Registered queries on graph algorithms and retrieval (SURVEY groups J, K, G, D)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import entities, graph, louvain, market, retrieve, writeback
from tidemark.plans import views as v
from tidemark.plans.basics import MENTIONS
from tidemark.sources.shared import new_folder, stored


def _edges(spark, sf):
    """Companies and technologies by text ids; repeated edges are left to the operators, which make them unique."""
    u = v.uses_lines(spark, sf)
    return u.select(F.concat(F.lit("c"), "company_id").alias("src"), F.concat(F.lit("t"), "tech_id").alias("dst"))


def _nodes(spark, sf):
    t = v.technologies(spark, sf).select(F.concat(F.lit("t"), "tech_id").alias("id"), F.lit("Technology").alias("label"), "name")
    c = v.companies(spark, sf).select(F.concat(F.lit("c"), "company_id").alias("id"), F.lit("Company").alias("label"), "name")
    return t.unionByName(c)


def j1_explore(spark, sf):
    keys = spark.createDataFrame([("small ring",), ("blue bolt",)], "keyword string")
    nodes, _ = graph.explore(_nodes(spark, sf), _edges(spark, sf), keys, 1)
    return nodes


def j1_explore_deep(spark, sf):
    keys = spark.createDataFrame([("small ring",)], "keyword string")
    nodes, pairs = graph.explore(_nodes(spark, sf), _edges(spark, sf), keys, 2)
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(pairs.agg(F.count(F.lit(1)).alias("edges")))


def j2_distances(spark, sf):
    """Hops from one company over all of the graph."""
    d = graph.distances(_edges(spark, sf), spark.createDataFrame([("c0",)], "id string"))
    return d.groupBy("hop").agg(F.count(F.lit(1)).alias("n"))


def j2_shortest_path(spark, sf):
    p = graph.shortest_paths(_nodes(spark, sf), _edges(spark, sf), "t0", "t1")
    return p.select("found", "length", F.array_join("path", ">").alias("path"))


def j3_by_location(spark, sf):
    t = v.technologies(spark, sf).where(F.lower("name") == "red widget")
    found = graph.co_use(v.uses(spark, sf), v.companies(spark, sf), t, "nation_2")
    other = found.groupBy("other_id").agg(F.countDistinct("company_id").alias("companies"))
    return other.orderBy(F.desc("companies"), "other_id").limit(500)


def j4_enriched(spark, sf):
    j = market.with_company(v.jobs(spark, sf), v.hires(spark, sf), v.companies(spark, sf))
    return j.where((F.col("salary") >= 450000) & F.contains(F.lower("location"), F.lit("nation_1"))).select("job_id", F.floor("salary").alias("min_salary"), "location")


def j5_pagerank(spark, sf):
    r = graph.pagerank(_edges(spark, sf))
    return r.where(F.startswith("id", F.lit("t"))).select("id", F.round("score", 5).alias("score"))


def j6_degree(spark, sf):
    return graph.degree(_edges(spark, sf))


def _sparse(spark, sf):
    """Orders of one day and customer tied together: a graph of many small components."""
    o = v.table(spark, sf, "orders")
    return o.select(F.concat(F.lit("u"), "o_custkey").alias("src"), F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyyMMdd"), "o_orderstatus", F.floor(F.col("o_totalprice") / 50000)).alias("dst"))


def j7_components(spark, sf):
    c = graph.components(_edges(spark, sf))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def j7_sparse_components(spark, sf):
    c = graph.components(_sparse(spark, sf))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def j8_communities(spark, sf):
    """Communities of companies (even numbers) and technologies (odd ones), so that no texts are numbered; named by the least
    text id."""
    u = v.uses_lines(spark, sf)
    c = louvain.communities(u.select((F.col("company_id").cast("long") * 2).alias("src"), (F.col("tech_id").cast("long") * 2 + 1).alias("dst")))
    name = F.concat(F.when(F.col("id").bitwiseAND(1) == 0, "c").otherwise("t"), F.shiftright("id", 1))
    named = c.select(name.alias("id"), F.col("community").alias("number"))
    return named.join(named.groupBy("number").agg(F.min("id").alias("community")), "number").select("id", "community")


def j9_projection(spark, sf):
    e = graph.fast_random_projection(_edges(spark, sf))
    return e.select("id", F.array_join(F.transform("embedding", lambda x: F.format_number(x, 4)), " ").alias("embedding"))


def j10_walks(spark, sf):
    w = graph.random_walks(_edges(spark, sf))
    return w.select("id", F.col("walk").cast("long").alias("walk"), F.array_join("path", ">").alias("path"))


def j10_vectors(spark, sf):
    n = graph.edge_vectors(_edges(spark, sf))
    return n.select("id", F.array_join(F.transform("vector", lambda x: F.format_number(x, 3)), " ").alias("embedding"))


def j11_projected(spark, sf):
    """The undirected projection of companies, jobs and technologies by USES and REQUIRES, counted by label and type."""
    u = v.uses(spark, sf).select(F.lit("USES").alias("type"), F.lit("Company").alias("from"), F.col("company_id").alias("src"), F.lit("Technology").alias("to"), F.col("tech_id").alias("dst"))
    q = v.requires(spark, sf).distinct().select(F.lit("REQUIRES").alias("type"), F.lit("Job").alias("from"), F.col("job_id").alias("src"), F.lit("Technology").alias("to"), F.col("tech_id").alias("dst"))
    e = u.unionByName(q)
    both = e.unionByName(e.select("type", F.col("to").alias("from"), F.col("dst").alias("src"), F.col("from").alias("to"), F.col("src").alias("dst")))
    return both.groupBy("type", F.col("from").alias("label")).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("nodes"))


LABELS = ("Technology", "Article", "Company", "Job", "Skill")
TYPES = ("MENTIONS", "USES", "REQUIRES", "RELATED_TO", "IS_TECHNOLOGY")


def _all_edges(spark, sf):
    """Edges of all types: companies use parts; orders require parts and, as skills, their kinds; documents mention parts
    whose number they end on; parts of one name are related; kinds that are also a part's name are technologies. One more
    type and label, which the projection leaves out."""
    t, part = v.technologies(spark, sf), v.table(spark, sf, "part")

    def e(df, kind, a, src, b, dst):
        return df.select(F.lit(kind).alias("type"), F.lit(a).alias("src_label"), src.cast("string").alias("src"), F.lit(b).alias("dst_label"), dst.cast("string").alias("dst"))

    c = F.col
    need = v.requires(spark, sf).join(t.select("tech_id", "category"), "tech_id")
    first = t.groupBy(F.lower("name").alias("key")).agg(F.min("tech_id").alias("first"))
    related = t.join(first, F.lower("name") == c("key")).where("tech_id <> first")
    kinds = part.select(F.lower("p_name").alias("p_name")).distinct().join(t.select("tech_id", F.lower("name").alias("name")), c("p_name") == c("name"))
    a = v.articles(spark, sf).select("article_id", "source", "lang").join(t.select("tech_id"), c("article_id") == c("tech_id"))
    parts = [
        e(v.uses(spark, sf), "USES", "Company", c("company_id"), "Technology", c("tech_id")), e(need, "REQUIRES", "Job", c("job_id"), "Technology", c("tech_id")),
        e(need, "REQUIRES", "Job", c("job_id"), "Skill", c("category")), e(a, "MENTIONS", "Article", c("article_id"), "Technology", c("tech_id")), e(a, "MENTIONS", "Article", c("article_id"), "Person", c("source")),
        e(related, "RELATED_TO", "Technology", c("tech_id"), "Technology", c("first")), e(kinds, "IS_TECHNOLOGY", "Skill", c("p_name"), "Technology", c("tech_id")), e(a, "POSTED_IN", "Article", c("article_id"), "Location", c("lang")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def j11_full_projection(spark, sf):
    """The undirected projection of five labels by five types of edges, counted by type and the labels of both ends."""
    p = graph.projected(_all_edges(spark, sf), LABELS, TYPES)
    return p.groupBy("type", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("nodes"))


def j15_wrote_edges(spark, sf):
    """Every person named in an article wrote it."""
    return graph.wrote(_all_edges(spark, sf).where("dst is not null"))


def j12_upsert(spark, sf):
    """Companies known first without a place, then with one; the place is filled, the first rating stays."""
    c = v.companies(spark, sf)
    old = c.where("company_id % 2 = 0").select("company_id", "name", F.lit("Unknown").alias("location"), "rating", F.lit(0).alias("ord"))
    new = c.select("company_id", "name", "location", (F.col("rating") + 1).alias("rating"), F.lit(1).alias("ord"))
    return graph.upsert(old, new, "company_id", {"location": ["Unknown", ""]})


def j14_edge_tables(spark, sf):
    """REQUIRES with how often; what a job asks for more than once is mandatory. MENTIONS: j14_edges."""
    r = v.requires(spark, sf).groupBy("job_id", "tech_id").agg(F.count(F.lit(1)).alias("frequency"))
    return r.select("job_id", "tech_id", (F.col("frequency") > 1).alias("mandatory"), "frequency")


def j15_wrote(spark, sf):
    """Who is named in an article wrote it: the projection of MENTIONS of persons."""
    people = spark.createDataFrame([("Idiot", "Person"), ("clown", "Person"), ("apache license", "Person")], "name string, label string")
    m = entities.dictionary_entities(v.articles(spark, sf), people, "article_id", "content")
    return m.select(F.col("name").alias("person"), F.col("id").alias("article_id")).distinct()


def _clustered(spark, sf):
    """Embeddings with their label as cluster, every eleventh noise."""
    cluster = F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("label")).cast("long")
    return v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), cluster.alias("cluster_id"), F.col("embedding").cast("array<double>").alias("vec"))


def j17_edges(spark, sf):
    """Two runs of the write-back, the first with all rows in one cluster: what is read is the second run alone."""
    folder, rows = new_folder(spark, "write-back"), _clustered(spark, sf)
    names = v.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("cluster_id"), F.col("r_name").alias("name"))
    writeback.write_generation(folder, rows.withColumn("cluster_id", F.lit(77).cast("long")), names)
    writeback.write_generation(folder, rows, names, 0.05)
    return writeback.read_generation(spark, folder, "edges")


def j17_clusters(spark, sf):
    folder = new_folder(spark, "write-back")
    names = v.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("cluster_id"), F.col("r_name").alias("name"))
    writeback.write_generation(folder, _clustered(spark, sf), names)
    return writeback.read_generation(spark, folder, "clusters")


def j17_cluster_edges(spark, sf):
    """Cluster nodes with BELONGS_TO edges written as tables, read again and counted."""
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("tech_id"), F.col("label").cast("long").alias("cluster_id"))
    belongs = stored(e.withColumn("score", F.lit(1.0)), "belongs")
    nodes = stored(e.select("cluster_id").distinct(), "cluster-nodes")
    return nodes.join(belongs, "cluster_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))


def g5_merged_nodes(spark, sf):
    n = _nodes(spark, sf)
    return n.unionByName(n.where("label = 'Company'")).dropDuplicates(["id"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _qd(spark, sf):
    q = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    d = v.articles(spark, sf).select(F.col("article_id").alias("id"), "title", F.col("content").alias("text"))
    return q, d


def k2_overlap(spark, sf):
    q, d = _qd(spark, sf)
    return retrieve.overlap_scores(q, d, least=0.4)


def k2_rerank(spark, sf):
    q, d = _qd(spark, sf)
    return retrieve.rerank(retrieve.overlap_scores(q, d, k=5))


def k4_context(spark, sf):
    q, d = _qd(spark, sf)
    return retrieve.context(retrieve.rerank(retrieve.overlap_scores(q, d, k=5)), d, 120)


def k3_hybrid(spark, sf):
    """Jobs for each technology name asked for: those that require it with a matching title first, then any that require it."""
    t = v.technologies(spark, sf).where(F.lower("name").isin("small ring", "red widget")).select("tech_id")
    j = v.requires(spark, sf).join(t, "tech_id").join(v.jobs(spark, sf), "job_id").select("job_id", "title").distinct()
    return market.job_batches([j.where("title like '%URGENT%'"), j.where("title like '%HIGH%'"), j], "job_id", 40).select("job_id", "title", F.col("prio").cast("long").alias("prio"))


def d23_run_summary(spark, sf):
    e = v.visits(spark, sf)
    return retrieve.run_summary(e.select((F.col("keyword") != "error").alias("answered"), F.floor("value").cast("double").alias("seconds"), F.length("ip").cast("double").alias("score")))


def d11_company_edges(spark, sf):
    """Company pairs that three jobs or more bring together."""
    m = v.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    return graph.co_mentions(m, "l_suppkey", "l_orderkey", 5)


NAMES = [n for n in list(globals()) if n[0] in "dgjk" and n[1].isdigit()]
QUERIES = {k: globals()[k] for k in NAMES}

E = v.with_views("uses", "technologies", "companies") + ", edges as (select 'c' || company_id as src, 't' || tech_id as dst from uses), near as (select src, dst from edges union select dst, src from edges), nodes as (select 't' || tech_id as id, 'Technology' as label, name from technologies union all select 'c' || company_id, 'Company', name from companies)"
W = "w as (select distinct doc_id as id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as word from documents), q as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as word from benchmark), sz as (select query_id, count(*) as size from q group by 1), s as (select query_id, id, round(count(*) / any_value(size), 6) as score from q join w using (word) join sz using (query_id) group by 1, 2)"
RERANK = "with " + W + ", r as (select *, row_number() over (partition by query_id order by score desc, id) as rank, max(score) over (partition by query_id) < 0.4 as low_confidence from s), k as (select * from r where (not low_confidence and score >= 0.4 and rank <= 5) or (low_confidence and rank <= 3))"
BEST = "best as (select id from (select k, id, row_number() over (partition by k order by case when lower(name) = k then 0 else 1 end, length(name), id) as r from nodes, (select unnest({keys}) as k) where contains(lower(name), k)) where r = 1)"
_CLUSTERED = "with r as (select vec_id as id, embedding::double[] as vec, case when vec_id % 11 = 0 then -1 else label end::bigint as cluster_id from embeddings), x as (select cluster_id, unnest(vec) as x, generate_subscripts(vec, 1) as i from r where cluster_id <> -1), m as (select cluster_id, i, avg(x) as x from x group by 1, 2), c as (select cluster_id, list(x order by i) as centroid from m group by 1)"
ORACLES = {
    "j11_full_projection": v.with_views("technologies", "requires", "uses") + """, n as (select lower(name) as key, min(tech_id) as first from technologies group by 1),
        e as (select 'USES' as type, 'Company' as src_label, company_id::varchar as src, 'Technology' as dst_label, tech_id::varchar as dst from uses union all select 'REQUIRES', 'Job', job_id::varchar, 'Technology', tech_id::varchar from requires
          union all select 'REQUIRES', 'Job', job_id::varchar, 'Skill', category from requires join technologies using (tech_id) union all select 'MENTIONS', 'Article', doc_id::varchar, 'Technology', tech_id::varchar from documents join technologies on doc_id = tech_id
          union all select 'RELATED_TO', 'Technology', tech_id::varchar, 'Technology', first::varchar from technologies join n on lower(name) = key where tech_id <> first
          union all select 'IS_TECHNOLOGY', 'Skill', lower(p_name), 'Technology', tech_id::varchar from (select distinct lower(p_name) as p_name from part) join technologies on lower(name) = p_name),
        b as (select * from e union select type, dst_label, dst, src_label, src from e) select type, src_label, dst_label, count(*) as edges, count(distinct src) as nodes from b where src is not null and dst is not null group by 1, 2, 3""",
    "j15_wrote_edges": "select distinct 'WROTE' as type, source as src, doc_id::varchar as dst from documents join part on doc_id = p_partkey where source is not null",
    "j17_edges": _CLUSTERED + ", d as (select id, c.cluster_id, list_distance(vec, centroid) as d from r join c on r.cluster_id <> c.cluster_id), s as (select *, 1 - d / max(d) over (partition by id) as s from d) select 'NEAR_CLUSTER' as type, id as src, cluster_id as dst, round(s, 4) as score from s where s >= 0.05 union all select 'BELONGS_TO', id, cluster_id, 1.0 from r where cluster_id <> -1",
    "j17_clusters": _CLUSTERED + " select cluster_id, coalesce(any_value(r_name), 'Cluster ' || cluster_id) as name, count(*) as size from r left join region on r_regionkey = cluster_id where cluster_id <> -1 group by cluster_id",
    "j1_explore": E + ", " + BEST.format(keys="['small ring', 'blue bolt']") + ", n as (select src, dst, row_number() over (partition by src order by dst) as k from near where src in (select id from best)) select * from nodes where id in (select id from best union select dst from n where k <= 10)",
    "j1_explore_deep": E + ", " + BEST.format(keys="['small ring']") + ", n as (select src, dst, row_number() over (partition by src order by dst) as k from near where src in (select id from best)), one as (select src, dst from n where k <= 10), m as (select src, dst, row_number() over (partition by src order by dst) as k from near where src in (select dst from one) and src not in (select id from best)), a as (select src, dst from one union all select src, dst from m where k <= 10) select (select count(*) from (select id from best union select dst from a)) as nodes, (select count(*) from (select distinct least(src, dst), greatest(src, dst) from a)) as edges",
    "j2_distances": E.replace("with ", "with recursive ", 1) + ", r(id, hop) as (select 'c0', 0::bigint union select dst, hop + 1 from r join near on src = id where hop < 6), l as (select id, min(hop) as hop from r group by 1) select hop, count(*) as n from l group by 1",
    "j3_by_location": v.with_views("uses", "companies", "technologies") + " select b.tech_id as other_id, count(distinct a.company_id) as companies from uses a join uses b on a.company_id = b.company_id and a.tech_id <> b.tech_id join companies c on c.company_id = a.company_id and contains(lower(location), 'nation_2') join technologies t on t.tech_id = a.tech_id and lower(t.name) = 'red widget' group by 1 order by companies desc, other_id limit 500",
    "j4_enriched": v.with_views("jobs", "hires", "companies") + " select job_id, floor(salary)::bigint as min_salary, location from jobs join hires using (job_id) join companies using (company_id) where salary >= 450000 and contains(lower(location), 'nation_1')",
    "j6_degree": E + " select src as id, count(*) as degree from near group by 1",
    "j7_components": E + " select min(src) as component, count(distinct src) as n from near",
    "j11_projected": v.with_views("uses", "requires") + ", q as (select distinct * from requires) select 'USES' as type, 'Company' as label, count(*) as edges, count(distinct company_id) as nodes from uses union all select 'USES', 'Technology', count(*), count(distinct tech_id) from uses union all select 'REQUIRES', 'Job', count(*), count(distinct job_id) from q union all select 'REQUIRES', 'Technology', count(*), count(distinct tech_id) from q",
    "j12_upsert": v.with_views("companies") + " select company_id, name, location, case when company_id % 2 = 0 then rating else rating + 1 end as rating from companies",
    "j14_edge_tables": v.with_views("requires") + " select job_id, tech_id, count(*) > 1 as mandatory, count(*) as frequency from requires group by 1, 2",
    "j15_wrote": v.with_views("articles") + ", " + MENTIONS + " select name as person, article_id from e where name <> 'of the'",
    "j17_cluster_edges": "select label::bigint as cluster_id, count(*) as members from embeddings group by 1",
    "g5_merged_nodes": E + " select label, count(*) as n from nodes group by 1",
    "k2_overlap": "with " + W + " select query_id, id, score from s where score >= 0.4",
    "k2_rerank": RERANK + " select query_id, id, score, rank, low_confidence from k",
    "k4_context": RERANK + ", d as (select doc_id as id, split_part(text, chr(10), 1) as title, text from documents) select query_id, string_agg('[' || rank || '] ' || title || chr(10) || case when length(text) > 120 then substr(text, 1, 120) || '...' else text end, chr(10) || chr(10) order by rank) as context from k join d using (id) group by 1",
    "k3_hybrid": v.with_views("jobs", "requires", "technologies") + ", j as (select distinct job_id, title from requires join technologies using (tech_id) join jobs using (job_id) where lower(name) in ('small ring', 'red widget')), p as (select job_id, title, case when title like '%URGENT%' then 0 when title like '%HIGH%' then 1 else 2 end::bigint as prio from j) select * from p order by prio, job_id limit 40",
    "d23_run_summary": v.with_views("visits") + " select count(*) as questions, round(avg((keyword <> 'error')::int), 6) as answered_rate, round(avg(floor(value)), 6) as mean_seconds, round(avg(length(ip)), 6) as mean_score from visits",
    "d11_company_edges": "with m as (select distinct l_orderkey as k, l_suppkey as x from lineitem) select a.x as a, b.x as b, count(*) as n from m a join m b on a.k = b.k and a.x < b.x group by 1, 2 having count(*) >= 5",
}
#: Twenty rounds, one after the other.
ORACLES["j5_pagerank"] = (
    v.with_views("uses") + ", u as (select 'c' || company_id as a, 't' || tech_id as b from uses), e as materialized (select a as src, b as dst from u union select b, a from u), d as materialized (select src, count(*) as degree from e group by 1), s0 as (select src as id, 1.0::double as score from d)"
    + "".join(f", s{k + 1} as materialized (select dst as id, 0.15 + 0.85 * sum(score / degree) as score from e join d using (src) join s{k} on id = src group by 1)" for k in range(20))
    + " select id, round(score, 5) as score from s20 where id like 't%'"
)
