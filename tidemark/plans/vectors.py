"""Registered queries on vectors, clusters and features (SURVEY groups C, D, E, K)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vectors as fv
from tidemark.operators import features, vectors
from tidemark.plans import views as v
from tidemark.sources.shared import new_folder


def _rows(spark, sf):
    e = v.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("label")).cast("long").alias("cluster_id"))


def _queries(spark, sf):
    return _rows(spark, sf).where("id % 50 = 0").select("id", "vec")


def h26_vectors(spark, sf):
    r = _rows(spark, sf).select("id", "vec", F.lead("vec").over(W.partitionBy("cluster_id").orderBy("id")).alias("next")).where("next is not null")
    return r.select("id", *[F.round(x, 6).alias(n) for n, x in (("dot", fv.dot("vec", "next")), ("cosine", fv.cosine("vec", "next")), ("distance", fv.euclidean("vec", "next")), ("norm", fv.norm("vec")))])


def d14_content_vectors(spark, sf):
    e = v.table(spark, sf, "embeddings")
    n = e.count()
    m = v.uses(spark, sf).select("tech_id", (F.col("company_id") % n).alias("article_id"))
    t = v.technologies(spark, sf)
    out = vectors.content_vectors(m.join(t.select("tech_id"), "tech_id"), e.select(F.col("vec_id").alias("article_id"), "embedding"), t, 3)
    return out.select("tech_id", "n", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[63], 6).alias("last"))


def k1_vector_search(spark, sf):
    f = vectors.nearest(_rows(spark, sf), _queries(spark, sf), 5)
    return f.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def e6_top_members(spark, sf):
    return vectors.top_members(_rows(spark, sf), 5).select("cluster_id", "id", "similarity", F.col("rank").cast("long").alias("rank"))


def k14_near_clusters(spark, sf):
    return vectors.near_clusters(_rows(spark, sf), 0.05)


def d19_sizes(spark, sf):
    return _rows(spark, sf).where("cluster_id <> -1").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members")).orderBy(F.desc("members"), "cluster_id")


def d20_cluster_context(spark, sf):
    """The eight companies with most edges into each cluster of technologies."""
    r = _rows(spark, sf)
    u = v.uses(spark, sf).join(r.where("cluster_id <> -1").select(F.col("id").alias("tech_id"), "cluster_id"), "tech_id")
    n = u.groupBy("cluster_id", "company_id").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("rank", F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("n"), "company_id"))).where("rank <= 8")
    return top.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "company_id"))), lambda x: x["company_id"].cast("string")), ",").alias("companies"))


def c18_lookup(spark, sf):
    """Technology names to clusters and labels; found is false for names without one."""
    r = _rows(spark, sf).select(F.col("id").alias("tech_id"), "cluster_id").where("cluster_id <> -1")
    t = v.technologies(spark, sf).groupBy(F.lower("name").alias("key")).agg(F.min("tech_id").alias("tech_id"))
    asked = v.technologies(spark, sf).select(F.col("tech_id").alias("asked_id"), F.concat("name", F.when(F.col("tech_id") % 30 == 0, "?").otherwise("")).alias("asked"))
    out = asked.join(t, F.lower("asked") == F.col("key"), "left").join(r, "tech_id", "left")
    return out.select("asked_id", "cluster_id", F.col("cluster_id").isNotNull().alias("found"))


def c21_align_labels(spark, sf):
    r = _rows(spark, sf)
    return v.technologies(spark, sf).join(r.select(F.col("id").alias("tech_id"), "cluster_id"), "tech_id", "left").select("tech_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def k17_catalogue(spark, sf):
    """Clusters with their size and their members' names in order."""
    r = _rows(spark, sf).select(F.col("id").alias("tech_id"), "cluster_id").where("cluster_id <> -1")
    t = v.technologies(spark, sf).join(r, "tech_id")
    sizes = t.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))
    names = t.select("cluster_id", "name").distinct().withColumn("k", F.row_number().over(W.partitionBy("cluster_id").orderBy("name"))).where("k <= 10")
    return sizes.join(names.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("sample")), "cluster_id")


def b16_catalogue_search(spark, sf):
    return k17_catalogue(spark, sf).where(F.contains("sample", F.lit("anvil")) & (F.col("members") > 5)).select("cluster_id", "members")


def k19_label_records(spark, sf):
    """Cluster records with a label where one is given, else UNLABELED, and those outliers that the shown members hold."""
    k = k17_catalogue(spark, sf)
    labels = v.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("cluster_id"), F.col("r_name").alias("label"))
    shown, outliers = F.split("sample", ","), F.array(F.lit("blue anvil"), F.lit("nothing"))
    return k.join(labels, "cluster_id", "left").select("cluster_id", "members", F.coalesce("label", F.lit("UNLABELED")).alias("label"), F.array_join(F.array_intersect(outliers, shown), ",").alias("outliers"))


def k13_metrics(spark, sf):
    return vectors.clustering_metrics(_rows(spark, sf)).select("clusters", "noise_ratio", F.round("davies_bouldin", 4).alias("davies_bouldin"), F.round("calinski_harabasz", 2).alias("calinski_harabasz"), F.round("silhouette", 4).alias("silhouette"))


def k10_dbscan(spark, sf):
    return vectors.dbscan(_rows(spark, sf), 0.9, 5)


def k11_k_distance(spark, sf):
    return vectors.k_distances(_rows(spark, sf), 5)


def k11_knee(spark, sf):
    return vectors.knee(vectors.k_distances(_rows(spark, sf), 5))


def k6_scaled(spark, sf):
    """Standard scores of three columns (population deviation), weighted."""
    p = v.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") * 0 + 3).cast("double").alias("c"))
    return features.scaled(p, "p_partkey", {"a": 1.0, "b": 2.0, "c": 1.0}, "standard")


def k6_minmax(spark, sf):
    p = v.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return features.scaled(p, "p_partkey", {"a": 1.0, "b": 0.5}, "minmax")


def k6_robust(spark, sf):
    """Median and quartiles of two columns, with a value between two rows and one without spread."""
    p = v.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), F.lit(7.0).alias("c"))
    return features.scaled(p, "p_partkey", {"a": 1.0, "b": 0.5, "c": 1.0}, "robust")


def k8_one_hot(spark, sf):
    p = v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return features.one_hot(p, "id", "community", 3)


def k5_matrix(spark, sf):
    t = v.technologies(spark, sf).select(F.col("tech_id").alias("id"))
    jobs = v.requires(spark, sf).groupBy(F.col("tech_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("jobs"))
    comps = v.uses(spark, sf).where("tech_id % 3 <> 0").groupBy(F.col("tech_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("companies"))
    return features.feature_matrix(t, {"jobs": jobs, "companies": comps})


def k7_pca(spark, sf):
    out = features.principal(_rows(spark, sf), 8)
    return out.select("id", F.round(fv.norm("reduced"), 4).alias("length"))


def k9_kmeans(spark, sf):
    return features.kmeans(_rows(spark, sf), 8, restarts=2).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))


#: Three fits and one that fails.
GRID = (("kmeans", {"k": 4}), ("kmeans", {"k": 8}), ("dbscan", {"eps": 0.9, "min_samples": 5}), ("dbscan", {"eps": -1.0, "min_samples": 5}))


def k12_grid(spark, sf):
    return features.run_trials(_rows(spark, sf), GRID, new_folder(spark, "trials"), least=2, most=28)


def f5_best_trial(spark, sf):
    return features.best_trial(features.run_trials(_rows(spark, sf), GRID[:2], new_folder(spark, "trials"), least=2, most=28), "davies_bouldin")


def k15_name_vectors(spark, sf):
    t = v.technologies(spark, sf).select(F.col("tech_id").alias("id"), "name")
    return features.name_vectors(t, 32).select("id", F.round(fv.norm("vec"), 6).alias("length"))


def k16_relevance(spark, sf):
    d = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("text").alias("title"), F.col("quality").cast("double").alias("label"))
    return features.relevance(d.where("label is not null"), d, "doc_id")


def k18_missing_vectors(spark, sf):
    """Vectors only for the articles that have none, joined to those that have, with the coverage."""
    a = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("name"))
    have = _rows(spark, sf).select("id", "vec").where("id % 2 = 0")
    return features.with_missing_vectors(a, have, 64).groupBy("made").agg(F.count(F.lit(1)).alias("n"))


NAMES = [n for n in list(globals()) if n[0] in "bcdefhk" and n[1].isdigit()]
QUERIES = {k: globals()[k] for k in NAMES}

R = "with r as (select vec_id as id, embedding::double[] as vec, case when vec_id % 11 = 0 then -1 else label end::bigint as cluster_id from embeddings)"
CENT = R + ", x as (select cluster_id, id, unnest(vec) as x, generate_subscripts(vec, 1) as i from r where cluster_id <> -1), m as (select cluster_id, i, avg(x) as x from x group by 1, 2), c as (select cluster_id, list(x order by i) as centroid from m group by 1)"
CAT = v.with_views("technologies") + ", r as (select vec_id as tech_id, case when vec_id % 11 = 0 then -1 else label end::bigint as cluster_id from embeddings), t as (select cluster_id, name from technologies join r using (tech_id) where cluster_id <> -1), s as (select cluster_id, name, row_number() over (partition by cluster_id order by name) as k from (select distinct * from t)), k as (select cluster_id, (select count(*) from t where t.cluster_id = s.cluster_id) as members, string_agg(name, ',' order by name) filter (where k <= 10) as sample from s group by 1)"
ORACLES = {
    "h26_vectors": R + ", n as (select id, vec, lead(vec) over (partition by cluster_id order by id) as next from r) select id, round(list_dot_product(vec, next), 6) as dot, round(list_cosine_similarity(vec, next), 6) as cosine, round(list_distance(vec, next), 6) as distance, round(sqrt(list_dot_product(vec, vec)), 6) as norm from n where next is not null",
    "d14_content_vectors": v.with_views("uses", "technologies") + ", e as (select vec_id, embedding::double[] as vec, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings), x as (select tech_id, vec[1] / n as a, vec[64] / n as z from uses join e on vec_id = company_id % (select count(*) from embeddings) ), g as (select tech_id, count(*) as n, avg(a) as a, avg(z) as z from x group by 1 having count(*) >= 3) select tech_id, coalesce(n, 0) as n, round(a, 6) as first, round(z, 6) as last from technologies left join g using (tech_id)",
    "k1_vector_search": R + ", s as (select q.id as query_id, r.id, list_cosine_similarity(q.vec, r.vec) as s from r q, r where q.id % 50 = 0), k as (select *, row_number() over (partition by query_id order by s desc, id) as rank from s) select query_id, id, round(s, 6) as score, rank from k where rank <= 5",
    "e6_top_members": CENT + ", s as (select cluster_id, id, round(list_cosine_similarity(vec, centroid), 6) as similarity from r join c using (cluster_id)), k as (select *, row_number() over (partition by cluster_id order by similarity desc, id) as rank from s) select * from k where rank <= 5",
    "k14_near_clusters": CENT + ", d as (select id, c.cluster_id, list_distance(vec, centroid) as d from r join c on r.cluster_id <> c.cluster_id), s as (select *, 1 - d / max(d) over (partition by id) as s from d) select id, cluster_id, round(s, 4) as score from s where s >= 0.05",
    "d19_sizes": R + " select cluster_id, count(*) as members from r where cluster_id <> -1 group by 1",
    "d20_cluster_context": v.with_views("uses") + ", n as (select label::bigint as cluster_id, company_id, count(*) as n from uses join embeddings on vec_id = tech_id where vec_id % 11 <> 0 group by 1, 2), k as (select *, row_number() over (partition by cluster_id order by n desc, company_id) as r from n) select cluster_id, string_agg(company_id, ',' order by r) as companies from k where r <= 8 group by 1",
    "c18_lookup": v.with_views("technologies") + ", t as (select lower(name) as key, min(tech_id) as tech_id from technologies group by 1), a as (select tech_id as asked_id, lower(name || case when tech_id % 30 = 0 then '?' else '' end) as key from technologies) select asked_id, label::bigint as cluster_id, label is not null as found from a left join t using (key) left join embeddings on vec_id = tech_id and vec_id % 11 <> 0",
    "c21_align_labels": v.with_views("technologies") + " select tech_id, case when vec_id is null or vec_id % 11 = 0 then -1 else label end::bigint as cluster_id from technologies left join embeddings on vec_id = tech_id",
    "k17_catalogue": CAT + " select * from k",
    "b16_catalogue_search": CAT + " select cluster_id, members from k where contains(sample, 'anvil') and members > 5",
    "k19_label_records": CAT + " select cluster_id, members, coalesce(r_name, 'UNLABELED') as label, case when list_contains(split(sample, ','), 'blue anvil') then 'blue anvil' else '' end as outliers from k left join region on r_regionkey = cluster_id",
    "k11_k_distance": R + ", d as (select a.id, list_distance(a.vec, b.vec) as d from r a, r b where a.id <> b.id), k as (select id, d, row_number() over (partition by id order by d) as k from d) select id, round(d, 6) as kth, row_number() over (order by round(d, 6) desc, id) as place from k where k = 5",
    "k6_scaled": "select p_partkey, round((p_size - avg(p_size) over ()) / stddev_pop(p_size) over (), 6) as a, round(2 * (p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over (), 6) as b, 0.0::double as c from part",
    "k6_minmax": "select p_partkey, round((p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ()), 6) as a, round(0.5 * (p_retailprice - min(p_retailprice) over ()) / (max(p_retailprice) over () - min(p_retailprice) over ()), 6) as b from part",
    "k13_metrics": CENT + """, n as (select cluster_id, count(*) as n, avg(list_distance(vec, centroid)) as s, sum(pow(list_distance(vec, centroid), 2)) as w, any_value(centroid) as centroid from r join c using (cluster_id) group by 1),
        mean as (select list(x order by i) as mean from (select i, avg(x) as x from x group by 1)), worst as (select a.cluster_id, max((a.s + b.s) / list_distance(a.centroid, b.centroid)) as r from n a join n b on a.cluster_id <> b.cluster_id group by 1),
        k as (select count(*) as k, sum(n) as n, sum(w) as within, sum(n * pow(list_distance(centroid, mean), 2)) as between from n, mean),
        d as (select a.id, a.cluster_id as own, b.cluster_id, sum(list_distance(a.vec, b.vec)) as d, count(*) as n from r a join r b on a.cluster_id <> -1 and b.cluster_id <> -1 group by 1, 2, 3),
        ab as (select id, max(case when own = cluster_id then n end) as size, max(case when own = cluster_id then d / greatest(n - 1, 1) end) as a, min(case when own <> cluster_id then d / n end) as b from d group by 1)
        select k as clusters, (select round(avg((cluster_id = -1)::int), 6) from r) as noise_ratio, (select round(avg(r), 4) from worst) as davies_bouldin, round(between / (k - 1) / (within / (n - k)), 2) as calinski_harabasz, (select round(avg(case when size > 1 then (b - a) / greatest(a, b) else 0 end), 4) from ab) as silhouette from k""",
    "k6_robust": "with s as (select median(p_size) as am, quantile_cont(p_size::double, 0.75) - quantile_cont(p_size::double, 0.25) as ab, median(p_retailprice) as bm, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) as bb from part) select p_partkey, round((p_size - am) / ab, 6) as a, round(0.5 * (p_retailprice - bm) / bb, 6) as b, 0.0::double as c from part, s",
    "k8_one_hot": "with t as (select p_brand, row_number() over (order by count(*) desc, p_brand) as r from part group by 1) select p_partkey as id, coalesce(r = 1, false)::int::double as c0, coalesce(r = 2, false)::int::double as c1, coalesce(r = 3, false)::int::double as c2 from part left join t on t.p_brand = part.p_brand and r <= 3",
    "k5_matrix": v.with_views("requires", "uses", "technologies") + " select tech_id as id, (select count(*) from requires r where r.tech_id = t.tech_id)::double as jobs, case when tech_id % 3 <> 0 then (select count(*) from uses u where u.tech_id = t.tech_id) else 0 end::double as companies from technologies t",
    "k18_missing_vectors": "select not (doc_id % 2 = 0 and doc_id in (select vec_id from embeddings)) as made, count(*) as n from documents group by 1",
}
ORACLES["k11_knee"] = "with curve as (" + ORACLES["k11_k_distance"] + "), e as (select max(kth) as y0, min(kth) as y1, max(place) as n from curve) select kth as eps from curve, e order by round(1 - (place - 1) / greatest(n - 1, 1) - (kth - y1) / greatest(y0 - y1, 1e-12), 9) desc, place limit 1"
