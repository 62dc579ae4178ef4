"""Generations of written clusters, resumable trials, profiles, robust scaling and functions in SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import sql, text, vectors
from tidemark.operators import features, writeback
from tidemark.operators.vectors import near_clusters
from tidemark.sources import batches, posts


def points(spark, n=60, clusters=4):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % (clusters + 1)) - 1, [float(x) for x in rng.normal(i % (clusters + 1), 0.5, 3)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, cluster_id long, vec array<double>")


def slow_near(rows, threshold):
    kinds = sorted({c for _, c, _ in rows if c != -1})
    center = {k: np.mean([x for _, c, x in rows if c == k], axis=0) for k in kinds}
    out = set()
    for i, c, x in rows:
        d = {k: float(np.linalg.norm(np.array(x) - center[k])) for k in kinds if k != c}
        out |= {(i, k, round(1 - v / max(d.values()), 4)) for k, v in d.items() if max(d.values()) > 0 and 1 - v / max(d.values()) >= threshold}
    return out


@pytest.mark.parametrize("in_a_row", [2, 256])
def test_near_clusters_in_blocks_of_centroids(spark, monkeypatch, in_a_row):
    monkeypatch.setattr("tidemark.operators.vectors.CENTROIDS", in_a_row)
    rows, df = points(spark)
    assert {tuple(r) for r in near_clusters(df, 0.3).collect()} == slow_near(rows, 0.3)
    assert near_clusters(df.where("cluster_id = -1"), 0.3).count() == 0 and near_clusters(df.where("cluster_id = 1"), 0.3).count() == 0


def test_a_run_replaces_the_one_before(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    rows, df = points(spark)
    names = spark.createDataFrame([(0, "zero")], "cluster_id long, name string")
    assert writeback.read_generation(spark, folder, "edges").count() == 0
    assert writeback.write_generation(folder, df.withColumn("cluster_id", F.lit(9).cast("long")), names) == 0
    assert writeback.write_generation(folder, df, names, 0.3) == 1
    edges = writeback.read_generation(spark, folder, "edges").collect()
    assert {(r.src, r.dst) for r in edges if r.type == "BELONGS_TO"} == {(i, c) for i, c, _ in rows if c != -1}
    assert {(r.src, r.dst, r.score) for r in edges if r.type == "NEAR_CLUSTER"} == slow_near(rows, 0.3)
    assert {(r.cluster_id, r["name"], r["size"]) for r in writeback.read_generation(spark, folder, "clusters").collect()} == {(k, "zero" if k == 0 else f"Cluster {k}", 12) for k in range(4)}
    # nothing is left of the first run
    assert batches.written_batches(spark, folder) == [1] and not (tmp_path / "w/edges/batch=0").exists()


def test_a_run_that_does_not_verify_changes_nothing(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/w"
    _, df = points(spark)
    names = spark.createDataFrame([], "cluster_id long, name string")
    writeback.write_generation(folder, df, names)
    whole = writeback.cluster_edges
    monkeypatch.setattr(writeback, "cluster_edges", lambda rows, t: whole(rows, t).where("src <> 7"))
    with pytest.raises(RuntimeError, match="members"):
        writeback.write_generation(folder, df, names)
    assert batches.written_batches(spark, folder) == [0] and writeback.read_generation(spark, folder, "edges").where("src = 7 and type = 'BELONGS_TO'").count() == 1


def test_trials_record_failures_and_skip_what_is_finished(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/t"
    _, df = points(spark)
    trials = (("kmeans", {"k": 3}), ("kmeans", {"k": 0}), ("dbscan", {"eps": 1.0, "min_samples": 3}), ("spectral", {}))
    fits = []
    fit = features._fit
    monkeypatch.setattr(features, "_fit", lambda rows, a, p: fits.append(a) or fit(rows, a, p))
    t = {r.place: r for r in features.run_trials(df, trials[:2], folder, 2, 10).collect()}
    assert t[0].error is None and t[0].clusters == 3 and t[0].valid and t[1].error.startswith("ValueError") and t[1].clusters is None and not t[1].valid
    t = {r.place: r for r in features.run_trials(df, trials, folder, 2, 10).collect()}
    # the two that were finished are not fitted again, the failed one among them
    assert fits == ["kmeans", "kmeans", "dbscan", "spectral"] and set(t) == {0, 1, 2, 3} and t[2].error is None and "spectral" in t[3].error
    best = features.best_trial(features.run_trials(df, trials, folder, 2, 10), "silhouette").first()
    assert best.valid and best.silhouette == max(r.silhouette for r in t.values() if r.valid)


def test_profiles(spark):
    long = "x" * 30
    df = spark.createDataFrame([("a", long + "1"), ("a", long + "2"), ("a", long + "2"), ("a", None), ("a", long + "0"), ("a", long + "9"), (None, "v"), ("b", None)], "label string, p string")
    got = {r.label: (r.total, r.known, r.samples) for r in posts.profile(df, "label", ["p"]).collect()}
    assert got == {"a": (6, 5, "|".join(long + c for c in "012")), None: (1, 1, "v"), "b": (1, 0, "")}
    assert posts.profile(df.where("false"), "label", ["p"]).count() == 0
    e = spark.createDataFrame([("T", "A", "B")] * 3 + [("T", "A", "C")] * 3 + [("T", None, "C")] + [("U", "A", x) for x in "ZYXWVU"], "type string, src_label string, dst_label string")
    got = [tuple(r) for r in posts.edge_profile(e).orderBy("type", "place").collect()]
    assert got[:3] == [("T", 7, 1, "A", "B", 3), ("T", 7, 2, "A", "C", 3), ("T", 7, 3, None, "C", 1)] and [r[4] for r in got[3:]] == list("UVWXY")


@pytest.mark.parametrize("exact_rows", [5, 10_000])
def test_robust_scaling(spark, exact_rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500).round(3)
    rows = [(i, float(v), 1.0) for i, v in enumerate(x)] + [(500, None, 1.0), (501, float("nan"), None)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r.id: (r.a, r.b) for r in features.scaled(df, "id", {"a": 2.0, "b": 1.0}, "robust", exact_rows).collect()}
    lo, mid, hi = np.percentile(x, [25, 50, 75])
    # the sketch returns values that there are: the neighbours of the exact quartiles here
    assert max(abs(got[i][0] - 2 * (v - mid) / (hi - lo)) for i, v in enumerate(x)) < (1e-5 if exact_rows > 500 else 0.1)
    assert got[500] == got[501] == (0.0, 0.0) and all(b == 0.0 for _, b in got.values())


def test_functions_in_sql_are_those_on_columns(spark):
    sql.register(spark)
    sql.register(spark)
    df = spark.createDataFrame([("Việt Nam_x  y-", [1.0, 2.0], 3.0, 2.0), (" A._b/C- d ", [0.0, 1.0], 1.0, 0.0), ("", [0.0, 0.0], None, 1.0), (None, [1.0, 1.0], 1.0, None)], "s string, x array<double>, a double, b double")
    df.createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT tm_slug(s), tm_post_id(s), tm_alias_key(s), round(tm_rate(a, b), 6), round(tm_cosine(x, array(1D, 1D)), 6) FROM some_texts").collect()
    both = F.array(F.lit(1.0), F.lit(1.0))
    want = df.select(text.slug("s"), text.md5_id("s"), text.alias_key("s"), F.round(F.when(F.col("b") > 0, (F.col("a") - F.col("b")) / F.col("b") * 100), 6), F.round(vectors.cosine("x", both), 6)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    spans = spark.sql("SELECT t.s, p.* FROM VALUES ('Go, c++ and the JAVA script'), (NULL), ('javax') AS t(s), LATERAL tm_phrases(t.s, array('java', 'java script', 'c++')) AS p").collect()
    assert [(r.place, r.entity) for r in spans] == [(0, "c++"), (1, "JAVA script")]
    pay = spark.sql("SELECT p.* FROM VALUES ('lương 20 triệu'), (NULL) AS t(s), LATERAL tm_pay(t.s) AS p").collect()
    assert [tuple(r) for r in pay] == [(0, "20 triệu", "SALARY")]
