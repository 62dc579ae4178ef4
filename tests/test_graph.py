"""Graph, vector and source operators against small cases worked out by hand or by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, graph, louvain, market, retrieve, vectors
from tidemark.sources import posts
from tidemark.streaming import streams


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "z")], "src string, dst string")


def test_components(edges):
    got = {r.id: r.component for r in graph.components(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_edges_are_made_unique_in_bounded_tasks(spark, edges, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 2)
    got = graph.symmetric(edges.union(edges))
    want = {p for a, b in ("ab", "bc", "ca", "cd", "xy") for p in ((a, b), (b, a))}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.rdd.getNumPartitions() == 7  # 14 edges, whatever the session's number of shuffle partitions


def test_pagerank_keeps_its_mass(edges):
    r = graph.pagerank(edges, rounds=15).collect()
    assert sum(x.score for x in r) == pytest.approx(6.0)
    assert max(r, key=lambda x: x.score).id == "c"


def test_shortest_path_prefers_companies(spark):
    e = spark.createDataFrame([("s", "p"), ("s", "q"), ("p", "t"), ("q", "t"), ("k", "k2")], "src string, dst string")
    n = spark.createDataFrame([("s", "Job"), ("t", "Job"), ("p", "Skill"), ("q", "Company"), ("k", "Job")], "id string, label string")
    got = graph.shortest_paths(n, e, "s", "t").first()
    assert (got.found, got.length, got.path) == (True, 2, ["s", "q", "t"])
    assert not graph.shortest_paths(n, e, "s", "k").first().found
    with pytest.raises(ValueError):
        graph.shortest_paths(n, e, "s", "s")


def test_walks_stay_on_edges(edges):
    pairs = {(r.src, r.dst) for r in graph.symmetric(edges).collect()}
    walks = graph.random_walks(edges, 4, 2).collect()
    assert len(walks) == 12 and all((a, b) in pairs for w in walks for a, b in zip(w.path, w.path[1:]))


def test_walks_and_scores_do_not_depend_on_rows_and_hubs(spark):
    """The same walks with one neighbour a row as with all in one; the same scores with all, some and no nodes as hubs."""
    rng = np.random.default_rng(2)
    e = [(f"{a}", f"{b}") for a, b in rng.integers(0, 30, (90, 2))] + [("hub", f"{a}") for a in range(25)]
    df = spark.createDataFrame(e, "src string, dst string")
    walks = [{tuple(map(str, r)) for r in graph.random_walks(df, 5, 3, chunk=c).collect()} for c in (1, 4, 1024)]
    assert walks[0] == walks[1] == walks[2] and len(walks[0]) == 3 * len({x for p in e for x in p})
    scores = [{r.id: r.score for r in graph.pagerank(df, rounds=4, hubs=h).collect()} for h in (0, 2, 500_000)]
    near = {frozenset(p) for p in e if p[0] != p[1]}
    want = dict.fromkeys({x for p in near for x in p}, 1.0)
    of = {x: [next(iter(p - {x})) for p in near if x in p] for x in want}
    for _ in range(4):
        want = {x: 0.15 + 0.85 * sum(want[y] / len(of[y]) for y in of[x]) for x in want}
    for got in scores:
        assert got == pytest.approx(want)


def test_communities_cut_a_bridge(spark):
    e = [(a, b) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w")]
    got = {r.id: r.community for r in louvain.communities(spark.createDataFrame(e, "src string, dst string")).collect()}
    assert len({got[x] for x in "abcd"}) == 1 and len({got[x] for x in "wxyz"}) == 1 and got["a"] != got["z"]


def _modularity(pairs, label):
    near = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    inside = sum(label[a] == label[b] for a, b in near) / len(near)
    return inside - sum((sum(label[a] == c for a, _ in near) / len(near)) ** 2 for c in set(label.values()))


def test_communities_of_contracted_ones(spark):
    """Single moves stop at the 24 triangles of a ring; only when these are nodes do neighbours among them join."""
    e = [(f"{t:02d}{x}", f"{t:02d}{y}") for t in range(24) for x, y in ("ab", "bc", "ca")]
    e += [(f"{t:02d}c", f"{(t + 1) % 24:02d}a") for t in range(24)]
    got = {r.id: r.community for r in louvain.communities(spark.createDataFrame(e, "src string, dst string")).collect()}
    triangles = {x: x[:2] for x in got}
    assert len(got) == 72 and all(c == min(x for x in got if got[x] == c) for c in set(got.values()))
    assert len(set(got.values())) < 24 and _modularity(e, got) > _modularity(e, triangles) + 0.01


def test_communities_of_no_edges(spark):
    assert louvain.communities(spark.createDataFrame([("a", "a")], "src string, dst string")).count() == 0


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x", "Unknown", 0)], "id long, name string, place string, ord int")
    b = spark.createDataFrame([(1, "y", "Huế", 1), (2, "z", None, 1)], "id long, name string, place string, ord int")
    once = graph.upsert(a, b, "id", {"place": ["Unknown", ""]})
    assert {tuple(r) for r in once.collect()} == {(1, "x", "Huế"), (2, "z", None)}
    twice = graph.upsert(once.withColumn("ord", F.lit(0)), b, "id", {"place": ["Unknown", ""]})
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in once.collect()}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [np.array([[20.0, 20.0]])])
    rows = [(i, [float(v) for v in p], i // 40 if i < 120 else -1) for i, p in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, vec array<double>, cluster_id long")


def test_neighbour_pairs_are_all_pairs(points):
    x, df = points
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 0.5)) if i != j}
    # cells of one block and of several, one cell of several blocks, and the number of pivots that the rows give
    for pivots, block in ((6, 2048), (6, 9), (1, 50), (None, 30), (None, 2048)):
        assert {(r.a, r.b) for r in vectors.neighbour_pairs(df, 0.5, pivots, block).collect()} == want


def test_dbscan_finds_the_groups(points):
    got = {r.id: r.cluster_id for r in vectors.dbscan(points[1], 1.0, 4).collect()}
    assert got[120] == -1 and len({got[i] for i in range(120)}) == 3


def test_dbscan_against_brute_force(spark):
    """With many copies of one vector, lone copies, a border row and rows without a vector."""
    x = np.round(np.random.default_rng(11).uniform(0, 6, (150, 2)), 2)
    x = np.concatenate([x, np.tile([[3.0, 3.0]], (60, 1)), np.tile([[30.0, 30.0]], (4, 1)), [[40.0, 40.0]], [[40.0, 40.3]], [[40.0, 40.0]]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.4 + 1e-9
    core = d.sum(1) >= 4
    label = np.where(core, np.arange(len(x)), len(x))
    for _ in x:
        label = np.where(core, np.where(d & core, label[None], len(x)).min(1), label)
    want = [label[i] if core[i] else label[np.flatnonzero(d[i] & core)[0]] if (d[i] & core).any() else -1 for i in range(len(x))]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(len(x), None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {r.id: r.cluster_id for r in vectors.dbscan(df, 0.4, 4).collect()}
    assert got == dict(enumerate([int(w) for w in want] + [-1])) and len(set(want)) > 3
    assert vectors.dbscan(df.limit(0), 0.4, 4).count() == 0


def test_k_distances_of_all_rows(spark):
    """More rows than one block, or than any sample of the curve."""
    x = np.random.default_rng(3).normal(size=(5200, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    kth = np.sort(d, axis=1)[:, 5]  # the row itself comes first
    curve = vectors.k_distances(df, 5)
    got = curve.orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 5201)) and sorted((-r.kth, r.id) for r in got) == [(-r.kth, r.id) for r in got]
    assert all(abs(r.kth - kth[r.id]) < 2e-6 for r in got)
    y = np.array([r.kth for r in got])
    off = 1 - np.arange(5200) / 5199 - (y - y[-1]) / (y[0] - y[-1])
    assert vectors.knee(curve).first().eps == y[np.round(off, 9).argmax()]
    assert vectors.k_distances(df.limit(5), 5).count() == 0


def test_nearest_is_exact(points):
    x, df = points
    got = vectors.nearest(df, df.where("id < 5"), 3, "euclidean", drop_self=True).orderBy("query_id", "rank").collect()
    for q in range(5):
        d = np.sqrt(((x - x[q]) ** 2).sum(-1))
        d[q] = np.inf
        assert [r.id for r in got if r.query_id == q] == np.argsort(d, kind="stable")[:3].tolist()


def test_metrics_match_numpy(points):
    x, df = points
    label = np.arange(121) // 40
    x, label = x[:120], label[:120]
    c = np.stack([x[label == k].mean(0) for k in range(3)])
    own = np.sqrt(((x - c[label]) ** 2).sum(1))
    s = np.array([own[label == k].mean() for k in range(3)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    a = np.array([d[i][label == label[i]].sum() / 39 for i in range(120)])
    b = np.array([min(d[i][label == k].mean() for k in range(3) if k != label[i]) for i in range(120)])
    got = vectors.clustering_metrics(df).first()
    assert got.davies_bouldin == pytest.approx(db, abs=1e-5)
    assert got.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-5)


def test_metrics_without_two_clusters(points):
    got = vectors.clustering_metrics(points[1].withColumn("cluster_id", F.lit(-1).cast("long"))).first()
    assert got.clusters == 0 and np.isnan(got.silhouette)


def test_adjusted_skewness(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "x double")
    assert df.select(market.adjusted_skewness(F.col("x")).alias("s")).first().s == pytest.approx(1.6523, abs=1e-4)
    assert df.limit(2).select(market.adjusted_skewness(F.col("x")).alias("s")).first().s is None


def test_best_trial_takes_the_least_davies_bouldin(spark):
    t = spark.createDataFrame([(4, 0.9, 0.1, 4, True), (8, 0.3, 0.1, 8, True), (9, 0.1, 0.1, 9, False)], "place long, davies_bouldin double, noise_ratio double, clusters long, valid boolean")
    assert features.best_trial(t, "davies_bouldin").first().place == 8


def test_rerank_falls_back(spark):
    s = spark.createDataFrame([(1, i, 0.9 - i / 10) for i in range(7)] + [(2, i, 0.1) for i in range(5)], "query_id long, id long, score double")
    got = retrieve.rerank(s).collect()
    assert sorted(r.id for r in got if r.query_id == 1) == [0, 1, 2, 3, 4]
    assert sorted((r.id, r.low_confidence) for r in got if r.query_id == 2) == [(0, True), (1, True), (2, True)]


def test_overlap_counts_every_word(spark, monkeypatch):
    """Against sets, with a word that all documents hold, more questions than a block, nulls and texts without words."""
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(["the", *(f"w{x}" for x in rng.integers(0, 30, n))])
    docs = [(i, text(12)) for i in range(600)] + [(600, None), (601, "..."), (None, "the w1"), (602, "the")]
    asked = [(i, text(4)) for i in range(11)] + [(11, "The THE the"), (12, ""), (13, None), (None, "the")]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "id long, text string")
    split = lambda t: set((t or "").lower().replace(".", "").split())
    want = {(a, b): round(len(split(t) & split(u)) / len(split(t)), 6) for a, t in asked for b, u in docs if a is not None and b is not None and split(t) & split(u)}
    for block in (2048, 3):
        monkeypatch.setattr(retrieve, "BLOCK", block)
        assert {(r.query_id, r.id): r.score for r in retrieve.overlap_scores(q, d).collect()} == want
        assert {(r.query_id, r.id) for r in retrieve.overlap_scores(q, d, least=0.6).collect()} == {p for p, s in want.items() if s >= 0.6}
        best = {(r.query_id, r.id) for r in retrieve.overlap_scores(q, d, k=3).collect()}
        assert best == {(a, b) for a in range(12) for _, b in sorted((-s, b) for (c, b), s in want.items() if c == a)[:3]}
    assert retrieve.overlap_scores(q.limit(0), d).count() == retrieve.overlap_scores(q, d.limit(0), k=3).count() == 0


def test_missing_snapshot_tables_are_listed(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="jobs, skills"):
        posts.read_snapshot(spark, f"file://{tmp_path}", ["jobs", "skills"])


def test_broken_files_are_kept_apart(spark):
    raw = spark.createDataFrame([("a", '{"post_detail":[{"title":"t","content":"c",}]}'), ("b", "nothing"), ("c", None)], "file string, value string")
    assert {r.file: r.fixed for r in posts.repaired(raw).collect()} == {"a": 1, "b": None, "c": None}


def test_page_parser():
    title, content, items = posts.parse_page("<title>T &amp; u</title><script>var p='<p>no</p>'</script><p>one <b>two</b><p>three<ul><li>x</li><li>y")
    assert (title, content, items) == ("T & u", "one two\n\nthree", "x. y")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 7).cast("string").alias("ip"))
    df.write.parquet(str(tmp_path / "v"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "v"))
    got = streams.run_once(streams.unique_visits(s, "30 days")).select("day", "ip")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in streams.unique_visits(df).collect()}


def test_vectors_count_words_by_place(spark):
    """Against numpy, with places that no word has, repeated words and blank texts. Words are counted by their order and no
    array of counts is made for each word."""
    texts = [("a", "x y x", "Z  z\ty"), ("b", "", None), ("c", None, " ".join(f"w{i % 40}" for i in range(900)))]
    df = spark.createDataFrame([(u, t, c) for u, t, c in texts], "source_url string, title string, content string")
    words = sorted({w.lower() for _, t, c in texts for w in f"{t or ''} {c or ''}".split()})
    at = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(16)).alias("h")).collect()}
    out = streams.vectors_of(df, 16)
    got = {r.source_url: r.embedding for r in out.collect()}
    for url, t, c in texts:
        n = np.bincount([at[w] for w in f"{t or ''} {c or ''}".lower().split()], minlength=16).astype(float)
        assert got[url] == pytest.approx((n / (np.linalg.norm(n) or 1.0)).tolist())
    assert "array_repeat" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_modularity_and_blocks(spark):
    """Twelve dense groups and a hub beside them all: found whole and block by block, where the hub has more links than a
    block holds; the figure that decides is the definition's."""
    rng = np.random.default_rng(4)
    e = [(g * 100 + a, g * 100 + b) for g in range(12) for a in range(15) for b in range(a) if rng.random() < 0.7]
    e += [(g * 100 + int(rng.integers(15)), (g + 1) % 12 * 100 + int(rng.integers(15))) for g in range(12) for _ in range(2)]
    e += [(9999, g * 100 + a) for g in range(12) for a in range(15)]
    df = spark.createDataFrame(e, "src long, dst long")
    links = graph.symmetric(df).withColumn("w", F.lit(1.0))
    groups = {x: x // 100 for pair in e for x in pair}
    for limit in (1_000_000, 170):
        own = louvain.communities(df, block_links=limit)
        got = {r.id: r.community for r in own.collect()}
        assert set(got) == set(groups) and all(c == min(x for x in got if got[x] == c) for c in set(got.values()))
        q = _modularity(e, got)
        assert abs(louvain.modularity(links, own, float(links.count())) - q) < 1e-9
        assert q > _modularity(e, groups) - 0.01


def test_communities_leave_out_null_ends(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("a", "b"), ("b", "a"), ("a", "b")], "src string, dst string")
    assert {tuple(r) for r in louvain.communities(df).collect()} == {("a", "a"), ("b", "a")}


def test_node_vectors_bring_neighbours_together(spark):
    """Ten groups of twelve nodes, densely linked inside and by a few links between: nodes of one group are alike."""
    rng = np.random.default_rng(6)
    e = [(f"{g:02d}-{a:02d}", f"{g:02d}-{b:02d}") for g in range(10) for a in range(12) for b in range(a) if rng.random() < 0.6]
    e += [(f"{g:02d}-00", f"{(g + 1) % 10:02d}-01") for g in range(10)]
    walks = graph.random_walks(spark.createDataFrame(e, "src string, dst string"), 10, 10)
    got = {r.id: np.array(r.vector) for r in graph.node_vectors(walks, 16).collect()}
    assert set(got) == {x for pair in e for x in pair} and {len(v) for v in got.values()} == {16}
    ids = sorted(got)
    x = np.array([got[i] / np.linalg.norm(got[i]) for i in ids])
    cosine, group = x @ x.T, np.array([i[:2] for i in ids])
    same = (group[:, None] == group[None]) & ~np.eye(len(ids), dtype=bool)
    assert cosine[same].mean() > cosine[group[:, None] != group[None]].mean() + 0.4
    # the most alike node is of the own group
    np.fill_diagonal(cosine, -1)
    assert (group[cosine.argmax(1)] == group).mean() > 0.9
    assert graph.node_vectors(walks.where("false")).count() == 0


def test_co_occurrences_and_numbers(spark):
    walks = spark.createDataFrame([(["a", "b", "c", "a"],), (["b"],)], "path array<string>")
    got = {(r.id, r.context): r.n for r in graph.co_occurrences(walks, 2).collect()}
    path, want = ["a", "b", "c", "a"], {}
    for i, u in enumerate(path):
        for j, w in enumerate(path):
            if 0 < abs(i - j) <= 2 and u != w:
                want[u, w] = want.get((u, w), 0) + 1
    assert got == want
    ids = spark.createDataFrame([(f"{i % 37:03d}",) for i in range(100)] + [(None,)], "id string")
    assert sorted((r.id, r.number) for r in graph.numbered(ids).collect()) == [(f"{i:03d}", i) for i in range(37)]
