"""What keeps operators in bounds on large tables: work done once, bounded pieces, and the same results by every way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as fv
from tidemark.operators import graph, vectors
from tidemark.streaming import streams


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_unit_takes_its_vector_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "a array<double>")
    u = df.select(fv.unit(F.array_sort("a")).alias("u"))
    assert plan(u).count("array_sort(") == 1
    assert [r.u for r in u.collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_hashed_vectors_count_words_once(spark):
    df = spark.createDataFrame([("u1", "b b", "a"), ("u2", None, " ")], "source_url string, title string, content string")
    v = streams.vectors_of(df, 8)
    assert plan(v).count("xxhash64(") == 1
    got = {r.source_url: sorted(r.embedding) for r in v.collect()}
    assert got["u1"][-1] == pytest.approx(2 / 5**0.5) and got["u1"][-2] == pytest.approx(1 / 5**0.5) and got["u2"] == [0.0] * 8


@pytest.mark.parametrize("half_year", [None, 30.0])
def test_content_vectors_in_blocks(spark, half_year):
    rng = np.random.default_rng(1)
    vec = {a: rng.normal(size=3).tolist() for a in range(20)} | {20: None}
    day = {a: f"2024-01-{a + 1:02d}" if a != 3 else None for a in vec}
    pairs = [(int(t), int(a)) for t, a in zip(rng.integers(0, 5, 60), rng.integers(0, 22, 60))]
    m = spark.createDataFrame(pairs, "tech_id long, article_id long")
    a = spark.createDataFrame([(k, v, day[k]) for k, v in vec.items()], "article_id long, embedding array<double>, published string").withColumn("published", F.to_date("published"))
    got = {r.tech_id: r for r in vectors.content_vectors(m, a, spark.range(6).withColumnRenamed("id", "tech_id"), 2, half_year, block=6).collect()}
    assert got[5].n == 0 and got[5].embedding is None
    for t in range(5):
        mine = [x for s, x in pairs if s == t and vec.get(x)]
        late = max(x for x in mine if day[x])
        w = np.array([np.exp(-(late - x if day[x] else 0) / half_year) if half_year else 1.0 for x in mine])
        u = np.array([np.array(vec[x]) / np.linalg.norm(vec[x]) for x in mine])
        assert got[t].n == len(mine) and got[t].embedding == pytest.approx(((w[:, None] * u).sum(0) / w.sum()).tolist())


def test_nodes_are_looked_at_again_only_after_a_neighbour_moved():
    """Ten rings of ten in a ring: settled rings are not counted through again in each of the passes."""
    from tidemark.operators import louvain

    rng = np.random.default_rng(3)
    pairs = {(min(a, b), max(a, b)) for g in range(10) for a, b in rng.integers(10 * g, 10 * g + 10, (30, 2)).tolist() if a != b} | {(10 * g, 10 * g + 11) for g in range(9)}
    s, d = np.array(sorted([*pairs, *[(b, a) for a, b in pairs]])).T
    w, n = np.ones(len(s)), 100
    seen = []
    own = louvain.local_moves(s, d, w, n, float(len(s)), np.arange(n), np.bincount(s, weights=w, minlength=n), n, visits=seen)
    again = louvain.local_moves(s, d, w, n, float(len(s)), own, np.bincount(own[s], weights=w, minlength=n), n)
    assert (again == own).all()  # settled: no single move is better
    assert seen[0] == n and seen[-1] < n


def test_communities_of_ids_that_are_no_numbers(spark):
    """Strings and the numbers of their order have the same communities, through blocks too."""
    from tidemark.operators import louvain

    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for g in range(6) for a, b in rng.integers(20 * g, 20 * g + 20, (80, 2))] + [(20 * g, 20 * g + 21) for g in range(5)]
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    for links in (10_000, 200):
        text = louvain.communities(spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}") for a, b in pairs if a != b], "src string, dst string"), block_links=links)
        ints = louvain.communities(spark.createDataFrame([(at[a], at[b]) for a, b in pairs if a != b], "src long, dst long"), block_links=links)
        assert {r.id: r.community for r in text.collect()} == {f"n{nodes[r.id]:03d}": f"n{nodes[r.community]:03d}" for r in ints.collect()}


def test_only_runs_that_are_names_are_counted(spark):
    """Both ways give the same; with a small dictionary no run that is no name reaches the count of runs."""
    from tidemark.operators import entities

    t = spark.createDataFrame([(1, "Big data, big data. data"), (2, None), (3, "nothing here")], "id long, text string")
    names = spark.createDataFrame([("Big Data", "TECH"), ("data", "TECH"), ("DATA", "ORG"), (" ", "ORG")], "name string, label string")
    want = {(1, "TECH", "big data", 2), (1, "TECH", "data", 3), (1, "ORG", "data", 3)}
    for most in (3, 1):
        got = entities.dictionary_entities(t, names, most=most)
        assert {tuple(r) for r in got.collect()} == want
        joins_below = got._jdf.queryExecution().optimizedPlan().toString().split("count(1)")[1].count("Join")
        assert joins_below == (most == 3)


def test_post_files_are_parsed_once(spark):
    from tidemark.operators import importing

    value = '{"source_platform":"s","post_detail":[{"title":"T","content":"c","entities":{"TECH":["Go"],"ORG":["Acme"],"LOC":["Hue"]}},{"job":{"title":"Dev"},"company":{"name":"Acme"},"skills":["x"],"technologies":["Go"]}]}'
    t = importing.import_posts(spark.createDataFrame([("f1", value)], "file string, value string"), "2026-01-01")
    assert all("from_json" not in plan(df) for df in t.values())
    assert [(r.name, r.location) for r in t["companies"].collect()] == [("Acme", "Hue")]
    assert [(r.title, r.name, r.n) for r in t["job_technologies"].collect()] == [("Dev", "Go", 1)]
    assert [(r.title, r.name) for r in t["article_company"].collect()] == [("T", "Acme")]


def test_only_edges_at_a_center_are_made_unique(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("a", "a"), (None, "a")], "src string, dst string")
    got = graph.first_neighbours(e, spark.createDataFrame([("a",)], "id string"), 2)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b"), ("a", "c")]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in text.split("Aggregate")[1]


def test_shortest_path_makes_edges_unique_once(spark, monkeypatch):
    made, real = [], graph.symmetric
    monkeypatch.setattr(graph, "symmetric", lambda e: made.append(1) or real(e))
    e = spark.createDataFrame([("s", "p"), ("p", "q"), ("q", "t"), ("s", "q2"), ("q2", "r"), ("r", "t")], "src string, dst string")
    n = spark.createDataFrame([("q2", "Company")], "id string, label string")
    assert graph.shortest_paths(n, e, "s", "t").first().path == ["s", "q2", "r", "t"] and len(made) == 1


def test_nearest_meets_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 7)
    x = np.random.default_rng(2).normal(size=(60, 4))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").coalesce(1)
    got = {(r.query_id, r.rank): r.id for r in vectors.nearest(base, base.where("id < 3"), 4, "euclidean", True).collect()}
    for q in range(3):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        assert [got[q, k] for k in range(1, 5)] == np.argsort(d)[:4].tolist()


@pytest.mark.parametrize("depth", [1, 2])
def test_explore_sends_its_few_centers_to_the_edges(spark, depth):
    n = spark.createDataFrame([(x, "T", f"node {x}") for x in "abcd"], "id string, label string, name string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    nodes, pairs = graph.explore(n, e, spark.createDataFrame([("node a",)], "keyword string"), depth)
    assert {r.id for r in nodes.collect()} == set("abc"[: depth + 1])
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("rightHint=(strategy=broadcast)") >= 2 * depth


def test_projection_sends_no_vector_for_an_edge(spark):
    """Any choice of hubs, in one block or several, gives the same as sums over all neighbours; edges are shuffled by ids alone."""
    rng = np.random.default_rng(7)
    pairs = sorted({(f"c{a}", f"t{b}") for a, b in rng.integers(0, [4, 12], (30, 2)).tolist()} | {("c0", "c1"), ("t0", "t1"), ("t1", "t2")})
    e = spark.createDataFrame([*pairs, ("c0", "c0"), pairs[0]], "src string, dst string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    h = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(6)) for i in range(4)]
    start = {r.id: np.array([{0: 3**0.5, 1: -(3**0.5)}.get(x, 0.0) for x in r.h]) for r in spark.createDataFrame([(x,) for x in near], "id string").select("id", F.array(*h).alias("h")).collect()}
    want, now = {x: 0.5 * v for x, v in start.items()}, start
    for w in (1.0, 2.0):
        mean = {x: sum(now[y] for y in near[x]) / len(near[x]) for x in near}
        now = {x: m / np.linalg.norm(m) if np.linalg.norm(m) > 1e-9 else 0 * m for x, m in mean.items()}
        want = {x: want[x] + w * now[x] for x in near}
    for hubs, block in ((100, 2), (5, 100), (0, 100)):
        out = graph.fast_random_projection(e, 4, (0.5, 1.0, 2.0), hubs, block)
        got = {r.id: r.embedding for r in out.collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x].tolist(), abs=1e-9) for x in want)


def test_nearest_holds_slices_of_queries(spark, monkeypatch):
    """Slices of queries, pieces of the base and blocks of queries, all smaller than what they are taken from."""
    for name, size in (("QUERIES", 3), ("ROWS", 7), ("BLOCK", 9)):
        monkeypatch.setattr(vectors, name, size)
    x = np.random.default_rng(4).normal(size=(60, 4))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").coalesce(2)
    got = {(r.query_id, r.rank): r.id for r in vectors.nearest(base, base.where("id < 20"), 3).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == {(q, k + 1): int(i) for q in range(20) for k, i in enumerate(np.argsort(-(u @ u[q]))[:3])}


def test_rows_are_sent_to_few_blocks(spark):
    """A cell is split into PARTS blocks at most while they are small enough, and each two meet once, for both directions."""
    x = np.random.default_rng(6).uniform(size=(300, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.1
    out = vectors.neighbour_pairs(df, 0.1, 1, 5)
    assert sorted((r.a, r.b) for r in out.collect()) == [(i, j) for i, j in zip(*np.nonzero(d)) if i != j]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in text and text.count("explode(") == 1


@pytest.mark.parametrize("starts", [1000, 1])
def test_runs_are_made_of_first_words_of_names(spark, monkeypatch, starts):
    """Runs at the end of a text, inside longer ones, and of names that share their first word."""
    from tidemark.operators import entities

    monkeypatch.setattr(entities, "STARTS", starts)
    t = spark.createDataFrame([(1, "new york, New York times new"), (2, ""), (3, "york new. york")], "id long, text string")
    names = spark.createDataFrame([("New York", "LOC"), ("new york times", "ORG"), ("york", "PER"), ("times new york city", "ORG")], "name string, label string")
    got = entities.dictionary_entities(t, names)
    want = {(1, "LOC", "new york", 2), (1, "ORG", "new york times", 1), (1, "PER", "york", 2), (3, "LOC", "new york", 1), (3, "PER", "york", 2)}
    assert {tuple(r) for r in got.collect()} == want
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" in text and ("LeftSemi" in text) == (starts == 1)


def test_graph_writer_shuffles_no_posts_and_edges(spark, tmp_path):
    """A message twice in a batch, and what it says twice, count once for readers."""
    from tidemark.sources import batches
    from tidemark.streaming import graph_writer

    m = '{"message_type":"extracted_article","extracted_at":"2026-01-01T00:00:0%d","data":{"title":"T%d","source_url":"u","entities":{"TECH":["go","Go.",null,"Rust"],"ORG":["Acme"],"LOC":["Hue","Hue"]}}}'
    tables = graph_writer.batch_tables(graph_writer.messages(spark.createDataFrame([(m % (1, 1),), (m % (2, 2),)], "value string")))
    for name in ("posts", "edges"):
        assert not {"Aggregate", "Deduplicate"} & set(tables[name]._jdf.queryExecution().optimizedPlan().toString().replace("[", " ").split())
    assert tables["edges"].count() == 2 * 4
    batches.write_batch(tables, f"file://{tmp_path}/g", 0)
    t = graph_writer.read_graph(spark, f"file://{tmp_path}/g")
    assert sorted((r.dst_label, r.dst) for r in t["edges"].collect()) == [("Company", "acme"), ("Location", "Hue"), ("Technology", "GO"), ("Technology", "RUST")]
    assert [r.name for r in t["posts"].collect()] == ["T2"] and {(r.name, r.mention_count) for r in t["technologies"].collect()} == {("GO", 1), ("RUST", 1)}


def test_messages_are_parsed_once(spark, tmp_path):
    """No condition on a message parses its JSON again; broken, null and other messages are left out."""
    from tidemark.streaming import graph_writer

    m = '{"message_type":"extracted_article","data":{"title":"T","source_url":"u"}}'
    spark.createDataFrame([(m,), ("{broken",), (None,), ('{"message_type":"raw","data":{"source_url":"u"}}',), ('{"message_type":"extracted_job","data":{}}',)], "value string").write.parquet(f"file://{tmp_path}/m")
    got = graph_writer.messages(spark.read.parquet(f"file://{tmp_path}/m"))
    assert [(r.url, r.data.title) for r in got.collect()] == [("u", "T")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_only_edges_of_posts_said_again_are_compared(spark):
    """Two messages of one post share edges; the other post's edges are not shuffled."""
    from tidemark.streaming import graph_writer

    posts = spark.createDataFrame([("p",), ("p",), ("q",)], "id string")
    rows = [("t", "p", "x", "a"), ("t", "p", "x", "a"), ("t", "p", "x", "b"), ("t", "q", "x", "a"), ("t", "q", "y", "a")]
    got = graph_writer.distinct_edges(posts, spark.createDataFrame(rows, "type string, src string, dst_label string, dst string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(set(rows)) and got.columns == ["type", "src", "dst_label", "dst"]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("LeftAnti") < text.index("Aggregate") < text.index("LeftSemi")


def test_plain_names_need_no_replacements(spark):
    """The shortcut for plain names gives what the replacements give."""
    from tidemark.functions import text

    names = ["Go", "G", "", None, "red blue ring", " a b", "a  b", "a b ", "A Store", "Store", "A Stores", "x YouTube Store", "C++", "a\n", "ab\n", "\u2581Anna AG.", "(x y)", "Quy b", "b Quy"]
    df = spark.createDataFrame([(n, n if n is None else f"{n}\u2581") for n in names], "a string, b string")  # the mark goes again
    assert [tuple(r) for r in df.select(text.clean_entity("a"), text.clean_entity("b")).collect()] == [(r[0], r[0]) for r in df.select(text.clean_entity("a")).collect()]


def test_shortest_path_walks_no_further_than_its_end(spark, monkeypatch):
    made, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: made.append(name) or real(df, name))
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")], "src string, dst string")
    n = spark.createDataFrame([("b", "Company")], "id string, label string")
    assert graph.shortest_paths(n, e, "a", "c").first().path == ["a", "b", "c"]
    assert made.count("level") == 3 and not graph.shortest_paths(n, e, "a", "x").first().found


def _information(paths, window, negatives=1):
    """The positive pointwise mutual information of all nodes on paths, as one matrix."""
    n = 1 + max(x for p in paths for x in p)
    count = np.zeros((n, n))
    for p in paths:
        for i, u in enumerate(p):
            for j, w in enumerate(p):
                if 0 < abs(i - j) <= window and u != w:
                    count[u, w] += 1
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(count * count.sum() / (negatives * np.maximum(np.outer(count.sum(0), count.sum(0)), 1))), 0)


@pytest.mark.parametrize("pairs, nodes, met", [(10**9, 10**9, 10**9), (300, 40, 50)])
def test_walk_vectors_are_the_leading_ones(spark, monkeypatch, pairs, nodes, met):
    """In few blocks or many: as good an approximation as singular vectors of the whole matrix are, and their values."""
    from tidemark.operators import factors

    monkeypatch.setattr(factors, "MET", met)
    monkeypatch.setattr(factors, "COUNTED", met)
    monkeypatch.setattr(factors, "CHUNK", met)
    rng = np.random.default_rng(8)
    paths = [[int(x) for x in 13 * g + rng.integers(0, 13, rng.integers(1, 9))] for g in range(6) for _ in range(60)]
    df = spark.createDataFrame([(p,) for p in paths] + [([],), (None,)], "path array<int>")
    m = _information(paths, 3)
    got = {r.number: r.vector for r in factors.walk_vectors(df, 6, 1, 3, 1, 8, pairs, nodes).collect()}
    assert set(got) == set(np.flatnonzero(m.any(1)).tolist()) and np.mean(np.square([*got.values()])) == pytest.approx(1, abs=1e-3)
    x = np.array([got[i] if i in got else [0.0] * 6 for i in range(len(m))])
    size, want = np.linalg.norm(x, axis=0) ** 2, np.linalg.svd(m)[1][:6]
    assert size / size.sum() == pytest.approx(want / want.sum(), abs=2e-3)
    q = x / np.linalg.norm(x, axis=0)
    assert np.abs(q.T @ q - np.eye(6)).max() < 5e-3
    assert np.linalg.norm(m @ q) ** 2 > 0.99 * (want**2).sum()


def test_edge_vectors_send_no_vector_for_a_pair(spark, monkeypatch):
    """A node's vector goes to the blocks of its stripe alone, whatever the number of its neighbours."""
    from tidemark.operators import factors

    sent, real = [], factors._times

    def counted(stripes, *args):
        run = real(stripes, *args)
        where = spark.sparkContext.accumulator(0)
        sent.append((stripes, where))

        def each(block, nodes):
            where.add(nodes.num_rows)
            return run(block, nodes)

        return each

    monkeypatch.setattr(factors, "_times", counted)
    e = spark.createDataFrame([(f"c{a}", f"t{b}") for a in range(10) for b in range(30)], "src string, dst string")
    got = graph.edge_vectors(e, dim=4, rounds=2).collect()
    assert {r.id for r in got} <= {f"c{a}" for a in range(10)} | {f"t{b}" for b in range(30)} and {len(r.vector) for r in got} == {4}
    assert len(sent) == 2 and all(0 < n.value <= 40 * stripes for stripes, n in sent)


@pytest.mark.parametrize("parts, most", [(3, 1000), (2, 40)])
def test_k_distances_send_a_row_to_few_blocks(spark, monkeypatch, parts, most):
    """As many blocks for more rows, until they are full; the same distances as of all pairs, copies and null distances too."""
    assert {vectors.blocks_of(n) for n in (10_256, 51_282, 615_384)} == {vectors.PARTS} and vectors.blocks_of(2_000) == 1
    for name, n in (("BLOCK", 20), ("PARTS", parts), ("MOST_ROWS", most), ("PIECE", 9)):
        monkeypatch.setattr(vectors, name, n)
    assert vectors.blocks_of(200) == (3 if most == 1000 else 5)
    x = np.random.default_rng(9).normal(size=(200, 4))
    x[50:60] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    want = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)
    for k in (1, 5, 150):
        got = {r.id: r.kth for r in vectors.k_distances(df, k).collect()}
        assert [got[i] for i in range(200)] == pytest.approx(want[:, k].tolist(), abs=2e-6)
    assert vectors.k_distances(df, 200).count() == 0


def test_communities_shuffle_links_once_and_pairs_are_contracted(spark):
    """Links lie in buckets of their source; contracted pairs alone give the modularity of communities, level by level."""
    from tidemark.operators import louvain

    rng = np.random.default_rng(11)
    near = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 40, (150, 2)) if a != b})
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in near], "a long, b long, w double")
    links = louvain._by_node(pairs)
    assert "Exchange" not in links.groupBy("src").count()._jdf.queryExecution().executedPlan().toString()
    assert links.count() == 2 * len(near)
    own, total = {x: x // 4 * 4 for x in range(40)}, 2.0 * len(near)
    for size in (4, 8):  # the second from the pairs that the first left
        own = {x: x // size * size for x in range(40)}
        df = spark.createDataFrame([*own.items()], "id long, community long")
        pairs = louvain._contracted(pairs, df)
        inside = sum(own[a] == own[b] for a, b in near) / len(near)
        ends = np.bincount([own[x] for p in near for x in p])
        assert louvain._alone(louvain._linked(pairs), total) == pytest.approx(inside - ((ends / total) ** 2).sum())
        assert pairs.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(2 * F.col("w")))).first()[0] == total


def test_companies_and_technologies_are_not_numbered_for_communities(spark, monkeypatch):
    from tidemark.operators import louvain
    from tidemark.plans import graphs

    def numbered(*_):
        raise AssertionError("texts are numbered")

    monkeypatch.setattr(louvain, "numbered", numbered)
    lines = [(c, t) for g in range(3) for c in range(4 * g, 4 * g + 4) for t in range(10 * g, 10 * g + 10)]
    monkeypatch.setattr(graphs.v, "uses_lines", lambda *_: spark.createDataFrame(lines, "company_id long, tech_id long"))
    got = {r.id: r.community for r in graphs.j8_communities(spark, "").collect()}
    assert got == {x: f"c{4 * g}" if g < 2 else "c10" for g in range(3) for x in [*(f"c{c}" for c in range(4 * g, 4 * g + 4)), *(f"t{t}" for t in range(10 * g, 10 * g + 10))]}
