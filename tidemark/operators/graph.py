"""Property-graph operators on node and edge tables: neighbours, paths, co-mentions, centrality, components, upserts.

Nodes are (id, label, name, ...), edges (type, src, dst). Ids are strings made of label and key unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.vectors import unit
from tidemark.operators.factors import walk_vectors
from tidemark.sources.shared import bucketed, stored


#: Edges that one task makes unique.
PAIRS = 500_000


def unique_pairs(edges: DataFrame) -> DataFrame:
    """(a, b): each pair of different linked ends once, the lesser end first, in tasks of about PAIRS edges each."""
    tasks = max(1, -(-edges.count() // PAIRS))
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).repartition(tasks, "a", "b").distinct()


def _turned(pairs: DataFrame) -> DataFrame:
    """(src, dst): pairs (a, b) in both directions."""
    a, b = F.col("a"), F.col("b")
    both = F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst")))
    return pairs.select(F.explode(both).alias("e")).select("e.src", "e.dst")


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, repeated ones and self-loops dropped. Edges are counted before, so ones that are costly to
    make are best stored."""
    return _turned(unique_pairs(edges))


def projected(edges: DataFrame, labels: Sequence[str], types: Sequence[str]) -> DataFrame:
    """(type, src_label, src, dst_label, dst): edges (the same columns) of the given types between nodes of the given labels,
    each in both directions and once. Ids are told apart by label, so a job and a company may share one."""
    kept = edges.where(F.col("type").isin(list(types)) & F.col("src_label").isin(list(labels)) & F.col("dst_label").isin(list(labels)))
    kept = kept.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("type", "src_label", "src", "dst_label", "dst")
    back = kept.select("type", F.col("dst_label").alias("src_label"), F.col("dst").alias("src"), F.col("src_label").alias("dst_label"), F.col("src").alias("dst"))
    return kept.unionByName(back).distinct()


def wrote(mentions: DataFrame) -> DataFrame:
    """WROTE edges (type, src, dst) from persons to the articles that MENTIONS edges (type, src, dst_label, dst) name them in,
    each once."""
    people = mentions.where("type = 'MENTIONS' and dst_label = 'Person'")
    return people.select(F.lit("WROTE").alias("type"), F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def co_use(uses: DataFrame, companies: DataFrame, tech_ids: DataFrame, location: str) -> DataFrame:
    """(tech_id, company_id, other_id): what else the companies of a place use that use a technology. A path never goes
    back over the edge that it came by."""
    here = companies.where(F.contains(F.lower("location"), F.lit(location.lower()))).select("company_id")
    first = uses.join(tech_ids.select("tech_id"), "tech_id").join(here, "company_id")
    other = uses.select("company_id", F.col("tech_id").alias("other_id"))
    return first.join(other, "company_id").where("other_id <> tech_id").select("tech_id", "company_id", "other_id")


def first_neighbours(edges: DataFrame, centers: DataFrame, k: int = 10) -> DataFrame:
    """(center, neighbour): of each center the k neighbours with the least ids. Only edges at a center are made unique."""
    asked = centers.select(F.col("id").alias("src"))
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both.join(asked, "src", "left_semi").where("src <> dst").distinct().join(asked, "src")
    rank = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("src").alias("center"), F.col("dst").alias("neighbour"))


#: Keywords of a request at most: so many rows are broadcast.
MOST_KEYWORDS = 10_000


def best_node(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, id, name): one node whose name contains each keyword; an exact name first, then the shortest, then by id.

    Keywords are a request's few rows, so each is compared with every name; ValueError beyond MOST_KEYWORDS of them.
    """
    low, key = F.lower("name"), F.lower("keyword")
    asked = keywords.select("keyword").distinct()
    if len(asked.take(MOST_KEYWORDS + 1)) > MOST_KEYWORDS:
        raise ValueError(f"a request has more than {MOST_KEYWORDS} keywords")
    hits = nodes.join(F.broadcast(asked), F.contains(low, key))
    order = W.partitionBy("keyword").orderBy(F.desc((low == key).cast("int")), F.length("name"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("keyword", "id", "name")


def explore(nodes: DataFrame, edges: DataFrame, keywords: DataFrame, depth: int = 1, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the best node of each keyword: k neighbours of each center, at depth 2 those of the new ones too."""
    if depth not in (1, 2):
        raise ValueError("depth must be 1 or 2")
    centers = F.broadcast(stored(best_node(nodes, keywords).select("id").distinct(), "centers"))  # MOST_KEYWORDS rows at most
    found = first_neighbours(edges, centers, k)
    seen = centers.union(found.select(F.col("neighbour").alias("id"))).distinct()
    if depth == 2:
        new = F.broadcast(stored(seen.join(centers, "id", "left_anti"), "new"))  # k rows a center at most
        more = first_neighbours(edges, new, k)
        found = found.union(more)
        seen = seen.union(more.select(F.col("neighbour").alias("id"))).distinct()
    pairs = found.select(F.least("center", "neighbour").alias("src"), F.greatest("center", "neighbour").alias("dst")).distinct()
    return nodes.join(seen, "id", "left_semi"), pairs


def distances(edges: DataFrame, start: DataFrame, hops: int = 6) -> DataFrame:
    """(id, hop) of all nodes within so many undirected steps of the start nodes, level by level; each level is stored."""
    return _levels(stored(symmetric(edges), "near"), start, hops)


def _levels(near: DataFrame, start: DataFrame, hops: int, end: str | None = None) -> DataFrame:
    """(id, hop) of the nodes level by level, up to the level that holds the node `end`, if it is given."""
    level = stored(start.select("id").distinct().withColumn("hop", F.lit(0).cast("long")), "level")
    seen = level
    for h in range(1, hops + 1):
        new = near.join(level.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        level = stored(new.join(seen, "id", "left_anti").withColumn("hop", F.lit(h).cast("long")), "level")
        if not level.head(1):
            break
        seen = seen.union(level)
        if end is not None and level.where(F.col("id") == end).head(1):
            break
    return seen


def shortest_paths(nodes: DataFrame, edges: DataFrame, start: str, end: str, prefer: str = "Company", hops: int = 6) -> DataFrame:
    """One row (found, length, path): the shortest undirected path, of equally short ones that with most `prefer` nodes, then
    by ids. Only nodes on some shortest path are walked again, backwards from the end."""
    spark = edges.sparkSession
    if not start or not end or start == end:
        raise ValueError("two different nodes are needed")
    near = stored(symmetric(edges), "near")
    away = stored(_levels(near, spark.createDataFrame([(start,)], "id string"), hops, end), "away")
    reach = away.where(F.col("id") == end).first()
    none = spark.createDataFrame([(False, None, None)], "found boolean, length long, path array<string>")
    if reach is None:
        return none
    liked = nodes.select("id", (F.col("label") == prefer).cast("long").alias("liked"))
    best = away.where("hop = 0").join(liked, "id", "left").select("id", F.coalesce("liked", F.lit(0)).cast("long").alias("n"), F.array("id").alias("path"))
    best = stored(best, "best")  # so that its size is known, and edges are not shuffled for a few nodes
    for h in range(1, reach["hop"] + 1):
        step = near.join(best.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "n", "path")
        step = step.join(away.where(F.col("hop") == h).select("id"), "id").join(liked, "id", "left")
        step = step.select("id", (F.col("n") + F.coalesce("liked", F.lit(0))).alias("n"), F.concat("path", F.array("id")).alias("path"))
        order = W.partitionBy("id").orderBy(F.desc("n"), F.concat_ws("|", "path"))
        best = stored(step.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank"), "best")
    return best.where(F.col("id") == end).select(F.lit(True).alias("found"), F.lit(reach["hop"]).cast("long").alias("length"), "path")


def co_mentions(mentions: DataFrame, item: str, key: str, least: int) -> DataFrame:
    """(a, b, n): pairs of items (a < b) that share `least` keys or more. Pairs are made within a key; keys are documents or
    companies, whose item lists are short."""
    m = mentions.select(F.col(key).alias("k"), F.col(item).alias("x")).distinct()
    pairs = m.alias("l").join(m.alias("r"), (F.col("l.k") == F.col("r.k")) & (F.col("l.x") < F.col("r.x")))
    return pairs.groupBy(F.col("l.x").alias("a"), F.col("r.x").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def degree(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the least id that undirected edges lead to, by label propagation with shortcuts. RuntimeError if it
    has not settled."""
    near = stored(symmetric(edges), "near")
    label = stored(near.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("component")), "label")
    for _ in range(rounds):
        offered = near.join(label, near.dst == label.id).groupBy(F.col("src").alias("n")).agg(F.min("component").alias("o"))
        new = label.join(offered, label.id == offered.n).select("id", F.least("component", "o").alias("component"))
        new = stored(new, "label")
        # follow the label's own label: halves the length of chains
        hop = new.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        new = stored(new.join(hop, new.component == hop.c).select("id", F.least("component", "cc").alias("component")), "label")
        if not new.join(label, "id").where(new.component != label.component).head(1):
            return new
        label = new
    raise RuntimeError("components have not settled")


#: Edges of a bucket, and nodes whose scores are broadcast at once.
BUCKET, HUBS = 4_000_000, 500_000


def _buckets(pairs: DataFrame, size: int = BUCKET) -> int:
    return max(pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // size))


def _most_linked(degree: DataFrame, most: int) -> DataFrame:
    """(id): the nodes of degree (id, degree) with the highest degrees, `most` at most; of one degree all or none."""
    each = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(W.orderBy(F.desc("degree")))  # a row for each degree that there is
    least = each.withColumn("so_far", so_far).where(F.col("so_far") <= most).agg(F.min("degree")).first()[0]
    return degree.where("false" if least is None else F.col("degree") >= least).select("id")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, hubs: int = HUBS) -> DataFrame:
    """(id, score) on the undirected graph: (1 - d) + d * the sum of each neighbour's score over its degree.

    Edges lie in buckets, so no round shuffles them. Those of the `hubs` most linked nodes lie once, with their other end:
    it gets the hub's share from a broadcast table, and its own share is summed for the hub before the shuffle. Only shares
    between two other nodes are shuffled edge by edge.
    """
    pairs = stored(unique_pairs(edges), "pairs")
    buckets = _buckets(pairs)
    degree = stored(_turned(pairs).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "degree")
    hub = F.broadcast(stored(_most_linked(degree, hubs).withColumn("hub", F.lit(True)), "hubs"))
    of = lambda c: hub.select(F.col("id").alias(c), F.col("hub").alias(f"{c}_hub"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    near_hub = known.where("a_hub or b_hub").select(F.when(F.col("b_hub"), F.col("a")).otherwise(F.col("b")).alias("end"), F.when(F.col("b_hub"), F.col("b")).otherwise(F.col("a")).alias("at"))
    near_hub = bucketed(near_hub, "near-hubs", ["end"], buckets)
    other = bucketed(_turned(known.where("a_hub is null and b_hub is null").select("a", "b")), "near", ["src"], buckets)
    linked = bool(other.head(1))
    score = stored(degree.withColumn("score", F.lit(1.0)), "score")
    share = F.col("score") / F.col("degree")
    for _ in range(rounds):
        shares = score.select("id", share.alias("share"))
        of_hubs = F.broadcast(shares.join(hub, "id").select(F.col("id").alias("at"), "share"))
        sent = near_hub.join(of_hubs, "at").groupBy(F.col("end").alias("id")).agg(F.sum("share").alias("in"))
        of_ends = shares.withColumnRenamed("id", "end")
        sent = sent.unionByName(near_hub.join(of_ends, "end").groupBy(F.col("at").alias("id")).agg(F.sum("share").alias("in")))
        if linked:
            of_src = shares.withColumnRenamed("id", "src")
            sent = sent.unionByName(other.join(of_src, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("in")))
        total = degree.join(sent.groupBy("id").agg(F.sum("in").alias("in")), "id")
        score = stored(total.select("id", "degree", (F.lit(1 - damping) + damping * F.col("in")).alias("score")), "score")
    return score.select("id", "score")


#: Pairs and nodes of a bucket of vectors, and vectors that are broadcast at once.
VECTOR_PAIRS, VECTOR_NODES, VECTORS = 8_000_000, 500_000, 200_000


def _vector_sums(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """(id, vec): the sum by place of the vectors of rows (key, vec), null ones left out."""
    sums = rows.groupBy(key).agg(*[F.sum(F.col("vec")[i]).alias(f"s{i}") for i in range(dim)])
    return sums.select(F.col(key).alias("id"), F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(dim)]).alias("vec"))


def fast_random_projection(edges: DataFrame, dim: int = 64, weights: Sequence[float] = (0.0, 1.0, 1.0, 1.0), hubs: int = HUBS, block: int = VECTORS) -> DataFrame:
    """(id, embedding): sparse random vectors by hash, averaged over neighbours and L2-normalised in rounds, summed by weight.

    No edge carries a vector through a shuffle if one end is a hub, one of the `hubs` most linked nodes: pairs lie in buckets
    of their other end with its vectors, hubs' vectors are broadcast, `block` at a time, and the sums of hubs are made in each
    bucket before they are shuffled. Of two hubs the more linked one counts. A mean's length does not matter, so sums are
    normalised.
    """
    pairs = stored(unique_pairs(edges), "pairs")
    degree = stored(_turned(pairs).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "degree")
    buckets = max(_buckets(pairs, VECTOR_PAIRS), -(-degree.count() // VECTOR_NODES))
    hub = F.broadcast(stored(degree.join(F.broadcast(_most_linked(degree, hubs)), "id"), "hubs"))
    of = lambda c: hub.select(F.col("id").alias(c), F.col("degree").alias(f"{c}_hub"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    at_b = F.coalesce(F.col("b_hub") >= F.coalesce("a_hub", F.lit(0)), F.lit(False))
    near_hub = known.where("a_hub is not null or b_hub is not null").select(F.when(at_b, F.col("a")).otherwise(F.col("b")).alias("end"), F.when(at_b, F.col("b")).otherwise(F.col("a")).alias("at"))
    near_hub = bucketed(near_hub, "near-hubs", ["end"], buckets)
    other = bucketed(_turned(known.where("a_hub is null and b_hub is null").select("a", "b")), "near", ["src"], buckets)
    linked = bool(other.head(1))
    at = stored(near_hub.select("at").distinct(), "at")
    blocks = max(1, -(-at.count() // block))
    at = F.broadcast(at.select(F.col("at").alias("id")))  # at most `hubs` ids
    h = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(6)) for i in range(dim)]
    start = F.array(*[F.when(x == 0, 3.0**0.5).when(x == 1, -(3.0**0.5)).otherwise(0.0) for x in h])
    now = bucketed(degree.select("id", start.alias("vec")), "vectors", ["id"], buckets)
    rounds = [(weights[0], now)]
    for r, w in enumerate(weights[1:], 1):
        of_hubs = now.join(at, "id", "left_semi").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        sent = near_hub
        for b in range(blocks):
            sent = sent.join(F.broadcast(of_hubs.where(F.col("block") == b).select(F.col("id").alias("at"), F.col("vec").alias(f"vec{b}"))), "at", "left")
        sent = sent.select("end", F.coalesce(*[f"vec{b}" for b in range(blocks)]).alias("vec"))
        of_end = now.select(F.col("id").alias("end"), "vec").hint("shuffle_hash")  # VECTOR_NODES a bucket
        sums = [_vector_sums(sent, "end", dim), _vector_sums(near_hub.join(of_end, "end"), "at", dim)]
        if linked:
            sums.append(_vector_sums(other.join(now.select(F.col("id").alias("src"), "vec").hint("shuffle_hash"), "src"), "dst", dim))
        got = now.select("id")
        for i, s in enumerate(sums):  # sums of ends lie in the buckets; the others are brought there, so that no vector is moved
            s = s.repartition(buckets, "id") if i else s
            got = got.join(s.withColumnRenamed("vec", f"sum{i}"), "id", "left")
        places = [sum(F.coalesce(F.col(f"sum{i}")[d], F.lit(0.0)) for i in range(len(sums))) for d in range(dim)]
        now = got.select("id", unit(F.array(*places)).alias("vec"))
        if r < len(weights) - 1:
            now = bucketed(now, "vectors", ["id"], buckets)
        rounds.append((w, now))
    used = [(w, v.withColumnRenamed("vec", f"vec{i}")) for i, (w, v) in enumerate(rounds) if w] or [(0.0, now.withColumnRenamed("vec", "vec0"))]
    total = used[0][1]
    for _, v in used[1:]:
        total = total.join(v, "id")
    weighted = [(w, next(c for c in v.columns if c != "id")) for w, v in used]
    return total.select("id", F.array(*[sum(w * F.col(c)[d] for w, c in weighted) for d in range(dim)]).alias("embedding"))


#: Neighbours that stand in one row.
CHUNK = 1024


def random_walks(edges: DataFrame, length: int = 10, walks: int = 10, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """(id, walk, path): uniform walks, the same in every run: the neighbour is drawn by hash among the sorted ones.

    Neighbours stand in rows of `chunk` at most with their own degrees, in buckets, so a step shuffles walks alone."""
    return _walks(stored(unique_pairs(edges), "pairs"), length, walks, seed, chunk)


def _walks(pairs: DataFrame, length: int, walks: int, seed: int, chunk: int) -> DataFrame:
    """random_walks on pairs (a, b) that stand there once."""
    both, buckets = _turned(pairs), _buckets(pairs)
    degree = stored(both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "degree")
    i = F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1
    near = both.join(degree.select(F.col("id").alias("dst"), "degree"), "dst").withColumn("i", i)
    near = near.groupBy(F.col("src").alias("at"), F.floor(F.col("i") / chunk).alias("part")).agg(F.sort_array(F.collect_list(F.struct("i", "dst", "degree"))).alias("them"))
    near = near.select("at", "part", F.transform("them", lambda x: F.struct(x.dst.alias("dst"), x.degree.alias("degree"))).alias("them"))
    near = bucketed(near, "steps", ["at", "part"], buckets)
    now = degree.select("id", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.col("id").alias("at"), F.array("id").alias("path"), "degree")
    for s in range(1, length):
        pick = F.pmod(F.xxhash64("id", "walk", F.lit(s), F.lit(seed)), "degree")
        now = now.withColumn("pick", pick).select("id", "walk", "at", "path", (F.col("pick") % chunk).cast("int").alias("pick"), F.floor(F.col("pick") / chunk).alias("part"))
        step = now.join(near, ["at", "part"]).select("id", "walk", "path", F.get("them", F.col("pick")).alias("to"))
        now = step.select("id", "walk", F.col("to.dst").alias("at"), F.concat("path", F.array("to.dst")).alias("path"), F.col("to.degree").alias("degree"))
    return stored(now.select("id", "walk", "path"), "walks")


def numbered(ids: DataFrame) -> DataFrame:
    """(id, number) of the different ids, numbered from 0 in their order, without gathering them: a number is a place in a
    range of the order behind the ranges before it."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = stored(ids.select("id").where("id is not null").distinct().repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ids")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row a partition
    before = d.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy("id")) - 1 + F.col("before")
    return d.join(before, "part").select("id", place.cast("long").alias("number"))


def co_occurrences(walks: DataFrame, window: int = 5) -> DataFrame:
    """(id, context, n): how often a node stands within `window` steps of another one on the walks (path)."""
    at = walks.select("path", F.posexplode("path").alias("i", "id"))
    near = F.slice("path", F.greatest(F.col("i") - window + 1, F.lit(1)), F.least(F.col("i"), F.lit(window)))
    ahead = F.slice("path", F.col("i") + 2, F.lit(window))
    each = at.select("id", F.explode(F.concat(near, ahead)).alias("context")).where("id <> context")
    return each.groupBy("id", "context").agg(F.count(F.lit(1)).alias("n"))


def node_vectors(walks: DataFrame, dim: int = 64, seed: int = 42, window: int = 5, negatives: int = 1, rounds: int = 5) -> DataFrame:
    """(id, vector) of the nodes on walks (path): the factors of the matrix that skip-gram with negative sampling fits, see
    factors.walk_vectors. Nodes without positive information (with more negatives, there may be some) have no vector; no
    walks: no rows."""
    at = walks.select(F.monotonically_increasing_id().alias("walk"), "path")
    at = stored(at.select("walk", F.posexplode("path").alias("i", "id")).where("id is not null"), "places")
    number = stored(numbered(at.select("id")), "numbers")
    paths = at.join(number, "id").groupBy("walk").agg(F.sort_array(F.collect_list(F.struct("i", "number"))).alias("them"))
    return _named(stored(paths.select(F.transform("them", lambda x: x.number.cast("int")).alias("path")), "paths"), number, dim, seed, window, negatives, rounds)


def edge_vectors(edges: DataFrame, length: int = 10, walks: int = 10, dim: int = 64, seed: int = 42, window: int = 5, negatives: int = 1, rounds: int = 5) -> DataFrame:
    """(id, vector): node_vectors of random walks on the edges. Nodes are numbered before they are walked, so that walks are
    short rows of numbers; the same in every run, but drawn by number, not by id as random_walks of these edges are."""
    pairs = stored(unique_pairs(edges), "pairs")
    number = stored(numbered(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))), "numbers")
    of = lambda c: number.select(F.col("id").alias(c), F.col("number").cast("int").alias(f"{c}_number"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("a_number").alias("a"), F.col("b_number").alias("b"))
    paths = _walks(stored(pairs, "pairs"), length, walks, seed, CHUNK).select("path")
    return _named(paths, number, dim, seed, window, negatives, rounds)


def _named(paths: DataFrame, number: DataFrame, dim: int, seed: int, window: int, negatives: int, rounds: int) -> DataFrame:
    if number.count() >= 1 << 31:
        raise OverflowError("2^31 nodes or more")
    return walk_vectors(paths, dim, seed, window, negatives, rounds).join(number, "number").select("id", "vector")


def upsert(old: DataFrame, new: DataFrame, key: str, replace: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Nodes of both tables by key: the first known value of each property wins, the old table before the new one by
    `ord`; a value listed in `replace` for its column gives way to a later one."""
    replace = replace or {}
    cols = [c for c in old.columns if c not in (key, "ord")]
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    at = F.struct("age", "ord")

    def first(c):
        known = F.col(c).isNotNull() & ~F.coalesce(F.col(c).isin(list(replace.get(c, ["\0"]))), F.lit(False)) if c in replace else F.col(c).isNotNull()
        return F.coalesce(F.min_by(F.when(known, F.col(c)), F.when(known, at)), F.min_by(c, F.when(F.col(c).isNotNull(), at))).alias(c)

    return both.groupBy(key).agg(*[first(c) for c in cols])


def rewrite_aliases(edges: DataFrame, aliases: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Edges with endpoints replaced by their canonical ids; repeated edges and, between two such ends, self-loops go."""
    out = edges
    for c in cols:
        a = aliases.select(F.col("id").alias("_id"), F.col("canonical").alias("_c"))
        out = out.join(a, out[c] == a._id, "left").withColumn(c, F.coalesce("_c", c)).drop("_id", "_c")
    out = out.distinct()
    return out.where(F.col(cols[0]) != F.col(cols[1])) if len(cols) == 2 else out


def canonical_ids(techs: DataFrame, job_counts: DataFrame, canonical_name) -> DataFrame:
    """(id, canonical): of the technologies with one alias key, the one named canonically first, then that with most jobs,
    the shortest name, by name and by id."""
    t = techs.select("tech_id", "name", canonical_name(F.col("name")).alias("group")).join(job_counts, "tech_id", "left").na.fill(0, ["n"])
    order = W.partitionBy(F.lower("group")).orderBy(F.desc((F.col("name") == F.col("group")).cast("int")), F.desc("n"), F.length("name"), "name", "tech_id")
    return t.select(F.col("tech_id").alias("id"), F.first("tech_id").over(order).alias("canonical"))
