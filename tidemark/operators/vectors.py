"""Vectors: means by group, nearest neighbours, cluster summaries, density clustering and clustering metrics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine, euclidean, unit
from tidemark.operators.graph import components
from tidemark.sources.shared import stored

#: Queries that are held by every task at once; more are worked on block by block.
BLOCK = 2048
#: Rows of the base, and queries of a block, that meet at once.
ROWS, QUERIES = 1024, 256
#: Rows of two blocks that are compared at once for the k-distance curve.
PIECE = 512
#: Rows of a block of a cell at most, and blocks that a cell is split into while they are no larger.
MOST_ROWS, PARTS = 65_536, 16


def _dim(rows: DataFrame, vec: str) -> int:
    first = rows.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    return first[0] if first else 0


def _sums(u: DataFrame, group: str, dim: int) -> DataFrame:
    """(group, n, total, s0, s1, ...) of rows (group, w, u): places as plain columns of one aggregation."""
    return u.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"), *[F.sum(F.col("u")[i] * F.col("w")).alias(f"s{i}") for i in range(dim)])


def _mean(sums: DataFrame, group: str, dim: int, least: int) -> DataFrame:
    mean = F.array(*[F.col(f"s{i}") / F.col("total") for i in range(dim)])
    return sums.where(F.col("n") >= least).select(group, mean.alias("embedding"), "n")


def mean_vectors(rows: DataFrame, group: str, vec: str, weight: Column | None = None, least: int = 1) -> DataFrame:
    """(group, embedding, n): weighted mean of L2-normalised vectors by place; groups below `least` rows get none.

    Places are summed as plain columns of one aggregation, so that partial sums are combined before the shuffle.
    """
    dim, w = _dim(rows, vec), F.lit(1.0) if weight is None else weight
    u = rows.where(F.col(vec).isNotNull()).select(group, w.alias("w"), unit(vec).alias("u"))
    return _mean(_sums(u, group, dim), group, dim, least)


#: Articles whose vectors are broadcast at once.
ARTICLES = 200_000


def content_vectors(mentions: DataFrame, articles: DataFrame, techs: DataFrame, least: int = 1, half_year: float | None = None, block: int = ARTICLES) -> DataFrame:
    """(tech_id, embedding, n) for every technology: the mean of its articles' vectors, weighted by exp(-days / half_year)
    since its latest article if half_year is given; n = 0 and null where there are too few.

    Vectors are normalised once an article. Mentions are shuffled by technology, as pairs of ids, and meet the vectors there,
    `block` articles at a time, so that no vector is shuffled for a mention: only sums are, one a technology and block.
    """
    known = articles.where("embedding is not null")
    dim, weight, m = _dim(known, "embedding"), F.lit(1.0), mentions.select("tech_id", "article_id")
    kept = known.select("article_id", unit("embedding").alias("u"), *(["published"] if half_year else []))
    if half_year:
        latest = m.join(known.select("article_id", "published"), "article_id").groupBy("tech_id").agg(F.max("published").alias("latest"))
        m = m.join(latest, "tech_id")
        weight = F.exp(-F.coalesce(F.datediff("latest", "published"), F.lit(0)) / half_year)
    kept = stored(kept, "units")
    blocks = max(1, -(-kept.count() // block))
    m, of = m.repartition("tech_id"), F.pmod(F.xxhash64("article_id"), F.lit(blocks))
    each = [_sums(m.where(of == b).join(F.broadcast(kept.where(of == b)), "article_id").select("tech_id", weight.alias("w"), "u"), "tech_id", dim) for b in range(blocks)]
    sums = each[0]
    if blocks > 1:
        places = ["n", "total", *[f"s{i}" for i in range(dim)]]
        sums = reduce(DataFrame.unionByName, each).groupBy("tech_id").agg(*[F.sum(c).alias(c) for c in places])
    return techs.select("tech_id").join(_mean(sums, "tech_id", dim, least), "tech_id", "left").na.fill(0, ["n"])


def nearest(base: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", drop_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k best rows of base (id, vec) for each query (id, vec); ties by id.

    Each task keeps the k best of its rows for a block of queries, so at most tasks x k rows a query are shuffled; it holds the
    scores of QUERIES by ROWS at once.
    """
    out = None
    blocks = -(-queries.count() // BLOCK)
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vec").toPandas()  # about BLOCK queries
        if part.empty:
            continue
        q, qid = np.array(part["vec"].tolist(), np.float64), part["id"].to_numpy()

        def best(batches, q=q, qid=qid):
            slices = [slice(i, i + QUERIES) for i in range(0, len(q), QUERIES)]
            held = [None] * len(slices)
            for pdf in batches:
                for at in range(0, len(pdf), ROWS):
                    x, ids = np.array(pdf["vec"].iloc[at : at + ROWS].tolist(), np.float64), pdf["id"].iloc[at : at + ROWS].to_numpy()
                    for i, some in enumerate(slices):
                        y, s = q[some], q[some] @ x.T
                        if metric == "cosine":
                            s /= np.maximum(np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None], 1e-300)
                        else:
                            s = -np.sqrt(np.maximum((y * y).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * s, 0))
                        if drop_self:
                            s[qid[some, None] == ids[None]] = -np.inf
                        both = (s, np.broadcast_to(ids, s.shape)) if held[i] is None else (np.hstack([held[i][0], s]), np.hstack([held[i][1], np.broadcast_to(ids, s.shape)]))
                        top = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
                        held[i] = tuple(np.take_along_axis(a, top, 1) for a in both)
            for some, h in zip(slices, held):
                if h is not None:
                    keep = np.isfinite(h[0])
                    yield pd.DataFrame({"query_id": np.repeat(qid[some], keep.sum(1)), "id": h[1][keep], "score": h[0][keep]})

        got = base.select("id", "vec").mapInPandas(best, "query_id long, id long, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return base.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def centroids(rows: DataFrame, label: str = "cluster_id", vec: str = "vec") -> DataFrame:
    """(label, centroid, n) without noise (-1)."""
    first = rows.select(F.size(vec)).first()
    dim = first[0] if first else 0
    df = rows.where(F.col(label) != -1).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(vec)[i].cast("double")).alias(f"m{i}") for i in range(dim)])
    return df.select(label, F.array(*[F.col(f"m{i}") for i in range(dim)]).alias("centroid"), "n")


def top_members(rows: DataFrame, k: int) -> DataFrame:
    """(cluster_id, id, similarity, rank): the k members most like their cluster's centroid."""
    j = rows.join(centroids(rows).drop("n"), "cluster_id").select("cluster_id", "id", F.round(cosine("vec", "centroid"), 6).alias("similarity"))
    return j.withColumn("rank", F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)


#: Centroids that stand in one row when rows meet them.
CENTROIDS = 256


def near_clusters(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, cluster_id, score): other clusters whose centroid is near, 1 - distance / the largest of these distances.

    Centroids stand in blocks, an array of CENTROIDS at most a row; each row meets each block by the block's number, so the
    pairs of row and centroid are made inside a row, and only near ones and a maximum leave it.
    """
    c = stored(centroids(rows).select(F.col("cluster_id").alias("other"), "centroid"), "centroids")
    blocks = -(-c.count() // CENTROIDS)
    if not blocks:
        return rows.select("id", "cluster_id", F.lit(0.0).alias("score")).where("false")
    c = c.withColumn("block", F.pmod(F.xxhash64("other"), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct("other", "centroid")).alias("them"))
    each = rows.select("id", F.col("cluster_id").alias("own"), "vec").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    others = F.filter("them", lambda x: x.other != F.col("own"))
    d = each.join(c, "block").select("id", "vec", others.alias("them")).select("id", F.transform("them", lambda x: F.struct(x.other.alias("other"), euclidean(F.col("vec"), x.centroid).alias("d"))).alias("ds"))
    d = d.withColumn("far", F.array_max(F.transform("ds", lambda x: x.d)))
    if blocks > 1:
        d = d.withColumn("far", F.max("far").over(W.partitionBy("id")))
    d = d.where("far > 0").withColumn("near", F.filter("ds", lambda x: 1 - x.d / F.col("far") >= threshold))
    return d.select("id", F.explode("near").alias("x"), "far").select("id", F.col("x.other").alias("cluster_id"), F.round(1 - F.col("x.d") / F.col("far"), 4).alias("score"))


#: Pivots at most: every task holds all of them.
MOST_PIVOTS = 4096


def neighbour_pairs(rows: DataFrame, eps: float, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): all pairs within eps (Euclidean), both directions.

    Rows are dealt to the cell of their nearest pivot and to every cell whose pivot is no further than that by more than
    2 eps, which keeps every pair together in some cell. A cell of more than `block` rows is split by hash into blocks, and
    every two blocks meet in one group, for both directions. A cell has PARTS blocks at most until they hold MOST_ROWS rows,
    so a row is sent PARTS times at most in cells of up to PARTS x MOST_ROWS rows; distances are held in bounded pieces. Pivots
    are about the square root of the number of rows; where eps is too wide for cells to part the rows, all of them are one cell.
    """
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "a long, b long")
    blocks = lambda n: -(-n // min(max(-(-n // PARTS), block), max(block, MOST_ROWS)))
    if pivots is None:
        pivots = min(MOST_PIVOTS, math.isqrt(n)) if n > block else 1
    p = rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(pivots).select("vec").toPandas()  # MOST_PIVOTS at most
    center = np.array(p["vec"].tolist(), np.float64).reshape(len(p), -1)

    def near(pdf: pd.DataFrame, center: np.ndarray):
        x = np.array(pdf["vec"].tolist(), np.float64)
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (center * center).sum(1)[None] - 2 * x @ center.T, 0))
        return d.argmin(1), *np.nonzero(d <= d.min(1)[:, None] + 2 * eps + 1e-9)

    def count(batches):
        for pdf in batches:
            if not pdf.empty:
                yield pd.DataFrame({"n": [len(near(pdf, center)[1])]})

    if len(center) > 1 and (rows.select("vec").mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0) > n * blocks(n):
        center = center[:1]  # more copies in cells than in blocks of the whole

    def deal(batches):
        for pdf in batches:
            if not pdf.empty:
                home, r, c = near(pdf, center)
                yield pd.DataFrame({"cell": c, "home": home[r] == c, "id": pdf["id"].to_numpy()[r], "vec": [pdf["vec"].iloc[i] for i in r]})

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, home, own = np.array(pdf["vec"].tolist(), np.float64), pdf["id"].to_numpy(), pdf["home"].to_numpy(), pdf["own"].to_numpy()
        lo, hi = (np.flatnonzero(own == pdf[c].iloc[0]) for c in ("lo", "hi"))
        norm, same = (x * x).sum(1), pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        out = [pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})]
        for r in range(0, len(lo), ROWS):
            for s in range(0, len(hi), ROWS):
                p, q = lo[r : r + ROWS], hi[s : s + ROWS]
                i, j = np.nonzero(norm[p][:, None] + norm[q][None] - 2 * x[p] @ x[q].T <= eps * eps + 1e-12)
                i, j = p[i], q[j]
                for a, b in ((i, j),) if same else ((i, j), (j, i)):  # asked where a is at home, which is one cell
                    keep = home[a] & (ids[a] != ids[b])
                    out.append(pd.DataFrame({"a": ids[a[keep]], "b": ids[b[keep]]}))
        return pd.concat(out)

    cells = stored(rows.select("id", "vec").mapInPandas(deal, "cell int, home boolean, id long, vec array<double>"), "cells")
    sizes = [(r["cell"], blocks(r["n"])) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row a pivot
    cells = cells.join(F.broadcast(rows.sparkSession.createDataFrame(sizes, "cell int, blocks long")), "cell")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = cells.select("cell", "home", "id", "vec", F.pmod(F.xxhash64("id"), "blocks").alias("own"), other.alias("other"))
    dealt = dealt.select("cell", "home", "id", "vec", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return dealt.groupBy("cell", "lo", "hi").applyInPandas(pairs, "a long, b long").distinct()


def dbscan(rows: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster_id): core rows have min_samples rows within eps, themselves included; clusters are the components of
    core rows, named by their least id; a border row joins the cluster of its least core neighbour; the rest is -1. Equal
    vectors are compared once, by their least id, and counted; rows without a vector are noise."""
    one = stored(rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "vectors")
    near = stored(neighbour_pairs(one, eps), "near")
    others = near.join(one.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    around = F.col("n") + F.coalesce("others", F.lit(0))
    core = stored(one.select("id", "n").join(others, "id", "left").where(around >= min_samples).select("id"), "core")
    links = near.join(core.withColumnRenamed("id", "a"), "a").join(core.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = core.join(components(stored(links, "links")), "id", "left").select("id", F.coalesce("component", "id").alias("cluster_id"))
    found = stored(found, "clusters")
    border = near.join(found.select(F.col("id").alias("b"), "cluster_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min_by("cluster_id", "b").alias("border"))
    label = one.select("id", "vec").join(found, "id", "left").join(border, "id", "left")
    label = label.select("vec", F.coalesce("cluster_id", "border", F.lit(-1)).cast("long").alias("cluster_id"))
    return rows.select("id", "vec").join(label, "vec", "left").select("id", F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"))


def blocks_of(n: int) -> int:
    """Blocks that so many rows are dealt to, of which every two meet."""
    return 1 if n <= BLOCK else max(PARTS, -(-n // MOST_ROWS))


def k_distances(rows: DataFrame, k: int = 5) -> DataFrame:
    """(id, kth, place): distance of every row to its k-th nearest other row, in descending order; none where there are
    fewer others.

    Rows are dealt to blocks by hash, PARTS of them while they hold MOST_ROWS at most, so a row is sent PARTS times, and every
    two blocks meet in one group, which sends the k least distances of its rows: each pair of rows is compared once, for both
    directions, in pieces of PIECE by PIECE.
    """
    blocks = blocks_of(rows.count())

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, b = np.array(pdf["vec"].tolist(), np.float64), pdf["id"].to_numpy(), pdf["b"].to_numpy()
        ends = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        norm, one, held = (x * x).sum(1, keepdims=True), np.ones((len(x), 1)), np.full((len(x), k), np.inf)
        left, right = np.hstack([-2 * x, norm, one]), np.hstack([x, one, norm])  # their products are squared distances

        def keep(at: np.ndarray, d: np.ndarray) -> None:
            """Of the rows at these places, to which others have the squared distances d."""
            some = np.flatnonzero(d.min(1) < held[at, k - 1])
            if len(some):
                d = np.partition(d[some], k - 1, axis=1)[:, :k] if k < d.shape[1] else d[some]
                held[at[some]] = np.sort(np.hstack([held[at[some]], d]), axis=1)[:, :k]

        mine, other = ([at[i : i + PIECE] for i in range(0, len(at), PIECE)] for at in (np.flatnonzero(b == e) for e in ends))
        for i, p in enumerate(mine):
            for q in other[i:] if ends[0] == ends[1] else other:
                d = left[p] @ right[q].T
                if ends[0] == ends[1]:
                    d[ids[p][:, None] == ids[q][None]] = np.inf
                keep(p, d)
                if q[0] != p[0]:
                    keep(q, d.T)
        return pd.DataFrame({"id": ids, "d": [np.sqrt(np.maximum(v[np.isfinite(v)], 0)) for v in held]})

    dealt = rows.select("id", "vec").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("id", "vec", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))
    d = dealt.groupBy("lo", "hi").applyInPandas(least, "id long, d array<double>").groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("d"))).alias("d"))
    d = d.where(F.size("d") >= k).select("id", F.round(F.col("d")[k - 1], 6).alias("kth"))
    # places: those in a range of the order, behind those of the ranges before it
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = stored(d.repartitionByRange(parts, F.desc("kth"), "id").withColumn("part", F.spark_partition_id()), "k-distances")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row a partition
    before = d.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(F.desc("kth"), "id")) + F.col("before")
    return d.join(before, "part").select("id", "kth", place.cast("long").alias("place"))


def knee(curve: DataFrame) -> DataFrame:
    """One row (eps): the point of a k-distance curve that lies furthest from the line between its ends."""
    c = curve.crossJoin(F.broadcast(curve.agg(F.max("kth").alias("y0"), F.min("kth").alias("y1"), F.max("place").alias("n"))))
    x, y = (F.col("place") - 1) / F.greatest(F.col("n") - 1, F.lit(1)), (F.col("kth") - F.col("y1")) / F.greatest(F.col("y0") - F.col("y1"), F.lit(1e-12))
    return c.withColumn("off", F.round(1 - x - y, 9)).orderBy(F.desc("off"), "place").limit(1).select(F.col("kth").alias("eps"))


def clustering_metrics(rows: DataFrame, sample: int = 5000) -> DataFrame:
    """One row: clusters, noise_ratio, davies_bouldin, calinski_harabasz (whole table) and the Euclidean silhouette of a
    bounded sample; the scores are NaN below two clusters. Centroids are one row a cluster."""
    c = stored(centroids(rows), "centroids")
    n_clusters = c.count()
    noise = rows.agg(F.round(F.avg((F.col("cluster_id") == -1).cast("int")), 6).alias("noise_ratio"), F.count(F.when(F.col("cluster_id") != -1, 1)).alias("n"))
    if n_clusters < 2:
        return noise.select(F.lit(n_clusters).cast("long").alias("clusters"), "noise_ratio", *[F.lit(float("nan")).alias(x) for x in ("davies_bouldin", "calinski_harabasz", "silhouette")])
    own = rows.where("cluster_id <> -1").join(c, "cluster_id").select("cluster_id", euclidean("vec", "centroid").alias("d"))
    spread = stored(own.groupBy("cluster_id").agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("w")).join(c, "cluster_id"), "spread")
    a, b = spread.alias("a"), spread.alias("b")
    ratio = (F.col("a.s") + F.col("b.s")) / euclidean(F.col("a.centroid"), F.col("b.centroid"))
    worst = a.join(b, F.col("a.cluster_id") != F.col("b.cluster_id")).groupBy("a.cluster_id").agg(F.max(ratio).alias("r"))
    all_mean = centroids(rows.where("cluster_id <> -1").withColumn("cluster_id", F.lit(0))).select(F.col("centroid").alias("mean"))
    between = spread.join(all_mean).agg(F.sum(F.col("n") * F.pow(euclidean("centroid", "mean"), 2)).alias("between"), F.sum("w").alias("within"))
    db = worst.agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))
    ch = F.round(F.col("between") / (n_clusters - 1) / (F.col("within") / (F.col("n") - n_clusters)), 4)
    some = stored(rows.where("cluster_id <> -1").withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample).select("id", "vec", "cluster_id"), "sample")
    s = silhouette(some).agg(F.round(F.avg("s"), 6).alias("silhouette"))
    return noise.join(between).join(db).join(s).select(F.lit(n_clusters).cast("long").alias("clusters"), "noise_ratio", "davies_bouldin", ch.alias("calinski_harabasz"), "silhouette")


def silhouette(rows: DataFrame) -> DataFrame:
    """(id, s) of a bounded sample: each row against blocks of all the others."""
    all_rows = rows.toPandas()  # the sample
    x, label = np.array(all_rows["vec"].tolist(), np.float64), all_rows["cluster_id"].to_numpy()
    kinds, at = np.unique(label, return_inverse=True)
    size = np.bincount(at)

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            q, mine = np.array(pdf["vec"].tolist(), np.float64), np.searchsorted(kinds, pdf["cluster_id"].to_numpy())
            d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0))
            sums = np.stack([d[:, at == k].sum(1) for k in range(len(kinds))], axis=1)
            i = np.arange(len(q))
            a = sums[i, mine] / np.maximum(size[mine] - 1, 1)
            other = sums / size
            other[i, mine] = np.inf
            b = other.min(1)
            yield pd.DataFrame({"id": pdf["id"], "s": np.where(size[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)})

    return rows.repartition(8).mapInPandas(run, "id long, s double")
