"""Centroid clustering of integer vectors, exact, with Ptolemaic lower bounds from cached distances to pivots.

For pivots p and q, Ptolemy's inequality bounds the distance of a vector x to a centroid c from below by
|d(x,p) d(c,q) - d(x,q) d(c,p)| / d(p,q). The distances d(x,.) are computed once and stored with the vectors; each
round only needs d(c,.) of the few centroids. A centroid whose bound exceeds the best distance so far is passed over;
the others are compared exactly, in integers.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Components beyond this don't fit: squared distances of 64 of them would exceed a long.
MOST = 1 << 27
#: Vectors that pivots are chosen among, pivots, and pairs of pivots with which bounds are computed.
PIVOT_SAMPLE, PIVOTS, PAIRS = 1024, 8, 12
#: Vectors that are worked on at once in a task.
ROWS = 8192


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64, scale: int = 64) -> DataFrame:
    """(id, v) of the rows whose vector has `size` components, all of them finite numbers: v is floor(scale * x) of each,
    x as a double. Other rows go. Components of 2^27 or more after scaling raise an error, as distances would overflow."""
    e = F.col(vec_col)
    # Spark's comparisons take NaN for the greatest number
    finite = F.forall(e, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    df = rows.where((F.size(e) == size) & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    fits = F.forall("v", lambda x: (x > -MOST) & (x < MOST))
    return df.select("id", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a component of 2^27 or more"))).cast("array<int>").alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to one vector, as longs."""
    d = x.astype(np.int64) - c.astype(np.int64)
    return np.einsum("ij,ij->i", d, d)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS, pairs: int = PAIRS) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Pivots far from each other, beginning with the first row, and the pairs of them that lie farthest apart."""
    if not len(sample):
        return sample, []
    chosen, away = [0], squared(sample, sample[0])
    while len(chosen) < pivots and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, squared(sample, sample[chosen[-1]]))
    p = sample[chosen]
    apart = sorted(combinations(range(len(p)), 2), key=lambda ij: -int(squared(p[ij[0]][None], p[ij[1]])[0]))
    return p, apart[:pairs]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances as doubles; the squares are exact integers below 2^53 for all but huge components, then a rounding each."""
    return np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(np.float64)) if len(pivots) else np.zeros((len(x), 0))


def lower_bounds(xp: np.ndarray, cp: np.ndarray, pivots: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Squared lower bounds (rows of xp, rows of cp) that rounding can't push above the true squared distances.

    Each factor is off by a few units in 2^53 at most, so each product is off by less than 2^-49 of itself; that much of
    both products is given away, then 2^-48 of the quotient and of its square."""
    bound = np.zeros((len(xp), len(cp)))
    for p, q in pairs:
        one, two = xp[:, p, None] * cp[None, :, q], xp[:, q, None] * cp[None, :, p]
        apart = pivot_distances(pivots[p][None], pivots[q][None])[0, 0]
        low = (np.abs(one - two) - (one + two) * 2.0**-49) / apart
        np.maximum(bound, low, out=bound)
    return (bound * (1 - 2.0**-48)) ** 2 * (1 - 2.0**-48)


def nearest(x: np.ndarray, xp: np.ndarray, centroids: np.ndarray, pivots: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of each row, the smaller number of equals, and how many pairs
    of row and centroid were compared exactly."""
    bounds = lower_bounds(xp, pivot_distances(centroids, pivots), pivots, pairs)
    first = bounds.argmin(axis=1)
    best, of, checked = np.empty(len(x), np.int64), first.copy(), len(x)
    for j in np.unique(first):
        own = first == j
        best[own] = squared(x[own], centroids[j])
    for j in range(len(centroids)):
        left = np.flatnonzero((first != j) & (bounds[:, j] <= best.astype(np.float64) * (1 + 2.0**-52)))
        checked += len(left)
        if len(left):
            d = squared(x[left], centroids[j])
            closer = (d < best[left]) | ((d == best[left]) & (j < of[left]))
            best[left[closer]], of[left[closer]] = d[closer], j
    return of, best, checked


_CACHED = "id long, v array<int>, d array<double>"
_ASSIGNED = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
_SUMS = pa.schema([("cluster", pa.int32()), ("sums", pa.list_(pa.int64())), ("n", pa.int64()), ("inertia", pa.int64()), ("checked", pa.int64())])


def _with_distances(pivots: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int32())), ("d", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            d = pivot_distances(_matrix(b.column(1)), pivots)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(schema.field("v").type), pa.array(list(d), schema.field("d").type)], schema=schema)

    return run


def _blocks(batches):
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part.column(0), _matrix(part.column(1)), _matrix(part.column(2))


def _assign(centroids: np.ndarray, pivots: np.ndarray, pairs: list):
    def run(batches):
        for ids, x, xp in _blocks(batches):
            of, best, _ = nearest(x, xp, centroids, pivots, pairs)
            yield pa.RecordBatch.from_arrays([ids, pa.array(of, pa.int32()), pa.array(best)], schema=_ASSIGNED)

    return run


def _sum(centroids: np.ndarray, pivots: np.ndarray, pairs: list):
    """For each block a row for each cluster; Spark adds them up."""

    def run(batches):
        for _, x, xp in _blocks(batches):
            of, best, checked = nearest(x, xp, centroids, pivots, pairs)
            rows = []
            for j in np.unique(of).tolist():
                own = of == j
                rows.append((j, x[own].astype(np.int64).sum(axis=0).tolist(), int(own.sum()), int(best[own].sum()), checked))
                checked = 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMS)], schema=_SUMS)

    return run


def cluster_sums(cached: DataFrame, centroids: np.ndarray, pivots: np.ndarray, pairs: list) -> list:
    """(cluster, sums of the components, rows, summed distance, pairs checked) of each non-empty cluster: at most as many
    rows as there are centroids reach the driver. Sums are exact at any number of rows."""
    size = centroids.shape[1]
    parts = cached.mapInArrow(_sum(centroids, pivots, pairs), "cluster int, sums array<long>, n long, inertia long, checked long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    wide = parts.select("cluster", "n", "inertia", "checked", *[F.get("sums", F.lit(i)).alias(f"s{i}") for i in range(size)])
    return wide.groupBy("cluster").agg(F.array(*[total(f"s{i}") for i in range(size)]).alias("sums"), total("n").alias("n"), total("inertia").alias("inertia"), total("checked").alias("checked")).collect()


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3) -> tuple[DataFrame, np.ndarray, dict]:
    """Lloyd's rounds in integers over (id, v) rows: (rows of id, cluster, distance; final centroids; figures).

    The first centroids are the k rows with the smallest sha256 of `1:<id>`, of equal ones the smaller id (null first),
    then the smaller vector; fewer rows than k give fewer centroids. A round assigns every row to its nearest centroid
    (the smaller number of equals) and replaces each non-empty cluster's centroid by floor(sum / count) of each component.
    Null ids hash as `1:`; repeated rows count as often as they come. No rows: no rows, and no centroids. The figures are
    the pairs of row and centroid that were compared exactly, of all pairs, in the rounds.
    """
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    vectors = stored(vectors, "vectors")
    start = vectors.orderBy(order, F.col("id").asc_nulls_first(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in start], dtype=np.int64)
    # a bounded sample only chooses the pivots: any choice gives the same clusters
    sample = np.array([r["v"] for r in vectors.orderBy(F.xxhash64("v"), "v").limit(PIVOT_SAMPLE).collect()], dtype=np.int64)
    pivots, pairs = choose_pivots(sample)
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, {"checked": 0, "pairs": 0}
    cached = stored(vectors.mapInArrow(_with_distances(pivots), _CACHED), "pivot-distances")
    checked = total = 0
    for _ in range(rounds):
        sums = cluster_sums(cached, centroids, pivots, pairs)
        centroids = centroids.copy()
        for r in sums:
            centroids[r["cluster"]] = [int(s) // int(r["n"]) for s in r["sums"]]
            checked += int(r["checked"])
            total += int(r["n"]) * len(centroids)
    out = cached.mapInArrow(_assign(centroids, pivots, pairs), "id long, cluster int, distance long")
    return out, centroids, {"checked": checked, "pairs": total}


def clustered_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of each row with a whole vector of 64 finite components.

    See integer_vectors and cluster for what rows stay and how ties, nulls and repeated rows count. Without such rows the
    result is empty. Inertias beyond a long raise an error. Other columns of rows are not read.
    """
    out, centroids, _ = cluster(integer_vectors(rows, id_col, vec_col), k, rounds)
    out = stored(out, "clusters")
    spark = rows.sparkSession
    # at most k rows, as many as there are centroids
    each = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("n")).collect()
    inertia = sum(r["n"] for r in each)
    if inertia >= 1 << 63:
        raise OverflowError("the inertia does not fit a long")
    of = spark.createDataFrame([(r["cluster"], r["n"], inertia, centroids[r["cluster"]].tolist()) for r in each], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(of), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


#: The contract's clustering in SQL: integers as they are, all distances.
CENTROIDS_SQL = """
with kept as (
  select vec_id, [cast(floor(x::double * 64) as bigint) for x in embedding] as v from embeddings
  where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(x)]) = 64
),
c0 as (select row_number() over (order by sha256('1:' || vec_id), vec_id) - 1 as cluster, v from kept qualify cluster < 16),
""" + "".join(
    f"""
d{r} as (select k.vec_id, k.v, c.cluster, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(k.v, c.v)])::bigint as distance from kept k, c{r} c),
a{r} as (select * from d{r} qualify row_number() over (partition by vec_id order by distance, cluster) = 1),
"""
    + (
        f"""
m{r} as (select cluster, i, ((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m from (select cluster, v, unnest(range(1, 65)) as i from a{r}) group by cluster, i),
c{r + 1} as (select c.cluster, coalesce(n.v, c.v) as v from c{r} c left join (select cluster, list(m order by i) as v from m{r} group by cluster) n using (cluster)),
"""
        if r < 3
        else ""
    )
    for r in range(4)
) + """
s as (select cluster, sum(distance)::bigint as cluster_inertia from a3 group by cluster)
select a.vec_id, a.cluster, a.distance, s.cluster_inertia, (select sum(distance)::bigint from a3) as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from a3 a join s using (cluster) join c3 c using (cluster)
"""
