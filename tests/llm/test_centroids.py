"""Centroid clustering: exact assignment, bounds that never exceed the distances, and awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids


@pytest.mark.parametrize("scale", [2, 64, 5000, 1 << 26])
def test_nearest_against_all_distances(scale):
    rng = np.random.default_rng(scale)
    for t in range(8):
        c = rng.integers(-scale, scale, (16, 64))
        c = c[rng.integers(0, 16, 16)] if t % 3 == 0 else c  # equal centroids: the smaller number
        x = c[rng.integers(0, 16, 400)] + rng.integers(-1 - scale // 5, 1 + scale // 5, (400, 64)) if t % 2 else rng.integers(-scale, scale, (400, 64))
        pivots, pairs = centroids.choose_pivots(x)
        xp = centroids.pivot_distances(x, pivots)
        of, best, checked = centroids.nearest(x, xp, c, pivots, pairs)
        d = np.stack([centroids.squared(x, y) for y in c], axis=1)
        assert (of == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        assert (centroids.lower_bounds(xp, centroids.pivot_distances(c, pivots), pivots, pairs) <= d).all()
        if t % 2 and scale > 2:
            assert checked < 0.3 * d.size  # vectors near their centroids: most others are passed over unseen


def test_pivots_of_equal_rows():
    pivots, pairs = centroids.choose_pivots(np.ones((5, 64), np.int64))
    assert len(pivots) == 1 and pairs == []
    of, best, _ = centroids.nearest(np.ones((3, 64)), centroids.pivot_distances(np.ones((3, 64), np.int64), pivots), np.zeros((2, 64), np.int64), pivots, pairs)
    assert of.tolist() == [0, 0, 0] and best.tolist() == [64] * 3


def rows(spark, data):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit("x") for c in ("id", "v", "d", "cluster", "centroid", "n", "label")})


def test_awkward_rows(spark):
    one = [0.5] * 64
    data = [(1, one), (2, None), (3, [1.0] * 63), (4, [1.0] * 63 + [None]), (5, [1.0] * 63 + [float("nan")]), (6, [1.0] * 63 + [float("inf")]), (7, [-0.01] * 64), (7, [-0.01] * 64), (None, one), (8, [])]
    got = centroids.clustered_vectors(rows(spark, data)).collect()
    assert sorted((r.id is None, r.id or 0) for r in got) == [(False, 1), (False, 7), (False, 7), (True, 0)]
    # four rows are four centroids, equal ones of which the smaller number takes all
    assert len({r.cluster for r in got}) == 2 and all(r.distance == r.cluster_inertia == r.inertia == 0 for r in got)
    assert {tuple(r.centroid) for r in got} == {(32,) * 64, (-1,) * 64}
    assert centroids.clustered_vectors(rows(spark, data).where("false")).count() == 0
    with pytest.raises(Exception, match="2\\^27"):
        centroids.clustered_vectors(rows(spark, [(1, [1e9] * 64)])).collect()


def test_empty_clusters_keep_their_centroid(spark):
    # sixteen equal starts out of many equal rows: all but the first cluster stay empty
    data = [(i, [1.0] * 64) for i in range(40)]
    out, c, figures = centroids.cluster(centroids.integer_vectors(rows(spark, data)))
    assert {r.cluster for r in out.collect()} == {0} and (c == 64).all() and figures["pairs"] == 3 * 40 * 16
