"""Feature matrices, scaling, reduction, clustering fits and trials on MLlib and plain aggregations."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import unit
from tidemark.operators.vectors import clustering_metrics, dbscan
from tidemark.sources.batches import read_batches, write_batch, written_batches
from tidemark.sources.shared import stored


def feature_matrix(ids: DataFrame, blocks: Mapping[str, DataFrame]) -> DataFrame:
    """ids with the columns of each block (id, ...); rows that a block lacks are 0."""
    out = ids
    for b in blocks.values():
        out = out.join(b, "id", "left")
    return out.na.fill(0.0)


#: Rows up to which quartiles are exact, and the share of ranks by which those of more rows may be off.
EXACT_ROWS, RANKS = 1_000_000, 100_000


def scaled(df: DataFrame, key: str, weights: Mapping[str, float], method: str = "standard", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Columns scaled by standard (population deviation), minmax or robust (median and quartiles, between values where a rank
    falls there) and weighted; a column without spread, NaN and null are 0. The statistics are one row. Beyond exact_rows
    rows robust takes quartiles from a mergeable sketch of bounded size, off by 1 / 100,000 of the ranks at most."""
    if method == "robust":
        exact = df.limit(exact_rows + 1).count() <= exact_rows
        quartile = lambda x, q: F.percentile(x, q) if exact else F.percentile_approx(x, q, RANKS)
    stats = []
    for c in weights:
        x = F.when(~F.isnan(c), F.col(c))
        if method == "robust":
            a, b = quartile(x, 0.5), quartile(x, 0.75) - quartile(x, 0.25)
        else:
            a, b = {"standard": (F.avg(c), F.stddev_pop(c)), "minmax": (F.min(c), F.max(c) - F.min(c))}[method]
        stats += [a.alias(f"_a{c}"), b.alias(f"_b{c}")]
    one = df.agg(*stats)
    def col(c, w):
        v = (F.col(c) - F.col(f"_a{c}")) / F.col(f"_b{c}") * w
        return F.round(F.coalesce(F.nanvl(F.when(F.col(f"_b{c}") > 0, v), F.lit(0.0)), F.lit(0.0)), 6).alias(c)

    return df.join(one).select(key, *[col(c, w) for c, w in weights.items()])


def one_hot(df: DataFrame, key: str, community: str, k: int) -> DataFrame:
    """(key, c0 .. ck-1): membership in the k largest communities; of equally large ones the least name first."""
    top = df.groupBy(community).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), community).limit(k)
    top = top.selectExpr(f"{community} as _c", f"row_number() over (order by n desc, {community}) - 1 as _r")  # k rows
    j = df.join(top, df[community] == F.col("_c"), "left")
    return j.select(key, *[F.coalesce((F.col("_r") == i).cast("double"), F.lit(0.0)).alias(f"c{i}") for i in range(k)])


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col("vec")))


def principal(rows: DataFrame, k: int) -> DataFrame:
    """(id, reduced): centred rows on their first k principal axes."""
    from pyspark.ml.feature import PCA, StandardScaler

    x = _vectors(rows)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(x).transform(x)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred)
    return model.transform(centred).select("id", vector_to_array("pc").alias("reduced"))


def kmeans(rows: DataFrame, k: int, seed: int = 42, restarts: int = 1) -> DataFrame:
    """(id, vec, cluster_id) of the cheapest of several runs."""
    from pyspark.ml.clustering import KMeans

    x = _vectors(rows.drop("cluster_id"))
    models = [KMeans(k=k, seed=seed + i, initMode="k-means||").fit(x) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(x).select("id", "vec", F.col("prediction").cast("long").alias("cluster_id"))


TRIALS = "place long, algorithm string, params string, error string, clusters long, noise_ratio double, davies_bouldin double, calinski_harabasz double, silhouette double, valid boolean"
_METRICS = ("clusters", "noise_ratio", "davies_bouldin", "calinski_harabasz", "silhouette")


def _fit(rows: DataFrame, algorithm: str, params: Mapping) -> DataFrame:
    """(id, vec, cluster_id) of one algorithm with its parameters."""
    if algorithm == "kmeans":
        if not 0 < params["k"]:
            raise ValueError(f"k-means needs clusters, not {params['k']}")
        return kmeans(rows, **params)
    if algorithm == "dbscan":
        if not params["eps"] > 0:
            raise ValueError(f"DBSCAN needs a positive eps, not {params['eps']}")
        return rows.select("id", "vec").join(dbscan(rows, **params), "id")
    raise ValueError(f"no algorithm {algorithm}")


def run_trials(rows: DataFrame, trials: Sequence[tuple[str, Mapping]], folder: str, least: int, most: int, noise: float = 0.6) -> DataFrame:
    """The table of trials (algorithm, parameters) over rows (id, vec): metrics, and whether each keeps the bounds on
    clusters and noise. A trial is a Spark fit of its own; one that fails is a row with its reason and no metrics.

    Each finished trial is a batch of the table in `folder`; a search that is started again there skips what is finished.
    Trials are told apart by their place, so a search goes on with the same list.
    """
    spark = rows.sparkSession
    done = set(written_batches(spark, folder))
    for place, (algorithm, params) in enumerate(trials):
        if place in done:
            continue
        error, found = None, None
        try:
            found = clustering_metrics(stored(_fit(rows, algorithm, params), "trial")).first().asDict()
        except Exception as e:  # noqa: BLE001  the other trials go on
            error = f"{type(e).__name__}: {e}".splitlines()[0][:300]
        ok = found is not None and least <= found["clusters"] <= most and (found["noise_ratio"] or 0.0) <= noise
        row = (place, algorithm, json.dumps(params, sort_keys=True), error, *[found[m] if found else None for m in _METRICS], ok)
        write_batch({"trials": spark.createDataFrame([row], TRIALS)}, folder, place)
    return read_batches(spark, folder, "trials", TRIALS).drop("batch")


#: Whether more is better.
DIRECTION = {"silhouette": True, "calinski_harabasz": True, "davies_bouldin": False}


def best_trial(trials: DataFrame, metric: str) -> DataFrame:
    """The best trial of those within bounds by the metric, then less noise, more clusters, the earlier place."""
    first = F.desc(metric) if DIRECTION[metric] else F.asc(metric)
    return trials.where("valid").orderBy(first, "noise_ratio", F.desc("clusters"), "place").limit(1)


def name_vectors(names: DataFrame, dim: int) -> DataFrame:
    """(id, vec): hashed counts of the three-letter parts of a name, of length 1; an empty name is all zeros."""
    s = F.concat(F.lit("^"), F.lower(F.coalesce("name", F.lit(""))), F.lit("$"))
    gram = F.explode(F.sequence(F.lit(1), F.greatest(F.length("s") - 2, F.lit(1)))).alias("i")
    parts = names.select("id", s.alias("s")).select("id", "s", gram).select("id", (F.length("s") > 2).alias("any"), F.pmod(F.xxhash64(F.substring("s", F.col("i"), F.lit(3))), F.lit(dim)).alias("b"))
    sums = parts.groupBy("id").agg(*[F.count(F.when((F.col("b") == d) & F.col("any"), 1)).cast("double").alias(f"v{d}") for d in range(dim)])
    return sums.select("id", unit(F.array(*[f"v{d}" for d in range(dim)])).alias("vec"))


def with_missing_vectors(rows: DataFrame, have: DataFrame, dim: int) -> DataFrame:
    """(id, vec, made): the vectors that there are, and name vectors for the other rows."""
    old = rows.join(have, "id").select("id", "vec", F.lit(False).alias("made"))
    new = name_vectors(rows.join(have, "id", "left_anti"), dim).withColumn("made", F.lit(True))
    return old.unionByName(new)


def relevance(train: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, is_relevant, confidence) of titles by logistic regression over hashed words; a blank title is not relevant."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    steps = [RegexTokenizer(inputCol="title", outputCol="words", pattern=r"\s+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=4096), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=20, regParam=0.01)]
    clean = F.coalesce("title", F.lit(""))
    model = Pipeline(stages=steps).fit(train.withColumn("title", clean))
    p = vector_to_array("probability")[1]
    out = model.transform(rows.drop("label").withColumn("title", clean))
    blank = F.trim("title") == ""
    return out.select(key, F.when(blank, False).otherwise(p >= 0.5).alias("is_relevant"), F.when(blank, 0.0).otherwise(F.greatest(p, 1 - p)).alias("confidence"))
