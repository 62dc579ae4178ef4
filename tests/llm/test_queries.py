"""The registered queries of the subpackage on the smallest tables, against SQL or the plain definition."""

import pytest
from compare import SF, difference, duck, spark_rows, sql_rows

import corpus_pipeline
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert difference(spark_rows(queries.QUERIES[name](spark, SF)), sql_rows(duck(), queries.ORACLES[name])) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op10_passages"}))
def test_one_row_for_each_input(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    key = "page_id" if "page_id" in got else "doc_id"
    want = duck().execute(f"select count(*) from {'pages' if key == 'page_id' else 'documents'}").fetchall()[0][0]
    assert got[key].nunique() == want


def test_passages_name_documents(spark):
    got = queries.QUERIES["op10_passages"](spark, SF).toPandas()
    assert len(got) and (got["kept_doc_id"] <= got["doc_id"]).all() and got.groupby("component_id")["doc_id"].nunique().min() >= 1


def test_pipeline_stages(spark):
    """Each stage against what brute force says about its own input."""
    from tidemark.llm.common import stored
    from tidemark.llm.simhash import fingerprint_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append(docs.toPandas())
    quality, exact, near, mixed = seen[1:]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = set(quality["doc_id"])
    assert all((i in kept) == (q == 1) for i, q in labels.items())
    last = quality.assign(t=quality["text"].str.lower()).groupby("t")["doc_id"].max()
    assert set(exact["doc_id"]) == set(last)
    fps = {i: fingerprint_of(t) & ((1 << 64) - 1) for i, t in zip(exact["doc_id"], exact["text"])}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(near["doc_id"]) == {find(i) for i in ids}
    assert mixed["doc_id"].value_counts().max() <= 3 and set(mixed["doc_id"]) <= set(near["doc_id"])
    size = lambda d: d["text"].str.split().str.len().sum()
    assert 0.95 * size(near) <= size(mixed) <= size(near)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert len(packed) >= len(mixed) and packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, repeated ids, a long text and columns with names that stages use; and no rows."""
    rows = [(1, "good words " * 30), (2, None), (3, ""), (3, "same id"), (None, "no id"), (None, None), (4, "good words " * 30), (4, "good words " * 30), (5, "long " * 50_000), (6, "other good text of words " * 9)]
    df = spark.createDataFrame([(i, t, "en", "s" if i and i % 2 else None) for i, t in rows], "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    df = df.withColumns({c: F.lit("x") for c in ("id", "row", "_score", "_kept_id", "_digest", "_i", "_n", "_copy", "digest")})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (df, df.where("false")):
        kept = {}
        for name, stage in corpus_pipeline.STAGES:
            columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
            kept[name] = docs.count()
            assert name == "packing" or docs.columns == columns
        if kept["quality"]:
            # equal texts: 1, 4, 4; null and empty: 2, 3, null
            assert kept["quality"] == 10 and kept["exact_dedup"] == 6 and 4 <= kept["near_dedup"] <= 6 and kept["packing"] > 0
        else:
            assert set(kept.values()) == {0}
