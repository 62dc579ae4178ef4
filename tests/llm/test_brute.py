"""The quality classifier and the mix of repeated rows against their definitions, written out plainly."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import mixing, pipeline, quality

M = (1 << 64) - 1
A, B, C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def shape(token):
    if re.fullmatch(r"[^\w\s]+", token):
        return token[:4]
    if any(c.isdigit() for c in token):
        return "0" if token.isdigit() else "a0"
    if token.isupper() and len(token) > 1:
        return "AA"
    return "Aa" if token[0].isupper() else "a"


def buckets(text):
    """The bucket of each n-gram of a text, one token after the other, in whole numbers."""
    h = xxhash.xxh64_intdigest
    out, word, shapes = [], [], []
    for token in re.findall(r"\w+|[^\w\s]+", text):
        w, s = h(token.lower().encode()), h(shape(token))
        if word and word[-1] == w:
            s = (s + C) & M
        before = word[-1] if word else C
        s1 = shapes[-1] if shapes else C
        s2 = shapes[-2] if len(shapes) > 1 else C
        word.append(w)
        shapes.append(s)
        out.append(((w * A) & M, ((before * B + w) * A) & M, ((s + B) * A) & M, ((s1 * B + s + A) * A) & M, (((s2 * C + s1) * B + s) * A) & M))
    return [[((k ^ (k >> 31)) * B & M) >> (64 - quality.BITS) for k in kinds] for kinds in out]


def test_buckets_of_one_and_two_tokens():
    texts = ["Hello, hello hello WORLD 42 x9 -- the The", "", "one", "É É é!!! ...... ?"]
    got, lens = quality.ngrams(texts, quality._table())
    ends = np.cumsum(lens)
    for k, text in enumerate(texts):
        want = buckets(text)
        assert lens[k] == len(want)
        assert got[:, ends[k] - lens[k] : ends[k]].T.tolist() == want


def plain_ftrl(rows):
    """The published updates, coordinate by coordinate, in dictionaries."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def features(places):
    x = Counter()
    for i in [i for kinds in places for i in kinds]:
        x[i] += quality.SCALE / len(places)
    x[1 << quality.BITS] = 1.0
    return dict(x)


TEXTS = ["Good text of words, well written.", "BUY NOW!!! $$$ buy buy", "", "A good line and another good line.", "$$$ ### &&& !!!", "words words words words", "Plain, short.", "x" * 2000]
LABELS = [1, 0, 0, 1, 0, 0, 1, 0]


def test_fit_and_scores_against_plain_loops():
    rows = [features(buckets(t)) for t in TEXTS]
    want = plain_ftrl(list(zip(rows, LABELS)))
    got = quality.fit_ftrl(TEXTS, LABELS)["weights"]
    assert set(np.flatnonzero(got).tolist()) == {i for i, w in want.items() if np.float32(w) != 0}
    assert all(abs(got[i] - w) < 1e-5 for i, w in want.items())
    scores = quality.score_texts(TEXTS, got, quality._table())
    for x, s in zip(rows, scores):
        assert s == pytest.approx(1 / (1 + math.exp(-sum(float(got[i]) * v for i, v in x.items()))), abs=1e-5)


def test_quality_of_repeated_rows_long_texts_and_doubled_labels(spark):
    rows = [(i, "Good text of words, well written." if i % 2 else "BUY NOW!!! $$$ buy buy") for i in range(40)]
    rows += [(1, rows[1][1]), (500, "word " * 200_000), (501, None), (502, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    once = [(i, i % 2) for i in range(40)]
    labels = lambda more: spark.createDataFrame(once + more, "doc_id long, quality int")
    base = sorted(map(tuple, quality.quality_scores(df, labels([])).collect()))
    # labels that are repeated count once; null ones, and those of null ids, not at all
    assert sorted(map(tuple, quality.quality_scores(df, labels([(1, 1), (2, 0), (501, None), (None, 1)])).collect())) == base
    assert len(base) == 44 and len({r[2] for r in base if r[0] == 1}) == 1 and len({r[2] for r in base if r[0] in (501, 502)}) == 1
    # an id with two different labels teaches nothing
    none = quality.quality_scores(df.where("doc_id in (1, 2)"), spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1)], "doc_id long, quality int"))
    assert {r.score for r in none.collect()} == {0.5}


def test_mixed_rows_that_repeat_an_id(spark, tmp_path):
    """Rows of one id, with other texts and sources, and rows that are equal in all: the stage takes what the mix of rows
    with ids of their own takes in all, and keeps the budget."""
    rng = np.random.default_rng(2)
    rows = [(int(i % 90) if i % 7 else None, "w " * int(rng.integers(1, 30)), f"s{i % 3}") for i in range(300)]
    rows += [rows[5]] * 4 + [(7, None, None), (7, "", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("_key", "_n", "_i", "_repeated")})
    got = pipeline.mixing_stage(spark, df, str(tmp_path))
    assert got.columns == df.columns
    words = sum(len((t or "").split()) for _, t, _ in rows)
    seen = Counter((r.doc_id, r.text, r.source) for r in got.collect())
    held = Counter(rows)
    taken = sum(len(t.split()) * n for (_, t, _), n in seen.items())
    assert words - 30 <= taken <= words and all(n <= 3 * held[k] for k, n in seen.items()) and set(seen) <= set(held)
    # a table without repeats is mixed as mix says
    one = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    want = {r.id: r.copies for r in mixing.mix(one).collect() if r.copies}
    assert Counter(r.doc_id for r in pipeline.mixing_stage(spark, one, str(tmp_path)).collect()) == want
