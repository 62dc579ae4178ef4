"""Periodic runs against every period tried at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, runs


def slow_lyndon(s):
    return [next((j - i for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s) - i) for i in range(len(s))]


def slow_runs(s, least, times):
    out = []
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            n = j + p - i
            if j > i and n >= max(least, times * p) and not any(a <= i and i + n <= a + m and p % q == 0 for a, m, q in out):
                out.append((i, n, p))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_against_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        n, k = rng.randint(0, 40), rng.randint(1, 4)
        s = [rng.randint(0, k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randint(0, n - 1)
            p = rng.randint(1, max(1, (n - a) // 3))
            s = s[:a] + [s[a + (i - a) % p] for i in range(a, n)]
        assert runs.lyndon_array(s) == slow_lyndon(s)
        for least, times in ((6, 4), (2, 2), (4, 3)):
            want = slow_runs(s, least, times)
            assert runs.runs_of(np.array(s, dtype=np.int64), least, times) == want
            # the cut into stretches loses and shortens none, whatever stands beside the text in its slice
            both = runs._slice([b" ".join(b"%d" % x for x in s), b"0 0 0", b" ".join(b"%d" % x for x in s)], least, times)[1]
            assert both[0] == both[2] == want


def test_long_texts_of_one_word_and_of_none_alike():
    assert runs.runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert runs.runs_of(np.arange(100_000)) == []


def test_awkward_rows(spark):
    rows = [(1, "a " * 10), (2, None), (3, ""), (4, " \t\n"), (1, "a " * 10), (None, "x y x y x y x y z"), (5, "w " * 200_000), (6, "A a A a A a A a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "words", "runs", "h", "a", "p", "n")})
    got = [(r.id, r.words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == [
        (1, 10, [(0, 10, 1)], "a"), (1, 10, [(0, 10, 1)], "a"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""),
        (5, 200_000, [(0, 200_000, 1)], "w"), (6, 8, [(0, 8, 2)], "A a"), (None, 9, [(0, 8, 2)], "x y z"),
    ]
    assert runs.periodic_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(df, min_exponent=1)


def expected(doc_id, text):
    """The contract, word by word."""
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = slow_runs(words, 6, 4)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = best[1] * 1000 // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_the_contract(spark, tmp_path):
    """Made texts of up to 120 words (the slow definition is quadratic), with loops by the contract's rule and others."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        words = [rng.choice("the of and a to in it is".split()) for _ in range(rng.randint(0, 120))]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(words) if i % 17 else None))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    want = {r[0]: expected(*r) for r in rows}
    assert len(got) == len(want) and all(tuple(r) == want[r.doc_id] for r in got) and sum(r.n_runs for r in got) > 10
