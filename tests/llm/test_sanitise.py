"""Personal data: base spans against Python's own matcher, added terms against counts by hand."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return True


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return sorted(found)


def written(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("id", "digest", "t", "w", "value", "kind", "start", "end", "spans", "gone", "seen", "share")})


def test_base_spans_against_a_plain_matcher(spark):
    rng = random.Random(3)
    parts = ["4539 1488 0343 6467", "4539148803436468", "+1 (555) 010-9999", "a.b@c.d", "1.2.3.4.5.6.7.8", "0001.255.256.1", "000255.1.1.1", "x@y", "a@b.c@d.e", "a@b.c_x@d.e", "+49.30.1234567", "é😀", "1-2-3", "+1+2", "@", "."]
    rows = [(i, "".join(rng.choice("aB1290.@+- ()%_x😀é,\n") for _ in range(rng.randint(0, 60)))) for i in range(800)]
    rows += [(1000 + i, rng.choice(["", " "]).join(rng.choice(parts) for _ in range(6))) for i in range(800)]
    rows += [(5000, None), (5001, ""), (None, "a@b.c"), (None, None), (3, "a@b.c"), (3, "a@b.c")]
    got = sanitise.span_digests(sanitise.sanitised_spans(frame(spark, rows))).collect()
    shown = Counter((r.id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)

    def want(i, text):
        spans = base(text)
        n = Counter(x[3] for x in spans)
        return (i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(written(spans).encode()).hexdigest())

    assert shown == Counter(want(*r) for r in rows)


def test_long_texts_take_linear_time(spark):
    """Each of these is quadratic, or too deep, for the plain patterns."""
    rows = [(1, "1" * 300_000), (2, "a" * 300_000 + "@" + "b." * 100_000 + "c"), (3, "1 " * 100_000), (4, "+1" * 100_000), (5, "a" * 300_000)]
    got = {r.id: r for r in sanitise.span_digests(sanitise.sanitised_spans(frame(spark, rows))).collect()}
    assert got[2].n_email == 1 and got[2].spans == "email:0:500002" and all(got[i].spans == "" for i in (1, 3, 4, 5))
    assert sanitise.sanitised_spans(frame(spark, rows).where("false")).count() == 0


def plain_terms(texts, reach, support, general):
    """Terms by the definition: sets of texts, each told apart by the words beside a term."""
    word = re.compile(r"[^\W_]+(?:['’_-][^\W_]+)*")
    clean = lambda t: re.sub("|".join(f"(?:{p})" for p in PLAIN.values()), " ", t)
    texts = sorted(set(texts))
    beside = lambda words: [(w, f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}") for i, w in enumerate(words)]
    near, shown, seen, beside_any = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for text in texts:
        local, own, all_words, any_value = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
        for kind in PLAIN:
            spans = [m for m in re.finditer(PLAIN[kind], text)]
            for k, m in enumerate(spans):
                if not passes(kind, m[0]):
                    continue
                lo, hi = spans[k - 1].end() if k else 0, spans[k + 1].start() if k + 1 < len(spans) else len(text)
                value = kind + ":" + (re.sub("[^0-9]", "", m[0]) if kind in ("card", "phone") else m[0].lower())
                sides = [word.findall(clean(x).lower()) for x in (text[max(lo, m.start() - reach) : m.start()], text[m.end() : min(hi, m.end() + reach)])]
                own[value].add(f"{sides[0][-1] if sides[0] else ''} {sides[1][0] if sides[1] else ''}")
                for side in sides:
                    for w, b in beside(side):
                        local[value, w].add(b)
                        any_value[w].add(b)
        for w, b in beside(word.findall(text.lower())):
            all_words[w].add(b)
        for table, part in ((near, local), (shown, own), (seen, all_words), (beside_any, any_value)):
            for k, v in part.items():
                table[k].add(min(v, key=str.encode))
    out = {}
    for (value, w), obs in near.items():
        if len(obs) >= support:
            a = max(len(shown[value]), *(len(o) for (v, _), o in near.items() if v == value))
            n, b = len(texts), max(len(seen[w]), len(beside_any[w]))
            ic = math.log2(n / a)
            share = math.log2(n * len(obs) / (a * b)) / ic if ic else None
            if share is not None and round(share, 9) >= general:
                out[w, value] = (len(obs), b, a, round(share, 6))
    return out


def corpus():
    rng = random.Random(11)
    common = "the of and to in that was with for on are from this which were report meeting plan city river".split()
    filler = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, filler(40)) for i in range(60)]
    # Zorvath and project-9 stand beside one address in several texts; Quill only in copies of one passage
    rows += [(100 + i, f"{filler(20)} {rng.choice(common)} Zorvath {rng.choice(common)} wrote a@b.example for project-9 {filler(15)}") for i in range(6)]
    rows += [(200, f"{filler(10)} nobody knows Zorvath here {filler(5)}"), (201, "Quill said +1 212 555 0153 today"), (202, "Quill said +1 212 555 0153 today")]
    rows += [(203, f"{filler(9)} Quill said +1 212 555 0153 today {filler(9)}")]
    return rows


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_terms_against_counts_by_hand(spark, broadcast_rows):
    rows = corpus()
    got = sanitise.disclosing_terms(frame(spark, rows + rows[-3:]), support=3, broadcast_rows=broadcast_rows).collect()
    got = {(r.t, r.value): (r.joint, r.seen, r.shown, round(r.share, 6)) for r in got}
    assert got == plain_terms([t for _, t in rows], sanitise.REACH, 3, sanitise.GENERAL)
    assert {t for t, _ in got} >= {"zorvath", "project-9"} and "quill" not in {t for t, _ in got}


def test_spans_and_texts(spark):
    rows = corpus()
    df = frame(spark, rows)
    texts = dict(rows)
    spans = {r.id: [(s.kind, texts[r.id][s.start : s.end], s.gone) for s in r.spans] for r in sanitise.sanitised_spans(df).collect()}
    # a term is found where its value isn't
    assert ("term", "Zorvath") in [s[:2] for s in spans[200]] and ("email", "a@b.example", False) in spans[100]
    assert all(spans[i] == [] for i in range(60))
    clean = {r.id: r.text for r in sanitise.sanitise(df).collect()}
    assert all(clean[i] == texts[i] for i in range(60))
    assert "Zorvath" not in clean[200] and "[EMAIL]" in clean[100] and "project-9" not in clean[100] and "[PHONE]" in clean[201]
    # spans of a text never lie across each other, but for base kinds
    for r in sanitise.sanitised_spans(df).collect():
        places = [(s.start, s.end) for s in r.spans]
        assert places == sorted(places)


def test_terms_against_sql(spark):
    """The given tables hold hardly any term that gives a value away, so SQL is also held against made texts that do."""
    import duckdb
    import pandas as pd
    from compare import difference, spark_rows, sql_rows

    rows = corpus() + [(300, None), (301, ""), (100, corpus()[60][1])]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = spark_rows(sanitise.span_digests(sanitise.sanitised_spans(frame(spark, rows))).withColumnRenamed("id", "doc_id"))
    want = sql_rows(con, sanitise.SANITISE_SQL)
    assert difference(got, want) == "" and sum("term:" in str(r) for r in want[1]) >= 7
