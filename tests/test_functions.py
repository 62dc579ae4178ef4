"""Literal values of text, vector and trend functions."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import spans, text, vectors
from tidemark.operators import trends


def one(spark, column, **values):
    row = {k: v for k, v in values.items()} or {"x": 0}
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>' if isinstance(v, list) else 'double'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("Đà Nẵng", "a nang"), ("TP.  HCM", "tp hcm"), (None, ""), ("Hà-Nội!", "hanoi")])
def test_normalize_place(spark, raw, want):
    assert one(spark, text.normalize_place("c"), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("sai gon", ["hồ chí minh", "ho chi minh", "tphcm", "tp hcm", "hcm"]), ("Huế", ["hue"]), ("", []), (None, [])])
def test_place_terms(spark, raw, want):
    assert one(spark, text.place_terms("c"), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Từ 10 - 20 triệu", 10.0), ("từ 15 triệu", 15.0), ("Thỏa thuận", None), (None, None), ("7", 7.0), ("- 5", None)])
def test_salary_min(spark, raw, want):
    assert one(spark, text.salary_min("c"), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("10 - 20 triệu", (10, 20)), ("1000 USD", (None, None)), (None, (None, None))])
def test_salary_range(spark, raw, want):
    assert tuple(one(spark, text.salary_range("c"), c=raw)) == want


@pytest.mark.parametrize(("raw", "want"), [("03/05/2026", "2026-05-03"), ("2026-05-03 10:11:12", "2026-05-03"), ("soon", "2020-01-01"), (None, "2020-01-01")])
def test_parse_date(spark, raw, want):
    assert str(one(spark, text.parse_date("c", "2020-01-01"), c=raw))[:10] == want


@pytest.mark.parametrize(("raw", "want"), [("Senior Java", "senior"), ("Fresher lead", "fresher"), ("", "mid"), (None, "mid")])
def test_job_level(spark, raw, want):
    assert one(spark, text.job_level("c"), c=raw) == want


def test_category_follows_the_order_of_groups(spark):
    assert one(spark, text.tech_category("c"), c="React Native") == "Frontend"
    assert one(spark, text.tech_category("c"), c="xyz") == "Other"


def test_sentiment(spark):
    assert one(spark, text.sentiment("c"), c="Doanh thu tăng, hiệu quả nhưng rủi ro") == pytest.approx(1 / 3)
    assert one(spark, text.sentiment("c"), c=None) == 0.0


@pytest.mark.parametrize(("raw", "want"), [("06_05_2026_GenK", "GenK"), ("DanTri", "Dân Trí"), (None, "Unknown"), ("other", "other")])
def test_source_name(spark, raw, want):
    assert one(spark, text.source_name("c"), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("▁Open  AI.", "Open AI"), ("x", ""), ("Apple Store", "Apple"), (None, "")])
def test_clean_entity(spark, raw, want):
    assert one(spark, text.clean_entity("c"), c=raw) == want


def test_title_for_classifier(spark):
    assert one(spark, text.title_for_classifier("c"), c="Tăng 12,5% vào 3/5/2026: 7 lý do!") == "tăng percent vào date number lý do"


def test_array_literal(spark):
    assert one(spark, text.array_literal("c"), c='["a","b c"]') == ["a", "b c"]
    assert one(spark, text.array_literal("c"), c='{a,"b"}') == ["a", "b"]
    assert one(spark, text.array_literal("c"), c=None) == []


def test_label_value(spark):
    assert one(spark, text.label_value("c", "Lương", ["Hạn", "Nơi"]), c="Nơi: Huế Lương: 10 triệu Hạn: mai") == "10 triệu"


def test_phrases_keep_the_first_of_each(spark):
    assert one(spark, spans.phrases("c", ["react", "react native", "go"]), c="React Native, go and REACT native; gopher") == ["React Native", "go"]


def test_spans_drop_overlaps(spark):
    got = one(spark, spans.spans("c", "DATE", spans.DATES), c="ngày 3 tháng 5 năm 2026 và 30/4")
    assert [e["entity"] for e in got] == ["ngày 3 tháng 5 năm 2026", "30/4"]
    assert one(spark, spans.spans("c", "DATE", spans.DATES), c=None) == []


def test_token_windows(spark):
    words = " ".join(map(str, range(10)))
    assert one(spark, spans.token_windows("c", 4, 1), c=words) == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    assert one(spark, spans.token_windows("c", 4, 1), c="") == []


def test_vectors(spark):
    assert one(spark, vectors.cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vectors.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0
    assert one(spark, vectors.unit("a"), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, vectors.euclidean("a", "b"), a=[0.0, 3.0], b=[4.0, 0.0]) == 5.0


def test_months():
    assert str(trends.month_start("2026-03-31", 1)) == "2026-02-01"
    with pytest.raises(ValueError):
        trends.checked_months(5)


def test_first_match_takes_the_first_group(spark):
    assert one(spark, trends.first_match(F.col("c"), trends.INDUSTRIES, trends.OTHER), c="Email developer") == "AI & Data"


PAY_TEXTS = [
    ("20 - 30 triệu VNĐ", ["20 - 30 triệu VNĐ"]), ("15,5 triệu", ["15,5 triệu"]), ("upto 30M", ["upto 30M"]), ("up to $2000 USD", ["up to $2000 USD"]), ("từ 20 đến 30 triệu", ["30 triệu"]),
    ("$2,000 - $3,000 USD", ["$2,000 - $3,000 USD"]), ("10.000.000đ", ["10.000.000đ"]), ("500$ / tháng", ["500$ / tháng"]), ("$ 1500 - 2000", ["$ 1500 - 2000"]), ("13 tháng lương/năm", ["13 tháng lương/năm"]),
    ("mức lương 900 USD", ["900 USD"]), ("lương hấp dẫn", ["lương hấp dẫn"]), ("thu nhập cạnh tranh", ["thu nhập cạnh tranh"]), ("salary negotiable", ["salary negotiable"]), ("competitive salary range", ["competitive salary range"]),
    ("nothing here", []),
]


def test_pay_and_dates_in_one_pass(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PAY_TEXTS)] + [(99, None)], "i long, t string")
    got = {r.i: r for r in spans.extract(df, df["t"], ("x",), ("y",), ("z",)).collect()}
    assert [got[i].pay for i in range(len(PAY_TEXTS))] == [want for _, want in PAY_TEXTS]
    assert not got[99].pay and not got[99].dates


def test_spans_that_overlap_go_by_the_pattern():
    import re

    patterns = [re.compile(p) for p in ("bc", "abcd|x", "d")]
    assert spans.ordered_spans("abcd x bc d", patterns, False) == ["bc", "bc", "x", "d", "d"]


SAMPLES = (
    "ngày 3 tháng 5 năm 2026", "tháng 12 năm 2025", "Quý II / 2026", "Quý IV", "Q1 / 2026", "3/5/2026", "5/2026", "May 2026", "năm 2026", "Thứ Hai", "thứ hai tới", "3/5 và 4/5",
    "10 - 20 triệu VNĐ", "15 triệu đồng", "upto 30 triệu", "up to $2000 USD", "từ 10 đến 20 triệu", "$1,000 - $2,000 USD", "10.000.000 đồng", "500 $ / tháng", "$ 500 - $ 900", "13 tháng lương",
    "lương 20 triệu", "thu nhập 20 nghìn", "lương cạnh tranh", "thu nhập cạnh tranh", "thu nhập theo năng lực", "salary negotiable", "competitive salary range",
)


def test_dates_and_pay_are_those_of_the_patterns(spark):
    """Every pattern with each kind of space that Python's matcher knows, in either case, and with digits of other scripts."""
    import re

    from tidemark.functions import spans

    texts = []
    for s in SAMPLES:
        for space in " \t\n  　\u0085\u001c ":
            texts += [s.replace(" ", space), s.upper().replace(" ", space)]
        texts += ["".join(chr(0x0660 + int(c)) if c.isdigit() else c for c in s), f"x {s}, {s}."]
    texts += ["", None, "nothing here", "thu", "quy"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.x.dates if r.x else [], r.x.pay if r.x else []) for r in df.select("i", spans.dates_and_pay(F.col("t")).alias("x")).collect()}
    dates, pay = ([re.compile(p, re.IGNORECASE) for p in ps] for ps in (spans.DATES, spans.PAY))
    hit = [set(), set()]
    for i, t in enumerate(texts):
        want = (spans.ordered_spans(t or "", dates, False), spans.ordered_spans(t or "", pay, True))
        assert tuple(map(list, (got[i][0] or [], got[i][1] or []))) == tuple(want), repr(t)
        for k, ps in enumerate((dates, pay)):
            hit[k] |= {p.pattern for p in ps if p.search(t or "")}
    assert len(hit[0]) == len(spans.DATES) and len(hit[1]) == len(spans.PAY)
