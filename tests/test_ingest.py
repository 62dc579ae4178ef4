"""Model scoring over windows, the graph writer, delivery and imported posts: failures, restarts, order and awkward rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import importing, scoring
from tidemark.sources import batches
from tidemark.streaming import delivery, graph_writer

# Model scoring


def shout_model(words):
    """Words in capitals are one span a stretch; a window with `boom` can't be scored."""
    if "boom" in words:
        raise RuntimeError("no")
    out, begin = [], None
    for i, w in enumerate([*words, ""]):
        if w.isupper() and w.isalpha():
            begin = i if begin is None else begin
        elif begin is not None:
            out.append((begin, i, "shout", 0.913))
            begin = None
    return out


def test_windows_give_what_whole_texts_give(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["a", "b", "ONE", "TWO"]) for _ in range(rng.randint(0, 90))) for i in range(120)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").withColumns({c: F.lit("x") for c in ("chunk", "start", "label", "words", "entity")})
    # stretches are shorter than the overlap, so each lies whole in some window
    longest = max(e - b for t in texts.values() for b, e, *_ in shout_model(t.split()))
    got = scoring.merged_entities(scoring.scored_windows(scoring.word_windows(df, "id", "text", 40, shared := max(longest + 1, 12)), lambda: shout_model, "shout", shared))
    got = sorted((r.id, r.start, " ".join(r.words), r.label, r.score) for r in got.collect())
    want = sorted((i, b, " ".join(t.split()[b:e]), "SHOUT", 0.91) for i, t in texts.items() for b, e, *_ in shout_model(t.split()))
    assert got == want and len(want) > 100


def test_long_runs_are_put_together_again(spark):
    df = spark.createDataFrame([(1, "x " + "ONE TWO " * 150 + "y")], "id long, text string")
    got = scoring.merged_entities(scoring.scored_windows(scoring.word_windows(df, "id", "text", 40, 10), lambda: shout_model, "shout", 10)).collect()
    assert [(r.start, r.words) for r in got] == [(1, ["ONE", "TWO"] * 150)]


def test_a_window_that_fails_costs_only_itself(spark):
    rows = [(1, "HELLO there " + "w " * 60 + "boom " + "w " * 60 + "hello HELLO Bye BYE"), (2, "boom"), (3, None), (4, "  \n"), (5, "plain"), (None, "A"), (6, "HELLO x HELLO")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: ([(e.label, e.entity, e.start) for e in r.entities], r.chunks, r.failed) for r in scoring.model_entities(df, lambda: shout_model, "shout", size=30, overlap=5).collect()}
    assert got[1] == ([("SHOUT", "HELLO", 0), ("SHOUT", "BYE", 126)], 5, 1)
    assert got[2] == ([], 1, 1) and got[3] == got[4] == ([], 0, 0) and got[5] == ([], 1, 0)
    assert got[6] == ([("SHOUT", "HELLO", 0)], 1, 0) and set(got) == {1, 2, 3, 4, 5, 6, None}
    assert scoring.model_entities(df.where("false"), lambda: shout_model, "shout").count() == 0


def test_a_model_that_cannot_be_loaded_fails_the_job(spark):
    def broken():
        raise OSError("no weights")

    with pytest.raises(Exception, match="no weights"):
        scoring.scored_windows(scoring.word_windows(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text"), broken, "broken").collect()


def test_bad_spans_are_dropped(spark):
    odd = lambda words: [(0, 1, "", 1.0), (0, 1, "X", None), (1, 0, "X", 1.0), (0, 9, "X", 1.0), (0, 1, "ok", 0.5)]
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    [r] = scoring.scored_windows(scoring.word_windows(df, "id", "text"), lambda: odd, "odd").collect()
    assert [(s.label, s.words) for s in r.spans] == [("OK", ["a"])]


def test_tagger(spark):
    df = spark.createDataFrame([("un deux trois un", "fr"), ("one two one", "en"), (None, "en"), ("one", None), ("deux", "en")], "text string, lang string")
    table = scoring.fit_tagger(df, "text", "lang")
    assert scoring.RunTagger(table, known=1)(["Un", "deux", "one", "xyzzy", "two"]) == [(0, 1, "fr", 1.0), (1, 3, "en", 1.0), (4, 5, "en", 1.0)]


# The graph writer


def article(i, at, techs=("Go",), orgs=("FPT Corp",), places=("Hue",)):
    data = {"title": f"t{i}-{at}", "content": "c", "source_url": f"u{i}", "publish_date": "1/2/2026", "entities": {"TECH": list(techs), "ORG": list(orgs), "LOC": list(places)}}
    return json.dumps({"message_type": "extracted_article", "source_platform": "s", "extracted_at": f"2026-01-01T00:00:{at:02d}Z", "data": data})


def job(i, at, company="FPT Corp", location=None, techs=("go", "Rust,"), skills=("Teamwork",)):
    data = {"job": {"title": f"j{i}", "salary": "10", "source_url": f"o{i}"}, "company": {"name": company, "location": location}, "skills": list(skills), "technologies": list(techs)}
    return json.dumps({"message_type": "extracted_job", "source_platform": "s", "extracted_at": f"2026-01-01T00:00:{at:02d}Z", "data": data})


MESSAGES = [article(1, 1), job(1, 5, location="Hanoi"), article(1, 9), job(2, 3, location="Hue"), article(2, 2, (), ("", "fpt corp"), ()), "{broken", '{"message_type": "raw"}', job(1, 5, location="Hanoi")]


def message_stream(spark, folder, messages):
    """A file a message, so that a file a batch is a message a batch."""
    for i, m in enumerate(messages):
        spark.createDataFrame([(m,)], "value string").coalesce(1).write.parquet(f"{folder}/m{i}")
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true").parquet(folder)


def shown(t):
    return {k: sorted(tuple(map(str, r)) for r in df.collect()) for k, df in t.items()}


def test_graph_writer_dies_between_two_tables(spark, tmp_path):
    root = f"file://{tmp_path}"
    calls = []

    def dies(name, batch):
        calls.append((batch, name))
        if batch == 1 and name == "companies" and calls.count((1, "companies")) == 1:
            raise RuntimeError("died")

    stream = message_stream(spark, f"{root}/in", MESSAGES)
    with pytest.raises(Exception, match="died"):
        graph_writer.write_graph(stream, f"{root}/out", f"{root}/check", dies)
    # the second batch has written two tables: readers see none of it
    assert batches.written_batches(spark, f"{root}/out") == [0] and (tmp_path / "out/posts/batch=1").exists()
    before = shown(graph_writer.read_graph(spark, f"{root}/out"))
    graph_writer.write_graph(stream, f"{root}/out", f"{root}/check", dies)
    after = shown(graph_writer.read_graph(spark, f"{root}/out"))
    assert batches.written_batches(spark, f"{root}/out") == [0, 1, 2] and before != after
    # as all messages in one batch would give
    whole = spark.createDataFrame([(m,) for m in MESSAGES], "value string")
    batches.write_batch(graph_writer.batch_tables(graph_writer.messages(whole)), f"{root}/one", 0)
    assert shown(graph_writer.read_graph(spark, f"{root}/one")) == after


def test_graph_writer_values(spark, tmp_path):
    tables = []
    for k, order in enumerate((MESSAGES, MESSAGES[::-1])):
        for b, m in enumerate(order):
            batches.write_batch(graph_writer.batch_tables(graph_writer.messages(spark.createDataFrame([(m,)], "value string"))), f"file://{tmp_path}/{k}", b)
        tables.append(graph_writer.read_graph(spark, f"file://{tmp_path}/{k}"))
    assert shown(tables[0]) == shown(tables[1])
    t = tables[0]
    assert {(r.label, r.url, r["name"]) for r in t["posts"].collect()} == {("Article", "u1", "t1-9"), ("Article", "u2", "t2-2"), ("Job", "o1", "j1"), ("Job", "o2", "j2")}
    # GO of one article and two jobs; the job that came twice counts once
    assert {tuple(r) for r in t["technologies"].collect()} == {("GO", 3), ("RUST", 2)}
    [c] = t["companies"].collect()
    assert (c.id, c["name"], c.location) == ("fpt-corp", "FPT Corp", "Hanoi")
    kinds = {(r.type, r.dst_label) for r in t["edges"].collect()}
    assert kinds == {("MENTIONS", "Technology"), ("MENTIONS", "Company"), ("MENTIONS", "Location"), ("REQUIRES", "Technology"), ("REQUIRES", "Skill"), ("POSTED_BY", "Company")}
    assert shown(graph_writer.read_graph(spark, f"file://{tmp_path}/none"))["edges"] == []


# Delivery


def topic(spark, path, offsets, tag=""):
    for o in offsets:
        df = spark.createDataFrame([(o,)], "o long")
        delivery.as_kafka_rows(df, "t", F.col("o") % 2, F.col("o"), F.lit("k"), F.concat(F.lit("v"), "o", F.lit(tag))).coalesce(1).write.mode("append").parquet(path)


def offsets_of(rows):
    return sorted(r.offset for r in rows.collect())


@pytest.mark.parametrize("after_rows", [True, False])
def test_stop_and_resume_counts_nothing_twice(spark, tmp_path, after_rows):
    path, group = f"file://{tmp_path}/t", f"file://{tmp_path}/g"
    topic(spark, path, range(6))
    start = delivery.begin(spark.read.schema(delivery.KAFKA).parquet(path), group, "earliest")
    seen = []

    def stops(rows, batch):
        seen.append((batch, tuple(offsets_of(rows))))
        if len(seen) == 2:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        delivery.consume(delivery.topic_files(spark, path, 2), group, start, stops)
    first = offsets_of(delivery.delivered(spark, group))
    assert len(first) == 2  # the batch in which it stopped is not there yet
    topic(spark, path, range(6, 9))
    topic(spark, path, [3])  # sent again by its producer
    delivery.consume(delivery.topic_files(spark, path, 2), group, start, stops)
    assert seen[1] == seen[2]  # at least once: the same batch came again
    got = delivery.delivered(spark, group)
    assert offsets_of(got) == list(range(9)) and {r.value for r in got.collect()} == {f"v{o}" for o in range(9)}
    assert {(r.partition, r["last"]) for r in delivery.committed(spark, group).collect()} == {(0, 8), (1, 7)}
    delivery.consume(delivery.topic_files(spark, path, 2), group, start, stops)
    assert offsets_of(delivery.delivered(spark, group)) == list(range(9))


def test_earliest_and_latest(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    topic(spark, path, range(4))
    rows = lambda: spark.read.schema(delivery.KAFKA).parquet(path)
    groups = {s: f"file://{tmp_path}/{s}" for s in ("earliest", "latest")}
    for s, g in groups.items():
        delivery.begin(rows(), g, s)
    topic(spark, path, [4, 5])
    for s, want in (("earliest", [0, 1, 2, 3, 4, 5]), ("latest", [4, 5])):
        # where a group began stays, whatever the topic holds when it is asked again
        delivery.consume(delivery.topic_files(spark, path), groups[s], delivery.begin(rows(), groups[s], s))
        assert offsets_of(delivery.delivered(spark, groups[s])) == want
    assert delivery.delivered(spark, f"file://{tmp_path}/other").count() == 0
    with pytest.raises(ValueError):
        delivery.begin(rows(), f"file://{tmp_path}/x", "newest")


# Imported posts


def files(spark, *named):
    return spark.createDataFrame([(n, json.dumps(x) if not isinstance(x, str) else x) for n, x in named], "file string, value string")


def test_articles_and_jobs(spark):
    news = {"source_platform": "VN-EP", "post_detail": [None, {"content": "no title"}, {"title": "T", "description": "d", "created_at": "11/04/2026 08:30:00", "entities": {
        "TECH": ["Cloud", "React"], "SKILL/TECH": ["React", "Python"], "ORG": ["FPT", "ab", "Bad", "Viettel"], "JOB_ROLE": ["Senior Dev", "senior dev"], "PER": ["Eva", "Nam Le"]}}]}
    later = {"source_platform": "GenK", "post_detail": [{"title": "T", "content": "c", "created_at": "odd", "entities": {"ORG": ["fpt"], "LOC": ["Hue", "Hanoi"], "TECH": ["Python"]}}, {"title": "U", "entities": {"ORG": ["FPT"], "LOC": ["Da Nang"]}}]}
    jobs = {"post_detail": [{"job": {"title": "SENIOR DEV", "salary": "1"}, "company": {"name": "Viettel", "location": "Hanoi"}, "skills": ["Go", "Go", ""], "technologies": ["Go"]}, {"job": {"title": "QA", "due_date": "2026-04-10"}, "company": {"name": ""}}, {"job": {}}]}
    want = None
    for order in (0, 1):
        named = [("1", news), ("2", later), ("3", jobs), ("4", "{broken"), ("5", "[]")]
        t = importing.import_posts(files(spark, *(named[::-1] if order else named)).repartition(3), "2020-01-01", ("Bad",), ("Eva",))
        got = {k: sorted(tuple(map(str, r)) for r in df.collect()) for k, df in t.items()}
        assert want is None or got == want
        want = got
    assert [(r[2], r[3], r[4], r[5][:10]) for r in want["articles"]] == [("T", "d", "VNExpress", "2026-04-11"), ("T", "c", "GenK", "2020-01-01"), ("U", "", "GenK", "2020-01-01")]
    assert {r[0]: r[2] for r in want["technologies"]} == {"Cloud": "VN-EP", "React": "VN-EP", "Python": "VN-EP", "Go": "3"}
    assert {r[0]: r[1] for r in want["skills"]} == {"React": "Frontend", "Python": "Backend", "Go": "General"} or {r[0] for r in want["skills"]} == {"React", "Python", "Go"}
    # the first spelling, and the first place that is known
    assert {(r[1], r[4]) for r in want["companies"]} == {("FPT", "Hue"), ("Viettel", "Hanoi")}
    assert {(r[1], r[2]) for r in want["roles"]} == {("Senior Dev", "senior"), ("QA", "mid")}
    assert want["people"] == [("Nam Le",)]
    # of several companies under a title the last one of the last post
    assert want["article_company"] == [("T", "fpt"), ("U", "FPT")] and want["job_company"] == [("SENIOR DEV", "Viettel")]
    assert want["job_skills"] == [("SENIOR DEV", "Go", "2")] and want["job_technologies"] == [("SENIOR DEV", "Go", "1")]
    none = importing.import_posts(files(spark, ("x", "{")), "2020-01-01")
    assert all(df.count() == 0 for df in none.values())


# Questions


def test_questions_by_dictionary_intent_and_model(spark):
    from tidemark.operators import questions

    def model(words):
        if "boom" in words:
            raise RuntimeError("no")
        return [(i, i + 1, "ORG" if w[0] == "@" else "LOC", 1.0) for i, w in enumerate(words) if w[0] in "@~"]

    rows = [(1, "Python and PYTHON jobs at FPT @FPT @fpt @Viettel ~Hue"), (2, "web work ~Hanoi"), (3, "boom Java at FPT"), (4, None), (5, " ")]
    df = spark.createDataFrame(rows, "id long, text string").withColumns({c: F.lit("x") for c in ("t", "c", "entities")})
    out = questions.question_entities(df, ("python", "java"), ("engineer",), ("FPT", "@FPT"), {"web": ("React", "Vue", "react")}, {"web|java": ("Developer",)}, lambda: model, "names")
    got = {r.id: tuple(r)[1:] for r in out.collect()}
    assert got[1] == (["Python"], [], ["FPT", "@FPT", "@Viettel"], ["~Hue"])
    assert got[2] == (["React", "Vue"], ["Developer"], [], ["~Hanoi"])
    assert got[3] == (["Java"], ["Developer"], ["FPT"], []) and got[4] == got[5] == ([], [], [], [])


def test_projection_and_wrote(spark):
    from tidemark.operators import graph

    e = spark.createDataFrame([("USES", "C", "1", "T", "1"), ("USES", "C", "1", "T", "1"), ("MENTIONS", "A", "1", "Person", "Eva"), ("MENTIONS", "A", "1", "T", "1"), ("USES", "C", None, "T", "2"), ("OTHER", "C", "1", "T", "1")], "type string, src_label string, src string, dst_label string, dst string")
    got = sorted(map(tuple, graph.projected(e, ("A", "C", "T"), ("USES", "MENTIONS")).collect()))
    assert got == [("MENTIONS", "A", "1", "T", "1"), ("MENTIONS", "T", "1", "A", "1"), ("USES", "C", "1", "T", "1"), ("USES", "T", "1", "C", "1")]
    assert [tuple(r) for r in graph.wrote(e).collect()] == [("WROTE", "Eva", "1")]
