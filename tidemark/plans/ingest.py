"""Registered queries on model scoring, the graph writer, delivery and imported posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sql
from tidemark.operators import importing, questions, scoring
from tidemark.plans import views as v
from tidemark.plans.sources import _stream
from tidemark.sources.shared import new_folder, stored
from tidemark.streaming import delivery, graph_writer

TECHS = ("token", "license", "idiot", "clown", "SQL.")
LEAST_WORDS = 2


#: Labelled texts that the tagger is fitted on at most.
FIT_ROWS = 20_000


def _tagger(spark, sf):
    """A tagger of words that stand more often in texts labelled toxic than in others, fitted on the FIT_ROWS labelled texts
    with the smallest md5 of their id: their ids are broadcast, so that no text is shuffled."""
    label = F.when(F.col("toxic") == 1, "TOXIC").otherwise("CLEAN")
    known = v.table(spark, sf, "labels").where("toxic is not null").select("doc_id", label.alias("label"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(FIT_ROWS)
    table = scoring.fit_tagger(v.table(spark, sf, "documents").join(F.broadcast(known), "doc_id"), "text", "label", "CLEAN")
    return lambda: scoring.RunTagger(table)


def i10_scored(spark, sf):
    """Runs of at least two words that a fitted tagger marks, scored in windows of 200 words and merged."""
    windows = scoring.word_windows(v.table(spark, sf, "documents"), "doc_id", "text", 200, 20)
    scored = stored(scoring.scored_windows(windows, _tagger(spark, sf), new_folder(spark, "tagger"), 20), "scored")
    found = scoring.merged_entities(scored).where(F.size("words") >= LEAST_WORDS)
    return found.select(F.col("id").alias("doc_id"), "label", "start", F.size("words").cast("long").alias("words"), F.md5(F.array_join("words", " ").cast("binary")).alias("entity"))


def i10_model_entities(spark, sf):
    """The same tagger's entities by text: how many windows, failures, and different entities of each label."""
    out = scoring.model_entities(v.table(spark, sf, "documents"), _tagger(spark, sf), new_folder(spark, "tagger"), "doc_id", "text", 200, 20, LEAST_WORDS)
    return out.select(F.col("id").alias("doc_id"), "chunks", "failed", F.size("entities").cast("long").alias("entities"))


def place_model(words):
    """A stand-in for a model of names: what stands behind `at` is an organisation, what stands behind `in` a place."""
    out = []
    for i, w in enumerate(words[:-1]):
        if w in ("at", "in"):
            end = next((j for j in range(i + 1, len(words)) if words[j] in ("at", "in") or words[j].endswith("?")), len(words) - 1)
            end = end if words[end] in ("at", "in") else end + 1
            out.append((i + 1, end, "ORG" if w == "at" else "LOC", 0.9))
    return out


def i12_questions(spark, sf):
    """All that a question about each company's jobs names: by dictionaries, by intents, and by a model."""
    c = v.companies(spark, sf)
    what = F.when(F.col("company_id") % 2 == 0, "blue ring and Blue Ring jobs").otherwise("paint work")
    asked = c.select(F.col("company_id").alias("id"), F.concat(F.lit("Which "), what, F.lit(" are at "), "name", F.lit(" in "), F.coalesce("location", F.lit("Hue")), F.lit(" ?")).alias("text"))
    known = [f"Supplier#{i:09d}" for i in range(3)]
    out = questions.question_entities(asked, ("blue ring", "ring"), ("jobs",), known, {"paint|colour": ("brush", "roller")}, {"work": ("painter",)}, lambda: place_model, "places")
    return out.select(F.col("id").alias("company_id"), *[F.array_join(x, "|").alias(x) for x in ("technologies", "job_titles", "companies", "locations")])


def _needs(spark, sf):
    """(job_id, technologies, skills, company_id) of the jobs with a known part: its parts' names and kinds, and the company that
    v.hires gives. Lines are dealt out by job once, before sets are made of them."""
    part = v.table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    lines = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("tech_id"), F.col("l_suppkey").alias("company_id"))
    sets = [F.sort_array(F.collect_set(c)).alias(name) for c, name in (("p_name", "technologies"), ("p_type", "skills"))]
    known = lines.join(part, F.col("tech_id") == F.col("p_partkey"), "left").repartition("job_id")
    return known.groupBy("job_id").agg(*sets, F.min("company_id").alias("company_id"), F.count("p_partkey").alias("known")).where("known > 0").drop("known")


def _extracted(spark, sf):
    """Extracted messages: documents as articles, every thirteenth broken, and orders with their company as jobs."""
    d = v.table(spark, sf, "documents")
    low = F.lower(F.coalesce("text", F.lit("")))
    techs = F.filter(F.array(*[F.lit(t) for t in TECHS]), lambda t: F.contains(low, F.lower(F.rtrim(t, F.lit(".")))))
    entities = F.struct(techs.alias("TECH"), F.array(F.concat(F.lit("Công ty "), "source"), F.lit("▁Anna AG.")).alias("ORG"), F.array("lang").alias("LOC"))
    data = F.struct(F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.concat(F.lit("u"), "doc_id").alias("source_url"), F.lit("01/02/2026").alias("publish_date"), entities.alias("entities"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 100_000)
    m = F.to_json(F.struct(F.lit("extracted_article").alias("message_type"), F.col("source").alias("source_platform"), at.alias("extracted_at"), data.alias("data")))
    articles = d.select(F.when(F.col("doc_id") % 13 == 0, F.lit("{broken")).otherwise(m).alias("value"))
    jobs = v.jobs(spark, sf).join(_needs(spark, sf), "job_id").join(v.companies(spark, sf), "company_id")
    where = F.when(F.col("job_id") % 2 == 0, F.col("location"))
    data = F.struct(
        F.struct("title", F.concat(F.lit("o"), "job_id").alias("source_url"), F.col("salary").cast("string").alias("salary")).alias("job"),
        F.struct("name", where.alias("location")).alias("company"), "skills", "technologies",
    )
    m = F.to_json(F.struct(F.lit("extracted_job").alias("message_type"), F.lit("jobs").alias("source_platform"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("job_id")).alias("extracted_at"), data.alias("data")))
    return articles.unionByName(jobs.select(m.alias("value")))


def _written(spark, sf):
    folder = new_folder(spark, "graph")
    graph_writer.write_graph(_stream(_extracted(spark, sf), 24), f"{folder}/tables", f"{folder}/checkpoint")
    return graph_writer.read_graph(spark, f"{folder}/tables")


def l2_graph_writer(spark, sf):
    """All nodes that the stream of extracted messages writes."""
    t = _written(spark, sf)
    none = F.lit(None).cast("string")
    node = lambda df, label, key, name, more, n: df.select(label.alias("label"), key.alias("key"), name.alias("name"), more.alias("more"), n.alias("n"))
    c = F.col
    nodes = node(t["posts"], c("label"), c("id"), c("name"), F.coalesce("salary", "publish_date"), F.length(F.coalesce("content", F.lit(""))).cast("long"))
    nodes = nodes.unionByName(node(t["companies"], F.lit("Company"), c("id"), c("name"), c("location"), F.lit(0).cast("long")))
    for name, label in (("technologies", "Technology"), ("skills", "Skill")):
        nodes = nodes.unionByName(node(t[name], F.lit(label), c("name"), c("name"), none, c("mention_count")))
    return nodes.unionByName(node(t["places"], F.lit("Location"), c("name"), c("name"), none, F.lit(0).cast("long")))


def l2_graph_edges(spark, sf):
    return _written(spark, sf)["edges"]


def _topic(spark, sf, path, rows, shift=0):
    """Documents as Kafka rows of a topic with three partitions, appended as files."""
    rows = delivery.as_kafka_rows(rows, "raw_articles", F.col("doc_id") % 3, F.col("doc_id") + shift, F.md5(F.concat(F.lit("u"), "doc_id").cast("binary")), F.col("text"))
    rows.repartition(4).write.mode("append").parquet(path)


def _summary(rows):
    return rows.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).cast("long").alias("chars"), F.min("offset").alias("first"), F.max("offset").alias("last"))


class Stopped(RuntimeError):
    """What the queries below raise inside a batch, as a consumer does that dies."""


def l9_delivered(spark, sf):
    """A group that dies after its second batch has written but not committed, then goes on: each row once."""
    folder = new_folder(spark, "delivery")
    topic, group = f"{folder}/topic", f"{folder}/group"
    _topic(spark, sf, topic, v.table(spark, sf, "documents"))
    start = delivery.begin(spark.read.schema(delivery.KAFKA).parquet(topic), group, "earliest")
    tries = []

    def dies_once(rows, batch):
        tries.append(batch)
        if tries == [0, 1]:
            raise Stopped(f"batch {batch}")

    for _ in range(2):
        try:
            delivery.consume(delivery.topic_files(spark, topic, 2), group, start, dies_once)
        except Exception as e:  # noqa: BLE001  the stream wraps what a batch raises
            if "Stopped" not in str(e):
                raise
    return _summary(delivery.delivered(spark, group))


def l9_latest(spark, sf):
    """A group that starts at latest gets only what comes after it first asked, though the topic holds more."""
    folder = new_folder(spark, "delivery")
    topic, group = f"{folder}/topic", f"{folder}/group"
    d = v.table(spark, sf, "documents")
    _topic(spark, sf, topic, d.where("doc_id % 2 = 0"))
    delivery.begin(spark.read.schema(delivery.KAFKA).parquet(topic), group, "latest")
    _topic(spark, sf, topic, d.where("doc_id % 2 = 1"), 1 << 40)
    start = delivery.begin(spark.read.schema(delivery.KAFKA).parquet(topic), group, "latest")
    delivery.consume(delivery.topic_files(spark, topic, 2), group, start)
    return _summary(delivery.delivered(spark, group))


def a11_kafka_rows_read(spark, sf):
    """Rows of a topic, as the Kafka source gives them, with key and value as text."""
    folder = new_folder(spark, "topic")
    _topic(spark, sf, folder, v.table(spark, sf, "documents"))
    rows = delivery.texts_of(spark.read.schema(delivery.KAFKA).parquet(folder))
    return rows.select("topic", "partition", "offset", "key", F.md5(F.col("value").cast("binary")).alias("value"))


def _post_files(spark, sf):
    """Documents as files of articles (a null entry, the article, and one without a title), orders as files of jobs."""
    d = v.table(spark, sf, "documents").withColumn("low", F.lower(F.coalesce("text", F.lit(""))))
    has = lambda *ts: F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: F.contains(F.col("low"), F.lower(t)))
    entities = F.struct(
        has("Token", "license", "react").alias("TECH"), has("react", "Idiot", "license").alias("SKILL/TECH"),
        F.array(F.lit("AG"), F.upper("source"), F.lit("Reuters"), F.concat(F.lit("Org "), "lang")).alias("ORG"), F.when(F.col("doc_id") % 3 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("LOC"),
        F.array(F.concat(F.lit("Senior "), "lang"), F.lit("junior dev")).alias("JOB_ROLE"), F.array(F.lit("Ann"), F.lit("Claude"), F.concat(F.lit("Eva "), "source")).alias("PER"),
    )
    title = F.concat_ws(" ", F.col("lang"), F.col("doc_id") % 50)
    post = F.to_json(F.struct(title.alias("title"), F.col("text").alias("description"), F.lit("11/04/2026 08:30:00").alias("created_at"), entities.alias("entities")))
    name = lambda kind, key: F.concat(F.lit(kind), F.lpad(F.col(key).cast("string"), 12, "0"))
    news = d.select(name("news", "doc_id").alias("file"), F.concat(F.lit('{"source_platform":"VN-EP","post_detail":[null,'), post, F.lit(',{"content":"x"}]}')).alias("value"))
    jobs = v.jobs(spark, sf).join(_needs(spark, sf), "job_id").join(v.companies(spark, sf), "company_id")
    where = F.when(F.col("job_id") % 2 == 0, F.col("location"))
    title = F.concat_ws(" ", F.col("title"), F.col("job_id") % 100)
    post = F.to_json(F.struct(F.struct(title.alias("title"), F.lit("2026-04-11").alias("due_date"), F.col("salary").cast("string").alias("salary")).alias("job"), F.struct("name", where.alias("location")).alias("company"), "skills", "technologies"))
    jobs = jobs.select(name("topcv", "job_id").alias("file"), F.concat(F.lit('{"post_detail":['), post, F.lit("]}")).alias("value"))
    return news.unionByName(jobs)


def _imported(spark, sf):
    return importing.import_posts(_post_files(spark, sf), v.AS_OF, ("Reuters", "AG"), ("Claude",))


def j13_import_nodes(spark, sf):
    t = _imported(spark, sf)
    c, none = F.col, F.lit("")
    node = lambda name, key, a, b: t[name].select(F.lit(name).alias("kind"), key.alias("key"), a.alias("a"), b.alias("b"))
    nodes = node("articles", c("file"), c("title"), F.concat_ws("|", "source", F.length("content").cast("string"), F.date_format("published", "yyyy-MM-dd HH:mm")))
    for more in (
        node("technologies", c("name"), c("category"), c("said_by")), node("skills", c("name"), c("category"), c("said_by")), node("companies", c("key"), c("name"), F.concat_ws("|", "field", "size", "location")),
        node("roles", c("key"), c("title"), F.concat_ws("|", "level", "salary", F.col("due").cast("string"))), node("people", c("name"), none, none),
    ):
        nodes = nodes.unionByName(more)
    return nodes


def j13_import_links(spark, sf):
    t = _imported(spark, sf)
    link = lambda name, n: t[name].select(F.lit(name).alias("kind"), "title", "name", n.cast("long").alias("n"))
    links = link("article_company", F.lit(1)).unionByName(link("job_company", F.lit(1)))
    return links.unionByName(link("job_skills", F.col("n"))).unionByName(link("job_technologies", F.col("n")))


def m1_sql_phrases(spark, sf):
    """An extraction in SQL alone: phrases of a dictionary by source, a row a span before they are counted."""
    sql.register(spark)
    return spark.sql(
        "SELECT tm_slug(d.source) AS source, lower(p.entity) AS phrase, count(DISTINCT d.doc_id) AS docs FROM {d} AS d, LATERAL tm_phrases(d.text, array('of the', 'und die', 'de la', 'que de')) AS p GROUP BY 1, 2",
        d=v.table(spark, sf, "documents"),
    )


def m1_sql_dates(spark, sf):
    """Dates by patterns in SQL alone."""
    sql.register(spark)
    return spark.sql(
        "SELECT o.o_orderkey, s.place, s.entity, s.label FROM {o} AS o, LATERAL tm_dates(concat('Ngày 3 tháng 5 năm 2026, ', date_format(o.o_orderdate, 'd/M/yyyy'), ' và ', date_format(o.o_orderdate, 'M/yyyy'))) AS s",
        o=v.table(spark, sf, "orders"),
    )


QUERIES = {f.__name__: f for f in (i12_questions, m1_sql_phrases, m1_sql_dates, i10_scored, i10_model_entities, l2_graph_writer, l2_graph_edges, l9_delivered, l9_latest, a11_kafka_rows_read, j13_import_nodes, j13_import_links)}

_RUNS = r"""with words as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') as ws from documents),
each as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from words),
known as (select doc_id, toxic from labels where toxic is not null order by md5(cast(doc_id as varchar)), doc_id limit 20000),
counts as (select substr(md5(lower(w)), 1, 4) as bucket, case when toxic = 1 then 'TOXIC' else 'CLEAN' end as label, count(*) as n from each join known using (doc_id) group by 1, 2),
best as (select bucket, label from counts qualify row_number() over (partition by bucket order by n desc, label) = 1),
tagged as (select doc_id, i, w, label from each join best on bucket = substr(md5(lower(w)), 1, 4) where label <> 'CLEAN'),
runs as (select *, i - row_number() over (partition by doc_id, label order by i) as run from tagged),
found as (select doc_id, label, min(i) as start, count(*) as words, string_agg(w, ' ' order by i) as entity from runs group by doc_id, label, run having count(*) >= 2)
"""
_HAS = lambda ts: "list_filter([" + ", ".join(f"'{t}'" for t in ts) + "], lambda t: contains(lower(coalesce(text, '')), lower(rtrim(t, '.'))))"
_GRAPH = v.with_views("jobs", "requires", "hires", "companies") + f""",
a as (select * from documents where doc_id % 13 <> 0),
j as (select * from jobs join hires using (job_id) join companies using (company_id)),
need as (select distinct job_id, p_name, p_type from requires join part on tech_id = p_partkey join j using (job_id)),
aid as (select *, md5('u' || doc_id) as id from a),
tech as (select id, 'MENTIONS' as type, upper(rtrim(unnest({_HAS(TECHS)}), '.')) as name from aid union select md5('o' || job_id), 'REQUIRES', upper(p_name) from need),
skill as (select distinct md5('o' || job_id) as id, p_type as name from need),
place as (select id, lang as name from aid where lang is not null and trim(lang) <> ''),
named as (select id, 'MENTIONS' as type, 'Công ty ' || source as name, doc_id % 100000 as place_at, null as location from aid where source is not null union all select id, 'MENTIONS', 'Anna AG', doc_id % 100000, null from aid
  union all select md5('o' || job_id), 'POSTED_BY', name, job_id, case when job_id % 2 = 0 then location end from j),
company as (select *, regexp_replace(replace(replace(lower(name), ' ', '-'), '_', '-'), '[^a-z0-9-]', '', 'g') as key from named where name <> ''),
edges as (select type, id as src, 'Technology' as dst_label, name as dst from tech union select 'REQUIRES', id, 'Skill', name from skill union select 'MENTIONS', id, 'Location', name from place union select type, id, 'Company', key from company)
"""
_PLACED = v.with_views("jobs", "requires", "hires", "companies") + f""",
a as (select doc_id, lang || ' ' || doc_id % 50 as title, text, source, lang, coalesce(text, '') as t from documents),
j as (select job_id, title || ' ' || job_id % 100 as title, salary, name, case when job_id % 2 = 0 then location end as location from jobs join hires using (job_id) join companies using (company_id)),
need as (select distinct job_id, p_name, p_type from requires join part on tech_id = p_partkey join j using (job_id)),
tech as (select unnest({_HAS(("Token", "license", "react"))}) as name, doc_id as place_at, 0 as kind, 'VN-EP' as said_by from a union all select unnest({_HAS(("react", "Idiot", "license"))}), doc_id, 1, 'VN-EP' from a
  union all select p_name, 1000000000000 + job_id, 2, 'topcv' || lpad(cast(job_id as varchar), 12, '0') from need),
skill as (select name, place_at, 'Other' as category, said_by from tech where kind = 1 union all select p_type, 1000000000000 + job_id, 'General', 'topcv' || lpad(cast(job_id as varchar), 12, '0') from need),
org as (select doc_id as place_at, 1 as i, title, upper(source) as name, 'Technology' as field, case when doc_id % 3 = 0 then coalesce(lang, 'Unknown') else 'Unknown' end as location from a where length(source) > 2
  union all select doc_id, 3, title, 'Org ' || lang, 'Technology', case when doc_id % 3 = 0 then coalesce(lang, 'Unknown') else 'Unknown' end from a where lang is not null
  union all select 1000000000000 + job_id, 0, title, name, 'Technology', coalesce(location, 'Unknown') from j where name <> ''),
role as (select doc_id as place_at, 0 as i, 'Senior ' || lang as title, 'senior' as level, null as salary, null as due from a where lang is not null union all select doc_id, 1, 'junior dev', 'junior', null, null from a
  union all select 1000000000000 + job_id, 0, title, 'mid', cast(salary as varchar), '2026-04-11' from j)
"""
ORACLES = {
    "i12_questions": v.with_views("companies") + " select company_id, case when company_id % 2 = 0 then 'blue ring' else 'brush|roller' end as technologies, case when company_id % 2 = 0 then 'jobs' else 'painter' end as job_titles, name as companies, coalesce(location, 'Hue') || ' ?' as locations from companies",
    # each sign is written twice, so that neighbouring phrases have one each
    "m1_sql_phrases": r"with x as (select doc_id, regexp_replace(replace(replace(lower(coalesce(source, '')), ' ', '-'), '_', '-'), '[^a-z0-9-]', '', 'g') as source, unnest(regexp_extract_all(regexp_replace(lower(text), '([^\p{L}\p{N}_.])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_.])(of  the|und  die|de  la|que  de)(?:[^\p{L}\p{N}_.]|$)', 1)) as p from documents) select source, replace(p, '  ', ' ') as phrase, count(distinct doc_id) as docs from x group by 1, 2".replace("\\\\", "\\"),
    "m1_sql_dates": "with d as (select o_orderkey, unnest(['Ngày 3 tháng 5 năm 2026', strftime(o_orderdate, '%-d/%-m/%Y'), strftime(o_orderdate, '%-m/%Y')]) as entity, unnest([0, 1, 2])::int as place from orders) select *, 'DATE' as label from d",
    "i10_scored": _RUNS + "select doc_id, label, start, words, md5(entity) as entity from found",
    "i10_model_entities": _RUNS + ", n as (select doc_id, count(distinct (label, lower(entity))) as entities from found group by 1) select doc_id, case when len(ws) = 0 then 0 else 1 + greatest(ceil((len(ws) - 200) / 180), 0) end::bigint as chunks, 0::bigint as failed, coalesce(entities, 0) as entities from words left join n using (doc_id)",
    "l2_graph_edges": _GRAPH + "select * from edges",
    "l2_graph_writer": _GRAPH + """select 'Article' as label, id as key, split_part(text, chr(10), 1) as name, '01/02/2026' as more, length(coalesce(text, '')) as n from aid
        union all select 'Job', md5('o' || job_id), title, cast(salary as varchar), 0 from j
        union all select 'Company', key, arg_max(name, place_at), arg_max(location, place_at) filter (location is not null), 0 from company group by key
        union all select dst_label, dst, dst, null, count(*) from edges where dst_label in ('Technology', 'Skill') group by 1, 2
        union all select distinct 'Location', name, name, null, 0 from place""",
    "l9_delivered": "select 'raw_articles' as topic, (doc_id % 3)::int as partition, count(*) as n, sum(length(text))::bigint as chars, min(doc_id) as first, max(doc_id) as last from documents group by 1, 2",
    "l9_latest": "select 'raw_articles' as topic, (doc_id % 3)::int as partition, count(*) as n, sum(length(text))::bigint as chars, min(doc_id) + 1099511627776 as first, max(doc_id) + 1099511627776 as last from documents where doc_id % 2 = 1 group by 1, 2",
    "a11_kafka_rows_read": "select 'raw_articles' as topic, (doc_id % 3)::int as partition, doc_id as \"offset\", md5('u' || doc_id) as key, md5(text) as value from documents",
    "j13_import_nodes": _PLACED + """select 'articles' as kind, 'news' || lpad(cast(doc_id as varchar), 12, '0') as key, title as a, 'VNExpress|' || length(t) || '|2026-04-11 08:30' as b from a where title is not null
        union all select 'technologies', name, 'Other', arg_min(said_by, (place_at, kind)) from tech group by name
        union all select 'skills', name, arg_min(category, place_at), arg_min(said_by, place_at) from skill group by name
        union all select 'companies', lower(name), arg_min(name, (place_at, i)), arg_min(field, (place_at, i)) || '|Unknown|' || coalesce(arg_min(location, (place_at, i)) filter (location <> 'Unknown'), 'Unknown') from org group by lower(name)
        union all select 'roles', lower(title), arg_min(title, (place_at, i)), concat_ws('|', arg_min(level, (place_at, i)), arg_min(coalesce(salary, '?'), (place_at, i)), arg_min(coalesce(due, '?'), (place_at, i))).replace('|?', '') from role group by lower(title)
        union all select distinct 'people', 'Eva ' || source, '', '' from a where source is not null""",
    "j13_import_links": _PLACED + """select 'article_company' as kind, title, arg_max(name, (place_at, i)) as name, 1::bigint as n from org where place_at < 1000000000000 group by title
        union all select 'job_company', title, arg_max(name, (place_at, i)), 1 from org where place_at >= 1000000000000 group by title
        union all select 'job_skills', title, p_type, count(distinct job_id) from (select distinct job_id, p_type from need) join j using (job_id) group by 2, 3
        union all select 'job_technologies', title, p_name, count(distinct job_id) from (select distinct job_id, p_name from need) join j using (job_id) group by 2, 3""",
}
