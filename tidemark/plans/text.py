"""Registered queries on text functions and entities (SURVEY groups B, H and I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import spans, text
from tidemark.plans import views as v

TECHS = {"ring": "Ring", "widget": "Widget", "bolt": "BOLT", "small ring": "Small Ring"}
TERMS = ("small ring", "red widget", "ring", "widget", "blue", "green gear")
ACRONYMS = {"PROMO": "Promotion", "SMALL": "Size S"}


def _docs(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def _parts(spark, sf):
    return v.table(spark, sf, "part")


def h1_places(spark, sf):
    n = v.table(spark, sf, "supplier").select("s_suppkey", F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("Hà Nội", "TP. HCM", "Đà  Nẵng", "Cần-Thơ", "Huế"))), (F.col("s_suppkey") % 5 + 1).cast("int")), F.col("s_nationkey").cast("string")).alias("p"))
    return n.select("s_suppkey", text.normalize_place("p").alias("place"))


def h2_place_terms(spark, sf):
    n = v.table(spark, sf, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, ("Hà Nội", "TP. HCM", "danang", "Cần Thơ", "Huế"))), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("p"))
    return n.select("s_suppkey", F.array_join(text.place_terms("p"), "|").alias("terms"))


def b5_at_place(spark, sf):
    c = v.companies(spark, sf)
    terms = F.array(F.lit("nation_1"), F.lit("nation_20"))
    return c.where(text.at_place("location", terms)).select("company_id", "location")


def _salary(spark, sf):
    p = _parts(spark, sf)
    kind = F.col("p_partkey") % 4
    s = F.when(kind == 0, F.concat(F.lit("Từ "), "p_size", F.lit(" - "), F.col("p_size") + 10, F.lit(" triệu"))).when(kind == 1, F.concat(F.col("p_size"), F.lit(" triệu"))).when(kind == 2, F.lit("Thỏa thuận")).otherwise(F.concat(F.lit("1000 USD "), "p_size"))
    return p.select("p_partkey", "p_size", s.alias("salary"))


def h3_salary_min(spark, sf):
    return _salary(spark, sf).select("p_partkey", text.salary_min("salary").alias("low"))


def h4_salary_range(spark, sf):
    return _salary(spark, sf).select("p_partkey", text.salary_range("salary").alias("r")).select("p_partkey", "r.low", "r.high")


def h5_dates(spark, sf):
    o = v.table(spark, sf, "orders")
    f = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("hôm nay"))
    return o.select("o_orderkey", F.to_date(text.parse_date(f, v.AS_OF)).alias("day"))


def h6_levels(spark, sf):
    return _docs(spark, sf).groupBy(text.job_level("text").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def h7_categories(spark, sf):
    return _docs(spark, sf).groupBy(text.tech_category("text").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def h8_sentiment(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(text.sentiment("text", ("th", "die", "pour"), ("idiot", "ei", "que")), 6).alias("sentiment"))


def h9_roles(spark, sf):
    return _docs(spark, sf).groupBy(text.person_role("text").alias("role")).agg(F.count(F.lit(1)).alias("n"))


def h10_sources(spark, sf):
    return _docs(spark, sf).groupBy(text.source_name(F.concat(F.lit("06_05_2026_"), "source"), {"src1": "First", "src2": "Second"}).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def h11_canonical(spark, sf):
    return _parts(spark, sf).select("p_partkey", text.canonical_tech(F.substring_index("p_name", " ", -1), TECHS).alias("word"), text.canonical_tech("p_type", TECHS).alias("kind"))


def h12_clean(spark, sf):
    return _parts(spark, sf).select("p_partkey", text.clean_entity(F.concat(F.lit("(▁"), "p_name", F.lit("  x Store,)."))).alias("entity"))


def h13_titles(spark, sf):
    return v.table(spark, sf, "orders").select("o_orderkey", text.title_for_classifier(F.concat("o_orderpriority", F.lit(": 12,5% năm 2026 - "), F.date_format("o_orderdate", "d/M/yyyy"))).alias("title"))


def h14_tokens(spark, sf):
    return _parts(spark, sf).select("p_partkey", text.job_token("p_brand", F.when(F.col("p_size") > 25, F.col("p_type"))).alias("token"))


def h15_acronyms(spark, sf):
    return _parts(spark, sf).groupBy(text.expand_acronym("p_type", ACRONYMS).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def h16_alias_keys(spark, sf):
    return _parts(spark, sf).groupBy(text.alias_key(F.concat("p_name", F.lit("._/-"), "p_type")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def h17_slugs(spark, sf):
    return v.table(spark, sf, "supplier").select("s_suppkey", text.slug(F.concat("s_name", F.lit(" Việt_Nam"))).alias("slug"))


def h18_md5(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", text.md5_id("url").alias("id"))


def h19_passages(spark, sf):
    a = v.articles(spark, sf)
    return a.select("article_id", text.passage("title", "content", 200).alias("passage"), text.clipped("title", 30).alias("short"))


def h20_context(spark, sf):
    """Numbered blocks of the first three articles of each source."""
    from pyspark.sql import Window as W

    a = v.articles(spark, sf).withColumn("i", F.row_number().over(W.partitionBy("source").orderBy("article_id"))).where("i <= 3")
    line = F.concat(F.lit("["), F.col("i"), F.lit("] "), text.clipped("title", 40), F.lit("\n"), text.clipped("content", 80))
    return a.select("source", F.struct("i", line.alias("line")).alias("x")).groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("context"))


def h21_intents(spark, sf):
    found = F.filter(F.array(F.when(F.contains("p_name", F.lit("ring")), F.lit("ring"))), lambda x: x.isNotNull())
    return _parts(spark, sf).select("p_partkey", F.array_join(text.intent_terms("p_name", found, {"red|blue": "paint", "WIDGET": "tools", "blue w": "paint"}), ",").alias("terms"))


def h22_arrays(spark, sf):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("{"), F.translate("p_name", " ", ","), F.lit(",}"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('["'), F.regexp_replace("p_name", " ", '","'), F.lit('"]'))).otherwise(F.col("p_name"))
    a = text.array_literal(raw)
    return _parts(spark, sf).select("p_partkey", F.array_join(a, "|").alias("items"), F.size(a).cast("long").alias("n"))


def h24_labels(spark, sf):
    s = F.concat(F.lit("Kind: "), "p_type", F.lit(" Brand - "), "p_brand", F.lit(" Name: "), "p_name")
    return _parts(spark, sf).select("p_partkey", text.label_value(s, "brand", ["kind", "name"]).alias("brand"), text.label_value(s, "name", ["kind", "brand"]).alias("name"))


def h29_envelopes(spark, sf):
    o = v.table(spark, sf, "orders")
    j = F.to_json(F.struct(F.lit("job").alias("message_type"), F.struct("o_orderkey", "o_orderstatus").alias("data")))
    back = F.from_json(j, "message_type string, data struct<o_orderkey: long, o_orderstatus: string>")
    return o.select(j.alias("value"), back["data"]["o_orderkey"].alias("key"))


def h31_profiles(spark, sf):
    c = v.table(spark, sf, "customer")
    techs = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    role, place = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name"))
    return c.select("c_custkey", text.profile_block(role, techs, place, F.lit(None).cast("string")).alias("block"))


def i2_techs(spark, sf):
    return _parts(spark, sf).select("p_partkey", F.array_join(spans.phrases(F.concat("p_name", F.lit(", "), "p_name", F.lit(" rings")), TERMS), "|").alias("techs"))


def i5_places(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.explode(spans.phrases("text", ("of the", "und die", "de la", "que de"))).alias("phrase"))
    return d.groupBy(F.lower("phrase").alias("phrase")).agg(F.countDistinct("doc_id").alias("docs"))


def i6_organisations(spark, sf):
    return _parts(spark, sf).select("p_partkey", F.array_join(spans.organisations("p_name", ("ring", "gear")), "|").alias("orgs"))


def i9_windows(spark, sf):
    w = spans.token_windows("text", 200, 20)
    return _docs(spark, sf).select("doc_id", F.size(w).cast("long").alias("windows"))


def i1_dates(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Ngày 3 tháng 5 năm 2026, "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" và "), F.date_format("o_orderdate", "M/yyyy")).alias("t"))
    return o.select("o_orderkey", F.array_join(F.transform(spans.spans("t", "DATE", spans.DATES), lambda e: e["entity"]), "|").alias("dates"))


def i4_pay(spark, sf):
    return _salary(spark, sf).select("p_partkey", F.array_join(F.transform(spans.spans(F.concat(F.lit("Mức lương "), "salary", F.lit(" VNĐ")), "SALARY", spans.PAY, True), lambda e: e["entity"]), "|").alias("pay"))


def i8_grouped(spark, sf):
    e = F.transform(spans.phrases("p_name", TERMS), lambda x: F.struct(x.alias("entity"), F.when(F.contains(x, F.lit("ring")), "B-TECH").otherwise("I-ROLE").alias("label")))
    g = spans.grouped(e, ["TECH", "ROLE"])
    return _parts(spark, sf).select("p_partkey", F.array_join(F.array_sort(g["TECH"]), "|").alias("tech"), F.array_join(F.array_sort(g["ROLE"]), "|").alias("role"))


def i11_extract(spark, sf):
    d = spans.extract(_docs(spark, sf), F.col("text"), ("token", "license", "apache license"), ("clown", "idiot"), ("of the",))
    return d.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("techs", "roles", "locations", "dates", "pay")])


NAMES = [n for n in list(globals()) if n[0] in "bhi" and n[1].isdigit()]
QUERIES = {k: globals()[k] for k in NAMES}


def _case(col, groups, other):
    return "case " + " ".join("when " + " or ".join(f"contains(lower({col}), '{t}')" for t in terms) + f" then '{k}'" for k, terms in groups.items()) + f" else '{other}' end"


SALARY = "s as (select p_partkey, p_size, case p_partkey % 4 when 0 then 'Từ ' || p_size || ' - ' || (p_size + 10) || ' triệu' when 1 then p_size || ' triệu' when 2 then 'Thỏa thuận' else '1000 USD ' || p_size end as salary from part)"
CONTEXT = v.with_views("articles") + ", r as (select *, row_number() over (partition by source order by article_id) as i from articles), "
ORACLES = {
    "h1_places": "select s_suppkey, case s_suppkey % 5 when 0 then 'ha noi ' when 1 then 'tp hcm ' when 2 then 'a nang ' when 3 then 'cantho ' else 'hue ' end || s_nationkey as place from supplier",
    "h2_place_terms": "select s_suppkey, case s_suppkey % 5 when 0 then 'hà nội|ha noi|hanoi' when 1 then 'hồ chí minh|ho chi minh|tphcm|tp hcm|hcm' when 2 then 'đà nẵng|da nang|danang' when 3 then 'cần thơ|can tho|cantho' else 'hue' end as terms from supplier",
    "b5_at_place": v.with_views("companies") + " select company_id, location from companies where contains(lower(location), 'nation_1') or contains(lower(location), 'nation_20')",
    "h3_salary_min": "with " + SALARY + " select p_partkey, case when p_partkey % 4 in (0, 1) then p_size::double end as low from s",
    "h4_salary_range": "with " + SALARY + ", n as (select p_partkey, regexp_extract_all(salary, '[0-9]+') as n from s) select p_partkey, case when len(n) >= 2 then n[1]::bigint end as low, case when len(n) >= 2 then n[2]::bigint end as high from n",
    "h5_dates": "select o_orderkey, case when o_orderkey % 3 = 2 then date '2001-07-15' else o_orderdate::date end as day from orders",
    "h6_levels": "select " + _case("text", text.LEVELS, "mid") + " as level, count(*) as n from documents group by 1",
    "h7_categories": "select " + _case("text", text.CATEGORIES, "Other") + " as category, count(*) as n from documents group by 1",
    "h8_sentiment": "with x as (select doc_id, " + " + ".join(f"contains(lower(text), '{w}')::int" for w in ("th", "die", "pour")) + " as p, " + " + ".join(f"contains(lower(text), '{w}')::int" for w in ("idiot", "ei", "que")) + " as n from documents) select doc_id, round(case when p + n > 0 then (p - n) / (p + n) else 0 end, 6) as sentiment from x",
    "h9_roles": "select " + _case("text", text.ROLES, "Unknown") + " as role, count(*) as n from documents group by 1",
    "h10_sources": "select case source when 'src1' then 'First' when 'src2' then 'Second' else source end as name, count(*) as n from documents group by 1",
    "h11_canonical": "select p_partkey, case split_part(p_name, ' ', 2) when 'ring' then 'Ring' when 'widget' then 'Widget' when 'bolt' then 'BOLT' else upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) end as word, p_type as kind from part",
    "h12_clean": "select p_partkey, p_name || ' x' as entity from part",
    "h13_titles": "select o_orderkey, 'number ' || lower(replace(o_orderpriority[3:], '-', ' ')) || ' percent date date' as title from orders",
    "h14_tokens": "select p_partkey, lower(replace(p_brand, '#', '')) || '_' || case when p_size > 25 then lower(p_type) else 'unknown' end as token from part",
    "h15_acronyms": "select case p_type when 'PROMO' then 'PROMO (Promotion)' when 'SMALL' then 'SMALL (Size S)' else p_type end as kind, count(*) as n from part group by 1",
    "h16_alias_keys": "select p_name || ' ' || lower(p_type) as key, count(*) as n from part group by 1",
    "h17_slugs": "select s_suppkey, regexp_replace(lower(replace(replace(s_name || ' Việt_Nam', ' ', '-'), '_', '-')), '[^a-z0-9-]', '', 'g') as slug from supplier",
    "h18_md5": "select page_id, md5(coalesce(url, '')) as id from pages",
    "h19_passages": v.with_views("articles") + " select article_id, substr(trim(title || ' ' || content), 1, 200) as passage, case when length(title) > 30 then substr(title, 1, 30) || '...' else title end as short from articles",
    "h20_context": CONTEXT + "l as (select source, i, '[' || i || '] ' || case when length(title) > 40 then substr(title, 1, 40) || '...' else title end || chr(10) || case when length(content) > 80 then substr(content, 1, 80) || '...' else content end as line from r where i <= 3) select source, string_agg(line, chr(10) || chr(10) order by i) as context from l group by 1",
    "h21_intents": "select p_partkey, case when contains(p_name, 'ring') then 'ring' else array_to_string(list_filter([case when regexp_matches(p_name, 'red|blue') then 'paint' end, case when contains(p_name, 'widget') then 'tools' end], lambda x: x is not null), ',') end as terms from part",
    "h22_arrays": "select p_partkey, case when p_partkey % 3 < 2 then replace(p_name, ' ', '|') else '' end as items, case when p_partkey % 3 < 2 then 2 else 0 end::bigint as n from part",
    "h24_labels": "select p_partkey, p_brand as brand, p_name as name from part",
    "h29_envelopes": """select '{"message_type":"job","data":{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}' as value, o_orderkey as key from orders""",
    "h31_profiles": "with x as (select c_custkey, list_filter([case when c_custkey % 3 = 0 then '- Vai trò: ' || c_mktsegment end, case when c_custkey % 2 = 0 then '- Kỹ năng hiện có: a, b' end, case when c_custkey % 5 = 0 then '- Địa điểm: ' || c_name end], lambda x: x is not null) as l from customer) select c_custkey, case when len(l) > 0 then 'Thông tin người dùng:' || chr(10) || array_to_string(l, chr(10)) else '' end as block from x",
    "i2_techs": "with x as (select p_partkey, regexp_extract_all(p_name || ', ' || p_name || ' rings', '\\b(small ring|red widget|green gear|widget|blue|ring)\\b') as t from part) select p_partkey, coalesce(t[1], '') || case when len(list_distinct(t)) > 1 then '|' || list_filter(t, lambda x: x <> t[1])[1] else '' end as techs from x",
    # each sign is written twice, so that neighbouring phrases have one each
    "i5_places": "with x as (select doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '([^\\p{L}\\p{N}_.])', '\\1\\1', 'g'), '(?:^|[^\\p{L}\\p{N}_.])(of  the|und  die|de  la|que  de)(?:[^\\p{L}\\p{N}_.]|$)', 1)) as p from documents) select replace(p, '  ', ' ') as phrase, count(distinct doc_id) as docs from x group by 1",
    "i6_organisations": "select p_partkey, case when contains(p_name, 'ring') or contains(p_name, 'gear') then p_name else '' end as orgs from part",
    "i9_windows": "with x as (select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as n from documents) select doc_id, case when n = 0 then 0 else 1 + greatest(ceil((n - 200) / 180), 0) end::bigint as windows from x",
    "i1_dates": "select o_orderkey, 'Ngày 3 tháng 5 năm 2026|' || strftime(o_orderdate, '%-d/%-m/%Y') || '|' || strftime(o_orderdate, '%-m/%Y') as dates from orders",
    "i8_grouped": "with x as (select p_partkey, list_sort(list_distinct(regexp_extract_all(p_name, '\\b(small ring|red widget|green gear|widget|blue|ring)\\b'))) as t from part) select p_partkey, array_to_string(list_filter(t, lambda y: contains(y, 'ring')), '|') as tech, array_to_string(list_filter(t, lambda y: not contains(y, 'ring')), '|') as role from x",
}
