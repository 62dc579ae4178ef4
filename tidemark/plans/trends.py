"""Registered queries on trends (SURVEY groups B, D, E, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import trends
from tidemark.plans import views as v

KEYS = ("urgent", "high", "low", "medium")
NAMES = ("small ring", "RED WIDGET", "blue bolt", "green gear")
RULES = {"Rush": ("urgent",), "Main": ("high", "medium"), "Low": ("low p", "low f")}
RULE_SQL = "case when lower(title) like '%urgent%' then 'Rush' when lower(title) like '%high%' or lower(title) like '%medium%' then 'Main' when lower(title) like '%low p%' or lower(title) like '%low f%' then 'Low' else 'Other' end"


def b1_industry(spark, sf):
    a = v.articles(spark, sf)
    return a.groupBy(trends.first_match(F.col("title"), trends.INDUSTRIES, trends.OTHER).alias("industry")).agg(F.count(F.lit(1)).alias("n"))


def _any(terms):
    return "(" + " or ".join(f"contains(lower(title), '{t}')" for t in terms) + ")"


B1 = v.with_views("articles") + " select case " + " ".join(f"when {_any(t)} then '{k}'" for k, t in trends.INDUSTRIES.items()) + f" else '{trends.OTHER}' end as industry, count(*) as n from articles group by 1"


def b14_keywords(spark, sf):
    """Keyword lists from the words of event properties: the raw text is the type and the key, twice."""
    raw = v.table(spark, sf, "events").select("event_id", F.concat_ws(",", "event_type", F.lit(" "), "user_id", "event_type", F.lit("")).alias("raw"))
    return trends.parse_keywords(raw, "raw").select("event_id", F.array_join("keywords", "|").alias("keywords"), F.size("keywords").cast("long").alias("n"))


def c1_title_keywords(spark, sf):
    return trends.compare_counts(v.jobs(spark, sf), KEYS, 12, v.AS_OF).groupBy("keyword").agg(F.sum("n").alias("jobs"))


def d1_top_industries(spark, sf):
    return trends.top_industries(v.jobs(spark, sf), v.AS_OF, 4, RULES, "Other")


def d2_top_technologies(spark, sf):
    return trends.top_technologies(v.jobs(spark, sf), v.requires(spark, sf), v.technologies(spark, sf), v.AS_OF)


def _months(spark, sf):
    return trends.keyword_months(v.jobs(spark, sf), v.requires(spark, sf), v.technologies(spark, sf), NAMES, 12, v.AS_OF)


def d3_keyword_months(spark, sf):
    return _months(spark, sf)


def d3_points(spark, sf):
    p = trends.as_points(_months(spark, sf))
    return p.select("year", "month", F.to_json("counts").alias("counts"))


def a9_chart_rows(spark, sf):
    return trends.pivot_points(_months(spark, sf), NAMES)


def d4_compare(spark, sf):
    return trends.compare(v.jobs(spark, sf), KEYS, 6, v.AS_OF)


def d4_compare_long(spark, sf):
    return trends.compare(v.jobs(spark, sf), KEYS, 24, v.AS_OF)


def d5_compare_points(spark, sf):
    return trends.compare_points(v.jobs(spark, sf), KEYS, 24, v.AS_OF)


def d6_monthly_visitors(spark, sf):
    return trends.monthly_visitors(v.visits(spark, sf), 4, v.EVENTS_AS_OF)


def d7_top_keywords(spark, sf):
    return trends.top_keywords(v.visits(spark, sf))


def d8_day_totals(spark, sf):
    return trends.day_totals(v.visits(spark, sf), v.table(spark, sf, "customer"), v.EVENTS_AS_OF)


def e10_peak_month(spark, sf):
    j = v.jobs(spark, sf).where("title is not null").groupBy("title", F.date_format("posted_at", "yyyy-MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return j.groupBy("title").agg(F.max_by("m", F.struct("n", "m")).alias("peak_month"), F.max("n").alias("jobs"))


def e4_growth_first_month(spark, sf):
    p = trends.compare_points(v.jobs(spark, sf), KEYS, 12, v.AS_OF)
    return p.groupBy("keyword").agg(F.max("growth").alias("best"), F.min("growth").alias("worst"))


def f2_users_order(spark, sf):
    """Administrators first, then by name, as a position."""
    c = v.table(spark, sf, "customer")
    admin = F.when(F.col("c_mktsegment") == "MACHINERY", 0).otherwise(1)
    return c.orderBy(admin, "c_name").select("c_custkey", "c_name", admin.cast("long").alias("position"))


def _case(month):
    return f"count(*) filter (where date_trunc('month', posted_at) = {month})"


COMPARE_SQL = v.with_views("jobs") + """, k as (select unnest(['urgent', 'high', 'low', 'medium']) as keyword),
m as (select unnest(generate_series(timestamp '{first}', timestamp '2001-07-01', interval 1 month)) as month),
c as (select keyword, date_trunc('month', posted_at) as month, count(*) as n from jobs join k on contains(lower(title), keyword) group by 1, 2),
g as (select k.keyword, m.month, coalesce(n, 0) as n from k cross join m left join c on c.keyword = k.keyword and c.month = m.month),
s as (select keyword, sum(case when month >= timestamp '{start}' then n else 0 end)::bigint as job_count,
  sum(case when month = timestamp '2001-07-01' then n else 0 end) as now, sum(case when month = timestamp '2001-06-01' then n else 0 end) as last,
  sum(case when month = timestamp '2000-07-01' then n else 0 end) as year,
  arg_max(month, n * 100000 - datediff('day', date '1970-01-01', month)) filter (where month >= timestamp '{start}') as peak from g group by 1),
o as (select *, sum(job_count) over () - job_count as others from s)
select keyword, job_count, case when others > 0 then round(job_count / others * 100, 6) end as growth,
  case when last > 0 then round((now - last) / last * 100, 6) end as mom, case when year > 0 then round((now - year) / year * 100, 6) end as yoy,
  strftime(peak, '%Y-%m') as peak_month from o"""
POINTS_SQL = v.with_views("jobs") + """, k as (select unnest(['urgent', 'high', 'low', 'medium']) as keyword),
m as (select unnest(generate_series(timestamp '{first}', timestamp '2001-07-01', interval 1 month)) as month),
c as (select keyword, date_trunc('month', posted_at) as month, count(*) as n from jobs join k on contains(lower(title), keyword) group by 1, 2),
g as (select k.keyword, m.month, coalesce(n, 0) as n from k cross join m left join c on c.keyword = k.keyword and c.month = m.month),
p as (select *, first(case when n > 0 then n end order by case when n > 0 then 0 else 1 end, month) over (partition by keyword) as base,
  lag(n, 1) over w as l1, lag(n, 12) over w as l12, row_number() over (partition by keyword order by month desc) as back from g window w as (partition by keyword order by month))
"""
MONTHS_SQL = v.with_views("jobs", "requires", "technologies") + """, x as (select year(posted_at) as year, month(posted_at) as month,
  case lower(name) when 'red widget' then 'RED WIDGET' else lower(name) end as keyword, count(distinct job_id) as job_count
  from requires join technologies using (tech_id) join jobs using (job_id)
  where lower(name) in ('small ring', 'red widget', 'blue bolt', 'green gear') and posted_at >= timestamp '2000-07-15' and posted_at < timestamp '2001-08-01' group by 1, 2, 3)"""

QUERIES = {f.__name__: f for f in (b1_industry, b14_keywords, c1_title_keywords, d1_top_industries, d2_top_technologies, d3_keyword_months, d3_points, a9_chart_rows, d4_compare, d4_compare_long, d5_compare_points, d6_monthly_visitors, d7_top_keywords, d8_day_totals, e10_peak_month, e4_growth_first_month, f2_users_order)}
ORACLES = {
    "b1_industry": B1,
    "b14_keywords": "with r as (select event_id, list_distinct([event_type, cast(user_id as varchar)]) as k from events) select event_id, event_type || '|' || user_id as keywords, 2::bigint as n from events",
    "c1_title_keywords": v.with_views("jobs") + ", k as (select unnest(['urgent', 'high', 'low', 'medium']) as keyword) select keyword, count(job_id) as jobs from k left join jobs on contains(lower(title), keyword) and posted_at >= timestamp '2000-07-01' and posted_at < timestamp '2001-08-01' group by 1",
    "d1_top_industries": v.with_views("jobs") + f""", c as (select {RULE_SQL} as industry, posted_at from jobs),
g as (select industry, count(*) as total, count(*) filter (where posted_at < timestamp '2001-07-01') as before, count(*) filter (where posted_at >= timestamp '2001-07-01') as now,
  count(*) filter (where posted_at >= timestamp '2001-06-01' and posted_at < timestamp '2001-07-01') as last from c where industry <> 'Other' group by 1)
select industry, total as job_count, case when before > 0 then round((total - before) / before * 100, 6) end as growth, case when last > 0 then round((now - last) / last * 100, 6) end as mom
from g order by job_count desc, industry limit 4""",
    "d2_top_technologies": v.with_views("jobs", "requires", "technologies") + """ select min(name) as technology, count(distinct job_id) as job_count from requires join technologies using (tech_id) join jobs using (job_id)
where posted_at < timestamp '2001-08-01' group by lower(name) order by job_count desc, technology limit 10""",
    "d3_keyword_months": MONTHS_SQL + " select * from x",
    "d3_points": MONTHS_SQL + """ select year, month, '{' || string_agg('"' || keyword || '":' || job_count, ',' order by keyword) || '}' as counts from x group by 1, 2""",
    "a9_chart_rows": MONTHS_SQL + " select printf('%04d-%02d', year, month) as month_label, " + ", ".join(f"sum(case when keyword = '{k}' then job_count else 0 end)::bigint as \"{k}\"" for k in NAMES) + " from x group by 1",
    "d4_compare": COMPARE_SQL.format(first="2000-07-01", start="2001-01-01"),
    "d4_compare_long": COMPARE_SQL.format(first="1999-07-01", start="1999-07-01"),
    "d5_compare_points": POINTS_SQL.format(first="1999-07-01") + """select keyword, 'T' || month(month) || '/' || year(month) as month_label, n, case when base > 0 then round((n - base) / base * 100, 2) else 0 end as growth,
  case when l1 > 0 then round((n - l1) / l1 * 100, 6) end as mom, case when l12 > 0 then round((n - l12) / l12 * 100, 6) end as yoy, back <= 3 as is_last from p""",
    "d6_monthly_visitors": v.with_views("visits") + ", m as (select unnest(generate_series(timestamp '2023-10-01', timestamp '2024-01-01', interval 1 month)) as month) select strftime(month, '%Y-%m') as month, count(distinct ip) as visitors from m left join visits on date_trunc('month', ts) = month group by 1",
    "d7_top_keywords": "select event_type as keyword, count(*) as searches from events group by 1 order by searches desc, keyword limit 4",
    "d8_day_totals": "select (select count(*) from customer) as users, count(distinct user_id) as visits_today, count(*) as searches_today from events where cast(ts as date) = date '2024-01-20'",
    "e10_peak_month": v.with_views("jobs") + ", c as (select title, strftime(posted_at, '%Y-%m') as m, count(*) as n from jobs group by 1, 2) select title, arg_max(m, (n, m)) as peak_month, max(n) as jobs from c group by 1",
    "e4_growth_first_month": POINTS_SQL.format(first="2000-07-01") + "select keyword, max(g) as best, min(g) as worst from (select keyword, case when base > 0 then round((n - base) / base * 100, 2) else 0 end as g from p) group by 1",
    "f2_users_order": "select c_custkey, c_name, case when c_mktsegment = 'MACHINERY' then 0 else 1 end::bigint as position from customer",
}
