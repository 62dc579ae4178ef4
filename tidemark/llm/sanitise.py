"""Personal data: patterns for four kinds, and terms that give a protected value away. DataFrame functions only.

A term is judged by what it tells about a protected value (an address, number or card found by pattern) in the corpus:
pmi(term; value) = log2(p(term, value) / (p(term) p(value))), against ic(value) = -log2 p(value), all that there is to
know. Terms with pmi >= `general` of ic are generalised to their class; those with pmi >= `gone` of ic are removed
(C-sanitisation, Sánchez and Batet, 2016). The counts are over the whole corpus. Copies teach nothing: equal texts are
one, and a text counts once, by the words beside the term, so a passage that many texts share is one observation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: The contract's kinds and patterns, in its order. Written so that Java's matcher neither recurses nor starts again
#: inside a run of characters that it has looked at (\G: where the last match ended); the matches are the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A number of 255 at most, leading zeros or not.
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = {k: i for i, k in enumerate([*PATTERNS, "term"])}
#: A term: letters and digits, with signs inside that belong to names.
TERM = r"[\p{L}\p{N}]++(?:['’_-][\p{L}\p{N}]++)*+"
#: Characters on each side of a value in which terms stand beside it; texts that must show a term beside a value, each
#: with other words around it; and the shares of ic from which terms are generalised and removed.
REACH, SUPPORT, GENERAL, GONE = 300, 3, 0.9, 1.0
#: Terms or digests up to which a table is broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 200_000
SPAN = "struct<start: bigint, end: bigint, kind: string>"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column, most: int = 19) -> Column:
    """Whether the check digit of at most `most` digits is right."""
    back = F.reverse(digits)
    terms = []
    for i in range(most):
        d = F.when(F.length(back) > i, F.substring(back, i + 1, 1).cast("int")).otherwise(0)
        terms.append(F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 else d)
    return reduce(lambda a, b: a + b, terms) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = digits_of(match)
    if kind == "ip":
        return match.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        # the sum is only formed for cards of the right length
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, text): all that is found depends on the text alone, so tables are kept by its digest."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def _found(texts: DataFrame, kind: str, pattern: str, reach: int) -> DataFrame:
    """(digest, kind, i, gap, match, ok, before, after) of the matches of a pattern: their number in the text, the
    characters between them, and up to `reach` characters on each side of the valid ones, up to the next match."""
    df = texts.where(F.col("text").rlike(pattern))
    df = df.select("digest", F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("matches"))
    # a match stands between two gaps
    after = F.slice("gaps", F.lit(2), F.size("matches"))
    df = df.select("digest", F.posexplode(F.arrays_zip(F.col("matches").alias("match"), F.slice("gaps", F.lit(1), F.size("matches")).alias("gap"), after.alias("next"))).alias("i", "m"))
    ok = valid(kind, F.col("m.match"))
    df = df.select("digest", F.lit(kind).alias("kind"), "i", F.length("m.gap").cast("long").alias("gap"), F.col("m.match").alias("match"), ok.alias("ok"), F.col("m.gap").alias("left"), F.col("m.next").alias("right"))
    shown = lambda c: F.when(F.col("ok"), c)
    return df.select("digest", "kind", "i", "gap", "match", "ok", shown(F.expr(f"right(left, {reach})")).alias("before"), shown(F.expr(f"left(right, {reach})")).alias("after"))


def base_values(texts: DataFrame, reach: int = REACH) -> DataFrame:
    """A stored table (digest, kind, start, end, match, before, after) of the valid matches in each different text, by
    code points, the end exclusive. Equal texts are put together before rows are shuffled."""
    each = reduce(DataFrame.unionByName, [_found(texts, k, p, reach) for k, p in PATTERNS.items()])
    each = each.dropDuplicates(["digest", "kind", "i"])
    places = W.partitionBy("digest", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(places)
    each = each.withColumn("end", end).where("ok")
    start = F.col("end") - F.length("match")
    return stored(each.select("digest", "kind", start.alias("start"), "end", "match", "before", "after"), "values")


def _terms(text: Column) -> Column:
    """The terms of a text in lower case, in their order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _beside(df: DataFrame, terms: str, *keep: str) -> DataFrame:
    """A row for each term of an array column: t, and what stands beside it as w."""
    n = F.size(terms)
    none = F.array(F.lit(""))
    left = F.concat(none, F.slice(terms, F.lit(1), F.greatest(n - 1, F.lit(0))))
    right = F.concat(F.slice(terms, F.lit(2), F.greatest(n - 1, F.lit(0))), none)
    zipped = F.arrays_zip(F.col(terms).alias("t"), left.alias("l"), right.alias("r"))
    return df.where(n > 0).select(*keep, F.explode(zipped).alias("x")).select(*keep, F.col("x.t").alias("t"), F.concat_ws(" ", "x.l", "x.r").alias("w"))


def protected(kind: Column, match: Column) -> Column:
    """The value that a match stands for, however it is written: lower case, or digits alone."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), digits_of(match)).otherwise(F.lower(match)))


def _without_values(text: Column) -> Column:
    for pattern in PATTERNS.values():
        text = F.regexp_replace(text, pattern, " ")
    return text


def joint_counts(values: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(value, t, joint), (value, shown) and (t, near): in how many texts a term stands beside a value, a value at all,
    and a term beside any value, each text that has other words beside it."""
    df = values.select("digest", protected(F.col("kind"), F.col("match")).alias("value"), _terms(_without_values(F.col("before"))).alias("b"), _terms(_without_values(F.col("after"))).alias("a"))
    shown = df.select("digest", "value", F.concat_ws(" ", F.coalesce(F.get("b", F.size("b") - 1), F.lit("")), F.coalesce(F.get("a", F.lit(0)), F.lit(""))).alias("w"))
    shown = shown.groupBy("digest", "value").agg(F.min("w").alias("w")).select("value", "w").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("shown"))
    sides = _beside(df, "b", "digest", "value").unionByName(_beside(df, "a", "digest", "value"))
    sides = stored(sides.groupBy("digest", "value", "t").agg(F.min("w").alias("w")), "beside")
    joint = sides.select("value", "t", "w").distinct().groupBy("value", "t").agg(F.count(F.lit(1)).alias("joint"))
    near = sides.groupBy("digest", "t").agg(F.min("w").alias("w")).select("t", "w").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("near"))
    return joint, shown, near


def _small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast up to a counted number of rows, else left to shuffles."""
    return F.broadcast(df) if df.count() <= limit else df.hint("merge")


def disclosing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, support: int = SUPPORT, general: float = GENERAL, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(t, value, joint, seen, shown, share) of the terms and protected values with share = pmi / ic >= general: the
    table behind the added spans, for inspection. See sanitised_spans."""
    texts = _text(docs, id_col, text_col)
    return _disclosing(texts, base_values(texts, reach), support, general, broadcast_rows)[0]


def _disclosing(texts: DataFrame, values: DataFrame, support: int, general: float, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    joint, shown, near = joint_counts(values)
    joint = stored(joint.where(F.col("joint") >= support), "joint")
    n = float(max(texts.select("digest").distinct().count(), 1))

    def judged(df: DataFrame) -> DataFrame:
        """With share = log2(p(t, value) / (p(t) p(value))) / -log2 p(value), if it is large enough."""
        pmi, ic = F.log2(F.lit(n) * F.col("joint") / (F.col("seen") * F.col("shown"))), F.log2(F.lit(n) / F.col("shown"))
        return df.withColumn("share", F.round(F.try_divide(pmi, ic), 9)).where(F.col("share") >= general)

    # a value is shown at least as often as any term beside it, and a term is seen at least as often as beside values; a
    # share falls as its term is seen more often, so what is too common already beside values needs no look at all texts
    most = joint.groupBy("value").agg(F.max("joint").alias("most"))
    shown = shown.join(most, "value").select("value", F.greatest("shown", "most").alias("shown"))
    pairs = stored(judged(joint.join(shown, "value").join(near.withColumnRenamed("near", "seen"), "t")), "pairs")
    candidates = stored(pairs.select("t").distinct(), "candidates")
    # all words of all texts; a text is one observation of a term, told apart by the words beside it
    words = _beside(texts.select("digest", _terms(F.col("text")).alias("words")), "words", "digest")
    seen = words.join(_small(candidates, broadcast_rows), "t").groupBy("digest", "t").agg(F.min("w").alias("w"))
    seen = stored(seen, "seen")
    counts = seen.select("t", "w").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("all_seen"))
    found = judged(pairs.drop("share").join(counts, "t").withColumn("seen", F.greatest("seen", "all_seen")))
    return stored(found.select("t", "value", "joint", "seen", "shown", "share"), "disclosing"), seen


def _term_spans(texts: DataFrame, terms: DataFrame, seen: DataFrame, broadcast_rows: int) -> DataFrame:
    """(digest, start, end, t, gone) of each place of a disclosing term."""
    hits = stored(seen.join(_small(terms, broadcast_rows), "t").select("digest").distinct(), "disclosing-texts")
    own = texts.join(_small(hits, broadcast_rows), "digest").dropDuplicates(["digest"])
    df = own.select("digest", F.split("text", TERM, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("words"))
    df = df.select("digest", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.slice("gaps", F.lit(1), F.size("words")).alias("gap"))).alias("i", "m"))
    df = df.select("digest", "i", F.col("m.word").alias("word"), F.length("m.gap").cast("long").alias("gap"))
    df = df.withColumn("end", F.sum(F.col("gap") + F.length("word")).over(W.partitionBy("digest").orderBy("i")))
    df = df.select("digest", F.lower("word").alias("t"), (F.col("end") - F.length("word")).alias("start"), "end")
    return df.join(_small(terms, broadcast_rows), "t")


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, support: int = SUPPORT, general: float = GENERAL, gone: float = GONE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table (digest, spans) of the different texts that have any: start, end (exclusive, in code points), kind
    and whether the span is to be removed rather than generalised, by start, then kind."""
    texts = _text(docs, id_col, text_col)
    values = base_values(texts, reach)
    found, seen = _disclosing(texts, values, support, general, broadcast_rows)
    terms = found.groupBy("t").agg((F.max("share") >= gone).alias("gone"))
    base = values.select("digest", "start", "end", "kind", F.lit(False).alias("gone"))
    added = _term_spans(texts, terms, seen, broadcast_rows).select("digest", "start", "end", F.lit("term").alias("kind"), "gone")
    # a term inside a base span, or across its edge, is part of what that span covers: both of a text are put in order
    # together, and a term must begin after all base spans before it and end before the next one
    both = base.unionByName(added)
    is_base = F.col("kind") != "term"
    order = W.partitionBy("digest").orderBy("start", is_base.desc(), "end")
    before = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.min(F.when(is_base, F.col("start"))).over(W.partitionBy("digest").orderBy(F.desc("start"), is_base.asc(), F.desc("end")).rowsBetween(W.unboundedPreceding, W.currentRow))
    both = both.withColumns({"before": before, "after": after})
    free = is_base | ((F.coalesce("before", F.lit(0).cast("long")) <= F.col("start")) & (F.coalesce(F.col("after") >= F.col("end"), F.lit(True))))
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS[k]), KINDS, F.when(F.lit(False), -1))
    spans = both.where(free).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "gone"))).alias("spans"))
    return stored(spans, "spans")


def sanitised_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, spans) of every row: all personal data in its text, as an array of (start, rank, end, kind, gone), by start.

    Base spans of a kind are the leftmost matches that don't overlap and pass the kind's check (ip: parts of 255 at most;
    card: 12 to 19 digits whose check digit is right; phone: 9 to 15 digits); they stand as they are. Added spans have the
    kind `term`: places of terms, in any text, that disclose a protected value by the corpus; they never touch a base
    span. A null text is empty and has no spans; null ids stay null; repeated rows are returned as often as they came and
    count once. An empty table gives an empty table. Other columns are not read. Options are those of found_spans.
    """
    spans = found_spans(docs, id_col, text_col, **options)
    each = _text(docs, id_col, text_col).select("id", "digest")
    none = F.array().cast(spans.schema["spans"].dataType)
    return each.join(spans, "digest", "left").select("id", F.coalesce("spans", none).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text) of every row with personal data taken out: base spans become [EMAIL], [IP], [CARD] or [PHONE], terms are
    generalised to [NUMBER], [NAME] (a capital first) or [WORD], or removed where they tell all about a value. Of spans
    that overlap, the first is replaced whole and the rest of the others with it. See sanitised_spans for the rest."""
    spans = found_spans(docs, id_col, text_col, **options)
    df = _text(docs, id_col, text_col).join(spans, "digest", "left")
    word = lambda s: F.substring("text", (s.start + 1).cast("int"), (s.end - s.start).cast("int"))
    label = lambda s: (
        F.when(s.kind != "term", F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))).when(s.gone, "")
        .when(word(s).rlike(r"^\p{N}"), "[NUMBER]").when(word(s).rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    )
    pieces = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s.start >= acc.at,
            F.struct(s.end.alias("at"), F.concat(acc.out, F.substring("text", (acc.at + 1).cast("int"), (s.start - acc.at).cast("int")), label(s)).alias("out")),
        ).otherwise(F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out"))),
        lambda acc: F.concat(acc.out, F.substring("text", (acc.at + 1).cast("int"), F.length("text"))),
    )
    return df.select("id", F.when(F.size("spans") > 0, pieces).otherwise(F.col("text")).alias("text"))


def span_digests(found: DataFrame) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of rows of sanitised_spans."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind != "term")
    of = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


#: The contract's patterns as SQL has them, and the whole operator in SQL: a text is one row, spans are found by splitting.
_SQL_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
_SQL_CLEAN = "regexp_replace(" * 4 + "{}" + "".join(f", '{p}', ' ', 'g')" for p in _SQL_PATTERNS.values())
SANITISE_SQL = r"""
with d as (select distinct coalesce(text, '') as t from documents),
""" + ",\n".join(
    # one table for each kind, as patterns must be constants
    rf"""m{r} as (select t, '{k}' as kind, {r} as rank, unnest(regexp_extract_all(t, '{p}')) as m, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) as i, regexp_split_to_array(t, '{p}') as gaps from d)"""
    for r, (k, p) in enumerate(_SQL_PATTERNS.items())
) + r""",
m as (select *, regexp_replace(m, '[^0-9]', '', 'g') as digits, sum(length(gaps[i]) + length(m)) over (partition by t, kind order by i)::bigint as en from (from m0 union all from m1 union all from m2 union all from m3)),
v as (select *, en - length(m) as st, right(gaps[i], 300) as before, left(gaps[i + 1], 300) as after, kind || ':' || case when kind in ('card', 'phone') then digits else lower(m) end as value from m where case kind
  when 'ip' then len([x for x in string_split(m, '.') if length(ltrim(x, '0')) > 3 or coalesce(try_cast(ltrim(x, '0') as int), 0) > 255]) = 0
  when 'card' then length(digits) between 12 and 19 and list_sum([case when j % 2 = 0 then (reverse(digits)[j]::int * 2) // 10 + (reverse(digits)[j]::int * 2) % 10 else reverse(digits)[j]::int end for j in range(1, length(digits) + 1)]) % 10 = 0
  when 'phone' then length(digits) between 9 and 15 else true end),
c as (select t, value, CLEAN(before) as b, CLEAN(after) as a from v),
b as (select t, value, regexp_extract_all(lower(b), 'TERM') as b, regexp_extract_all(lower(a), 'TERM') as a from c),
own as (select t, value, min(coalesce(b[len(b)], '') || ' ' || coalesce(a[1], '')) as w from b group by t, value),
shown0 as (select value, count(distinct w) as shown from own group by value),
side as (select t, value, unnest(x) as word, unnest([coalesce(x[j - 1], '') || ' ' || coalesce(x[j + 1], '') for j in range(1, len(x) + 1)]) as w from (select t, value, b as x from b union all select t, value, a from b)),
beside as (select t, value, word, min(w) as w from side group by all),
joint as (select value, word, count(distinct w) as joint from beside group by all having count(distinct w) >= 3),
near as (select word, count(distinct w) as near from (select t, word, min(w) as w from beside group by all) group by word),
shown as (select value, greatest(any_value(shown), max(joint)) as shown from joint join shown0 using (value) group by value),
words as (select t, regexp_extract_all(lower(t), 'TERM') as x from d where exists (from joint)),
each as (select t, unnest(x) as word, unnest([coalesce(x[j - 1], '') || ' ' || coalesce(x[j + 1], '') for j in range(1, len(x) + 1)]) as w from words),
seen as (select word, count(distinct w) as seen from (select t, word, min(w) as w from each semi join joint using (word) group by all) group by word),
n as (select count(*)::double as n from d),
terms as (select distinct word from joint join shown using (value) join near using (word) join seen using (word), n where n > shown and round(log2(n * joint / (greatest(seen, near) * shown)) / log2(n / shown), 9) >= 0.9),
places as (select t, unnest(regexp_extract_all(t, 'TERM')) as m, unnest(range(1, len(regexp_extract_all(t, 'TERM')) + 1)) as i, regexp_split_to_array(t, 'TERM') as gaps from d where exists (from terms)),
placed as (select t, lower(m) as word, length(m) as size, sum(length(gaps[i]) + length(m)) over (partition by t order by i)::bigint as en from places),
added as (select t, 'term' as kind, 4 as rank, en - size as st, en from placed semi join terms using (word)),
free as (from added anti join v on v.t = added.t and v.st < added.en and v.en > added.st),
spans as (select t, kind, rank, st, en from v union all from free),
found as (select t, string_agg(kind || ':' || st || ':' || en, ',' order by st, rank) as spans, coalesce(string_agg(kind || ':' || st || ':' || en, ',' order by st, rank) filter (kind <> 'term'), '') as base,
  count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone from spans group by t)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join found on t = coalesce(text, '')
""".replace("CLEAN(before)", _SQL_CLEAN.replace("{}", "before")).replace("CLEAN(after)", _SQL_CLEAN.replace("{}", "after")).replace("TERM", r"[\p{L}\p{N}]+(?:[''’_-][\p{L}\p{N}]+)*")
