"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stored

#: Rows that a running sum holds in one group, groups in a stretch, the resolution of virtual time for finding where the
#: budget ends, how many copies there are ordered at once, and how often the place is narrowed down to get there.
GROUP_ROWS, STRETCH, TICKS, ORDERED, NARROWER = 512, 4096, 16_384, 200_000, 3


def shuffle_key(id_col: str, seed: str = "") -> Column:
    """A 60-bit hash of the id: the shuffled order of documents, the same in every run."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def target_sizes(sources: DataFrame, weights: Sequence[int], max_repeat: int, budget: Column) -> DataFrame:
    """Add rank and target to (source, source_size): min(max_repeat x size, weight x level) with the level at which the
    targets add up to the budget. That is where resharing the excess of capped sources by weight comes to rest.

    The table has one row for each source; it is sorted in one task.
    """
    names = W.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(int(w)) for w in weights])
    df = sources.withColumn("rank", F.row_number().over(names).cast("long") - 1)
    df = df.withColumn("weight", F.element_at(ws, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    df = df.withColumn("cap", F.col("source_size") * max_repeat).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = W.orderBy("ratio", "rank")
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("budget", budget.over(all_rows))
    df = df.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # the first source, by ratio, that its share of what is left doesn't fill sets the level for the rest
    df = df.withColumn("settled", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(all_rows))
    capped = F.col("settled").isNull() | (F.struct("ratio", "rank") < F.struct("settled.ratio", "settled.rank"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("settled.level"))
    return df.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, seed: str = "") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row: how often the mix takes it, and the words so taken.

    Size is the number of words (null or empty text: 0). Sources stand in code-point order, null last, with the weights
    in turn; together they share as many words as there are, none more than max_repeat times its own. Each copy of a
    document finishes at (words of its source up to its end, in shuffled order, earlier rounds included) / target; the
    mix is all copies by that time as long as their words fit the budget. Documents of no words are never taken.
    Repeated rows count as documents of their own. All texts empty: targets and copies are 0. An empty table gives an
    empty table. Only the three named columns are read. Reruns give the same result.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), shuffle_key(id_col, seed).alias("ord")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = target_sizes(sources.select("source", "source_size"), weights, max_repeat, F.sum("source_size"))
    goal = stored(goal.join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    budget = goal.agg(F.sum("source_size")).first()[0] or 0

    # running sums of each source, piece by piece of the shuffled order
    rows = rows.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    width = F.floor(F.lit(float(1 << 60)) / F.ceil(F.col("n") / GROUP_ROWS)) + 1
    rows = rows.withColumn("piece", F.floor(F.col("ord") / width))
    sums = rows.groupBy("rank", "piece").agg(F.sum("size").alias("words"))
    # sums of pieces start from sums of stretches of pieces: no window holds more than a small share of a source
    sums = stored(sums.withColumn("stretch", F.floor(F.col("piece") / STRETCH)), "piece-sums")
    before = lambda by, over: F.coalesce(F.sum("words").over(W.partitionBy(*by).orderBy(over).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    long = sums.groupBy("rank", "stretch").agg(F.sum("words").alias("words"))
    long = long.select(F.col("rank").alias("r"), F.col("stretch").alias("s"), before(["rank"], "stretch").alias("start"))
    sums = sums.withColumn("before", before(["rank", "stretch"], "piece")).join(long, (F.col("rank") == F.col("r")) & (F.col("stretch") == F.col("s")))
    sums = sums.select("r", F.col("piece").alias("p"), (F.col("before") + F.col("start")).alias("before"))
    within = W.partitionBy("rank", "piece").orderBy("ord", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    rows = rows.join(sums, (F.col("rank") == F.col("r")) & (F.col("piece") == F.col("p"))).drop("r", "p", "n", "piece")
    rows = stored(rows.withColumn("upto", F.col("upto") + F.col("before")).drop("before"), "running")

    def finish(k):
        return (k * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")

    # a copy for each round that the target reaches, and one more for what other sources leave over
    rounds = F.least(F.lit(max_repeat), F.floor(F.col("target") / F.col("source_size")) + 1).cast("int")
    copies = rows.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), rounds - 1)))
    copies = copies.select(finish(F.col("round")).alias("at"), "rank", "ord", "id", "round", "size")
    # the stretch of virtual time in which the budget ends, narrowed down until its copies are few enough to be ordered
    low, width, done = 0.0, 1.0 / TICKS, 0
    over = None
    for _ in range(NARROWER):
        tick = F.least(F.floor((F.col("at") - low) / width), F.lit(4 * TICKS))
        ticks = copies.groupBy(tick.alias("tick")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = ticks.withColumn("upto", F.sum("words").over(W.orderBy("tick").rowsBetween(W.unboundedPreceding, 0)) + done)  # at most 4 x TICKS rows
        over = upto.where(F.col("upto") > budget).orderBy("tick").first()
        if over is None:
            break
        copies, done = copies.where(tick == over["tick"]), over["upto"] - over["words"]
        if over["n"] <= ORDERED or over["tick"] == 4 * TICKS:
            break
        low, width = low + over["tick"] * width, width / TICKS
    last = F.lit(True)
    if over is not None:
        # only here does the order of single copies matter
        order = ["at", "rank", "ord", "id", "round"]
        run = copies.withColumn("upto", F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) + done)
        end = run.where(F.col("upto") > budget).orderBy("upto").select(*order).first()
        stop = F.struct(*[F.lit(end[c]).alias(c) for c in order])
        last = F.lit(False)
    taken = F.lit(0)
    for k in range(max_repeat):
        one = F.struct(finish(F.lit(k)).alias("at"), F.col("rank").alias("rank"), F.col("ord").alias("ord"), F.col("id").alias("id"), F.lit(k).alias("round"))
        taken = taken + F.when((F.lit(k) < rounds) & (last if over is None else one < stop), 1).otherwise(0)
    n = F.when(F.col("size") > 0, taken).otherwise(0).cast("long")
    return rows.select("id", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


MIX_SQL = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as ord from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source collate "binary" nulls last) - 1 as rank from d group by source),
w as (select *, case rank % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap, sum(source_size) over () as budget from s),
r as (select *, cap::double / weight as ratio from w),
l as (select *, (budget - coalesce(sum(cap) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0))::double
  / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0))::double as level from r),
f as (select ratio as fr, rank as fk, level as fl from l where level <= ratio order by ratio, rank limit 1),
t as (select l.*, case when f.fl is null or ratio < fr or (ratio = fr and rank < fk) then cap::double else weight * fl end as target from l left join f on true),
u as (select d.doc_id, d.size, d.ord, t.source_size, t.target, t.rank, t.budget,
  sum(size) over (partition by t.rank order by ord, doc_id, size rows between unbounded preceding and current row) as upto
  from d join t on d.source is not distinct from t.source),
c as (select doc_id, size, budget, sum(size) over (order by (k * source_size + upto)::double / target, rank, ord, doc_id, k
  rows between unbounded preceding and current row) as total
  from u, range(3) as g(k) where size > 0 and k < least(3, floor(target / source_size) + 1)),
n as (select doc_id, sum(size)::bigint as taken from c where total <= budget group by doc_id)
select u.doc_id, u.size::bigint as size, u.source_size, u.target, coalesce(n.taken, 0)::bigint as taken from u left join n on u.doc_id = n.doc_id
"""
