"""Entities of texts by dictionaries that may be large, and the graph of posts that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Names of a dictionary that is broadcast, and first words of names that become a condition on each word.
KNOWN, STARTS = 100_000, 1000


def dictionary_entities(texts: DataFrame, names: DataFrame, id_col: str = "id", text_col: str = "text", longest: int = 3, most: int = KNOWN) -> DataFrame:
    """(id, label, name, n): names (name, label) of at most `longest` words that stand in a text as whole words, whatever
    their case, and how often.

    Runs of words meet names by equality, so neither the texts nor the dictionary are compared one by one. A dictionary of
    KNOWN keys or fewer is broadcast: words meet the first words of its names, runs are made of those alone, and only runs that
    are names are counted and shuffled. Runs meet a larger one by shuffle, counted for each text before. Null or empty texts
    have none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}#_+.]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.rtrim(w, F.lit(".")))
    each = texts.select(F.col(id_col).alias("id"), words.alias("w"))

    def runs(k: int):
        return F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(0))), lambda x, i: F.array_join(F.slice("w", i + 1, k), " "))

    known = names.where(F.length(F.trim("name")) > 0).select(F.lower(F.trim("name")).alias("key"), "label", "name").dropDuplicates(["key", "label"])
    keys = known.select("key").distinct()
    if len(some := keys.take(most + 1)) <= most:
        ahead = [F.slice("w", F.lit(k + 1), F.greatest(F.size("w") - k, F.lit(0))) for k in range(longest)]
        at = each.select("id", F.inline(F.arrays_zip(*[a.alias(f"w{k}") for k, a in enumerate(ahead)])).alias(*[f"w{k}" for k in range(longest)]))
        starts = sorted({r["key"].split(" ")[0] for r in some})
        if len(starts) <= STARTS:
            at = at.where(F.col("w0").isin(starts))
        else:
            at = at.join(F.broadcast(keys.select(F.substring_index("key", " ", 1).alias("w0")).distinct()), "w0", "left_semi")
        made = [F.when(F.col(f"w{k}").isNotNull(), F.concat_ws(" ", *[f"w{i}" for i in range(k + 1)])) for k in range(longest)]
        found = at.select("id", F.explode(F.array_compact(F.array(*made))).alias("key")).join(F.broadcast(keys), "key")
    else:
        found = each.select("id", F.explode(F.concat(*map(runs, range(1, longest + 1)))).alias("key"))
    found = found.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"))
    return found.join(known, "key").select("id", "label", F.lower("name").alias("name"), "n")


def node_id(label, name):
    """One id for each label and name, whatever its case."""
    return F.md5(F.concat_ws(":", label, F.lower(F.trim(name))).cast("binary"))


def post_graph(posts: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, id, name) and edges (type, src, dst, frequency) of posts (id, title, author) and their entities
    (id, label, name, n): each post MENTIONS its entities, and its author WROTE it. Names that differ in case are one
    node; posts without an author have no WROTE edge."""
    own = posts.select(F.lit("Article").alias("label"), F.md5(F.col("id").cast("string").cast("binary")).alias("node"), F.coalesce("title", F.lit("")).alias("name"), "id", "author")
    named = entities.select("label", node_id(F.col("label"), F.col("name")).alias("node"), F.lower("name").alias("name"))
    people = own.where("author is not null").select(F.lit("Person").alias("label"), node_id(F.lit("Person"), F.col("author")).alias("node"), F.lower("author").alias("name"))
    nodes = own.select("label", "node", "name").unionByName(named.distinct()).unionByName(people.distinct())
    mentions = entities.select(F.lit("MENTIONS").alias("type"), F.md5(F.col("id").cast("string").cast("binary")).alias("src"), node_id(F.col("label"), F.col("name")).alias("dst"), F.col("n").alias("frequency"))
    wrote = own.where("author is not null").select(F.lit("WROTE").alias("type"), node_id(F.lit("Person"), F.col("author")).alias("src"), F.col("node").alias("dst"), F.lit(1).cast("long").alias("frequency"))
    return nodes.withColumnRenamed("node", "id"), mentions.unionByName(wrote)
