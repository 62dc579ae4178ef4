"""Substring de-duplication: paragraphs, and passages of them, meet in MinHash bands, are verified by Jaccard, and clustered."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.buckets import bucket_links
from tidemark.llm.common import slices, stored
from tidemark.llm.components import connected_components

#: Words in a shingle, words on both sides among which a passage's first shingle must be the least, bands of one MinHash
#: each (at a similarity of 0.8 they miss 0.2 ** 3 of the pairs), similarity of a link, and words in a repeat at least.
SHINGLE, REACH, BANDS, SIMILAR, REPEAT_WORDS = 5, 6, 3, 0.8, 22
#: Bands of a whole paragraph (they miss 0.2 ** 4), and words of one at least: shorter ones are only similar if equal, and
#: equal ones have equal passages.
PARAGRAPH_BANDS, PARAGRAPH_WORDS = 4, 8
#: Bits of an identifier for a passage in its document; the others are shared by the partition, as many as it needs, and
#: the document's row in it.
PASSAGE_BITS, ROW_AND_PARTITION_BITS = 21, 42
#: Rows of a bucket that a task holds at most.
HELD = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_WHOLE = np.uint64(0xA24BAED4963EE407)  # keeps the keys and digests of paragraphs apart from those of passages
_Q, _R = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_SLICE = 1_000_000
_tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if len(_tables[0]) < n:
        out = []
        for base in (_P, _PI):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _tables = (out[0], out[1])
    return _tables


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return (x ^ (x >> np.uint64(29))) * _R


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Passages of texts, one behind the other: doc, number, start and end (code points), words, digest, and for each
    passage its shingles (`shingle`, of passage `of`).

    A paragraph is a line. Within it a passage begins where the hash of the next SHINGLE words is less than at REACH words
    to either side: the same words are cut alike wherever they stand, so a text inside a longer paragraph is found too.
    Words are compared with A-Z in lower case; a passage of fewer words than a shingle is one shingle. Whole paragraphs of
    PARAGRAPH_WORDS or more come too, in fields with p_ in front: p_first is a paragraph's first passage, p_parts their number.
    """
    n = len(texts)
    lens = np.fromiter(map(len, texts), np.int64, n)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begin = np.cumsum(lens + 1) - lens - 1
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    empty = np.zeros(0, np.int64)
    if not len(start):
        return dict.fromkeys(("doc", "number", "start", "end", "words", "of", "p_first", "p_parts", "p_start", "p_end", "p_words", "p_of"), empty) | dict.fromkeys(("digest", "shingle", "p_digest", "p_shingle"), empty.astype(np.uint64))
    doc = np.searchsorted(begin, start, side="right") - 1
    line = np.cumsum(data == 10)[start]
    up, down = _powers(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    word = _mixed((total[end] - total[start]) * down[start])
    m = len(word)
    gram = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        gram[: m - j] = gram[: m - j] * _P + word[j:]
    gram = _mixed(gram)
    last = np.concatenate([np.flatnonzero(np.diff(line)), [m - 1]])
    line_end = np.repeat(last, np.diff(np.concatenate([[-1], last])))
    whole = np.arange(m) + SHINGLE - 1 <= line_end  # the shingle lies within the line
    value = np.where(whole, gram, ~np.uint64(0))
    cut = whole.copy()
    for j in range(1, REACH + 1):
        same = line[j:] == line[:-j]
        cut[j:] &= ~same | (value[j:] < value[:-j])
        cut[:-j] &= ~same | (value[:-j] <= value[j:])
    cut[0] = True
    cut[1:] |= line[1:] != line[:-1]
    first = np.flatnonzero(cut)
    of_word = np.cumsum(cut) - 1
    behind = np.concatenate([first[1:], [m]])
    words = behind - first
    inside = np.arange(m) + SHINGLE <= behind[of_word]
    short = words < SHINGLE
    sums = np.concatenate([[np.uint64(0)], np.cumsum(word * up[:m])])
    digest = _mixed((sums[behind] - sums[first]) * down[first] + words.astype(np.uint64))
    shingle = np.where(short[of_word], digest[of_word], gram)
    inside |= short[of_word] & (np.arange(m) == first[of_word])
    head = np.concatenate([[0], last[:-1] + 1])
    long = last + 1 - head >= PARAGRAPH_WORDS
    p_of = np.repeat(np.cumsum(long) - 1, last + 1 - head)
    p_inside = whole & np.repeat(long, last + 1 - head)
    head, tail = head[long], last[long] + 1
    p_digest = _mixed((sums[tail] - sums[head]) * down[head] + (tail - head).astype(np.uint64)) ^ _WHOLE
    p_first = of_word[head]
    point = np.cumsum((data & 0xC0) != 0x80) - 1
    of_doc = doc[first]
    base = point[begin[of_doc]]
    number = np.arange(len(first)) - np.searchsorted(of_doc, of_doc, side="left")
    return {
        "doc": of_doc, "number": number, "start": point[start[first]] - base, "end": point[end[behind - 1] - 1] + 1 - base,
        "words": words, "digest": digest, "of": of_word[inside], "shingle": shingle[inside],
        "p_first": p_first, "p_parts": of_word[tail - 1] + 1 - p_first, "p_start": point[start[head]] - base[p_first], "p_end": point[end[tail - 1] - 1] + 1 - base[p_first],
        "p_words": tail - head, "p_digest": p_digest, "p_of": p_of[p_inside], "p_shingle": gram[p_inside],
    }


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


_CUT = pa.schema([("uid", pa.int64()), ("local", pa.int64()), ("many", pa.bool_()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("parts", pa.int32()), ("digest", pa.int64()), *((f"k{i}", pa.int64()) for i in range(PARAGRAPH_BANDS))])
CUT = "uid long, local long, many boolean, doc_id long, start int, end int, words int, parts int, digest long, " + ", ".join(f"k{i} long" for i in range(PARAGRAPH_BANDS))


def _keys(shingle: np.ndarray, of: np.ndarray, n: int, bands: int, salt: np.uint64) -> list[np.ndarray]:
    """Band by band the least hash of each of n sets of shingles; 0 for bands that they don't have."""
    if not n:
        return [np.zeros(0, np.uint64)] * PARAGRAPH_BANDS
    at = np.searchsorted(of, np.arange(n))
    keys = [(np.minimum.reduceat(_mixed(shingle * np.uint64(2 * k + 3) + np.uint64(k)), at) + np.uint64(k * int(_P) & 0xFFFFFFFFFFFFFFFF)) ^ salt for k in range(bands)]
    return keys + [np.zeros(n, np.uint64)] * (PARAGRAPH_BANDS - bands)


def _cut(partitions: int):
    """Rows of passages and, with ~uid of its first passage for a uid, of paragraphs. Equal ones of one batch are joined
    here, before any shuffle: `local` is the first of them. OverflowError where a number doesn't fit into its bits."""
    row_bits = ROW_AND_PARTITION_BITS - max(1, (partitions - 1).bit_length())

    def run(batches):
        number = TaskContext.get().partitionId()
        if number >= 1 << (ROW_AND_PARTITION_BITS - row_bits):
            raise OverflowError("more partitions than planned")
        yield from _cut_rows(batches, number << (row_bits + PASSAGE_BITS), 1 << row_bits)

    return run


def _cut_rows(batches, part: int, most_rows: int):
    rows = 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = batch.column(1)
        sizes = [len(x) for x in _utf8(texts)]
        parts = []
        for s, e in slices([range(k) for k in sizes], _SLICE):
            got = segments(_utf8(texts.slice(s, e - s)))
            n, first = len(got["doc"]), got["p_first"]
            if not n:
                continue
            if rows + e > most_rows or got["number"].max() >> PASSAGE_BITS:
                raise OverflowError("a partition has too many rows, or a text too many passages, for their identifiers")
            keys = _keys(got["shingle"], got["of"], n, BANDS, np.uint64(0))
            uid = part + ((rows + s + got["doc"]) << PASSAGE_BITS) + got["number"]
            parts.append((uid, ids[s + got["doc"]], got["start"], got["end"], got["words"], np.ones(n, np.int64), got["digest"].view(np.int64), *[k.view(np.int64) for k in keys]))
            keys = _keys(got["p_shingle"], got["p_of"], len(first), PARAGRAPH_BANDS, _WHOLE)
            parts.append((~uid[first], ids[s + got["doc"][first]], got["p_start"], got["p_end"], got["p_words"], got["p_parts"], got["p_digest"].view(np.int64), *[k.view(np.int64) for k in keys]))
        rows += len(ids)
        if not parts:
            continue
        uid, doc_id, start, end, words, count, digest, *keys = (np.concatenate(c) for c in zip(*parts))
        _, first, back, equal = np.unique(digest, return_index=True, return_inverse=True, return_counts=True)
        columns = (uid, uid[first[back]], equal[back] > 1, doc_id, start, end, words, count, digest, *keys)
        for i in range(0, len(uid), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000], f.type) for c, f in zip(columns, _CUT)], schema=_CUT)


FOUND = "rep long, uid long, sig long, member long, digest long"
_FOUND = pa.schema([(c, pa.int64()) for c in ("rep", "uid", "sig", "member", "digest")])


def _grouped(batches):
    """From rows (key, uid, digest, band) sorted by key and digest: (rep, uid) of equal passages, from the first band, and
    (sig, member, digest) of the buckets in which different ones meet; equal buckets have the same sig, but for those of
    more than HELD members, which are passed on as they come."""
    held, large = None, None  # rows of the last key; the last row of a key that is too large to hold
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if large is not None:
            n = int(np.searchsorted(rows[0], large[0, 0], side="right"))
            part, rows = np.concatenate([large, rows[:, :n]], axis=1), rows[:, n:]
            firsts = np.concatenate([[True], part[2, 1:] != part[2, :-1]])
            yield from _equal(part, firsts)
            part = part[:, firsts]
            yield from _members(part[:, 1:], _mixed(part[0, 1:].view(np.uint64)))
            large = part[:, -1:] if not rows.shape[1] else None
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
            held = None
        if not rows.shape[1]:
            continue
        # the last key may go on in the next batch: all but one row of each of its digests can go already
        cut = np.flatnonzero(np.diff(rows[0]))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        done, held = rows[:, :cut], rows[:, cut:]
        if cut:
            yield from _buckets(done)
        firsts = np.concatenate([[True], held[2, 1:] != held[2, :-1]])
        if not firsts.all():
            yield from _equal(held, firsts)
            held = held[:, firsts]
        if held.shape[1] > HELD:
            yield from _members(held, _mixed(held[0].view(np.uint64)))
            held, large = None, held[:, -1:]
    if held is not None and held.shape[1]:
        yield from _buckets(held)


def _members(rows, sig):
    if rows.shape[1]:
        nil = pa.nulls(rows.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([nil, nil, pa.array(sig.view(np.int64)), pa.array(rows[1]), pa.array(rows[2])], schema=_FOUND)


def _equal(rows, firsts):
    rep = rows[1][firsts][np.cumsum(firsts) - 1]
    more = ~firsts & (rows[3] == 0)
    if more.any():
        nil = pa.nulls(int(more.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rep[more]), pa.array(rows[1][more]), nil, nil, nil], schema=_FOUND)


def _buckets(rows):
    key_first = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])
    firsts = key_first | np.concatenate([[True], rows[2, 1:] != rows[2, :-1]])
    yield from _equal(rows, firsts)
    rows, key_first = rows[:, firsts], key_first[firsts]
    at = np.flatnonzero(key_first)
    count = np.diff(np.concatenate([at, [rows.shape[1]]]))
    of = np.cumsum(key_first) - 1
    sig = np.add.reduceat(_mixed(rows[1].view(np.uint64)), at)[of].view(np.int64)
    more = count[of] > 1
    yield from _members(rows[:, more], sig[more])


def _shingles(batches):
    """(uid, shingles) of wanted passages and paragraphs: rows (text, numbers, digests, uids)."""
    schema = pa.schema([("uid", pa.int64()), ("load", pa.binary())])
    for batch in batches:
        texts = batch.column(0)
        wanted = [c.to_pylist() for c in batch.columns[1:]]
        sizes = [len(x) for x in _utf8(texts)]
        for s, e in slices([range(k) for k in sizes], _SLICE):
            got = segments(_utf8(texts.slice(s, e - s)))
            first = np.searchsorted(got["doc"], np.arange(e - s + 1))
            at = np.searchsorted(got["of"], np.arange(len(got["doc"]) + 1))
            p_at = np.searchsorted(got["p_of"], np.arange(len(got["p_first"]) + 1))
            uids, loads = [], []
            for i in range(s, e):
                for number, digest, uid in zip(*(w[i] for w in wanted)):
                    k = first[i - s] + number
                    # rows that repeat an id: the digest tells whose passage it is
                    if uid >= 0 and k < first[i - s + 1] and int(got["digest"][k].view(np.int64)) == digest:
                        uids.append(uid)
                        loads.append(np.unique(got["shingle"][at[k] : at[k + 1]]).tobytes())
                    if uid < 0 and k < first[i - s + 1]:
                        p = np.searchsorted(got["p_first"], k)
                        if p < len(got["p_first"]) and got["p_first"][p] == k and int(got["p_digest"][p].view(np.int64)) == digest:
                            uids.append(uid)
                            loads.append(np.unique(got["p_shingle"][p_at[p] : p_at[p + 1]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(loads, pa.binary())], schema=schema)


def jaccard_forest(similar: float):
    """A spanning forest of the links of a bucket: sets of shingles with a Jaccard similarity of `similar` or more."""

    def link(ids: np.ndarray, parts: list) -> list:
        sets = [np.frombuffer(x, np.uint64) for p in parts for x in p.to_pylist()]
        if len(sets) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            return [(0, 1)] if both >= similar * (len(sets[0]) + len(sets[1]) - both) else []
        size = np.array([len(x) for x in sets])
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        edges, rest = [], np.ones(len(sets), bool)
        for root in range(len(sets)):
            if not rest[root]:
                continue
            rest[root] = False
            front = [root]
            while front and rest.any():
                i = front.pop()
                a, b = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                owners = np.concatenate([of[x:y] for x, y in zip(a, b)])
                both = np.bincount(owners, minlength=len(sets))
                near = np.flatnonzero(rest & (both >= similar * (size + size[i] - both)))
                rest[near] = False
                edges += [(i, int(j)) for j in near]
                front += near.tolist()
        return edges

    return link


def _first_uid(uid: str):
    """The uid of a passage, or of a paragraph's first passage."""
    return F.when(F.col(uid) < 0, F.bitwise_not(F.col(uid))).otherwise(F.col(uid))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, least_words: int = REPEAT_WORDS, bucket_limit: int = 20_000) -> DataFrame:
    """(doc_id, start, end, words, component_id, kept_doc_id, removed) of each paragraph, and each passage inside one, that
    stands elsewhere too.

    Paragraphs are linked with paragraphs, and passages with passages, at a Jaccard similarity of `similar` or more of
    their five-word shingles; a component is what links reach. It counts if it spans two documents or stands twice in one,
    and a member of it if it stands in a stretch of such paragraphs and passages of least_words or more. The first one by
    (doc_id, start) stays, the others are removed: text[start:end] in code points. Passages of a removed paragraph go with
    it and have no rows; what stays is chosen among the others. A paragraph that stays has rows for those of its passages
    that are removed. Null or empty texts have no passages. Rows with a null id take no part. Rows that repeat an id count
    as one document, in which a place can't be told from its row: what only they share is left alone. An empty table
    gives an empty table. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("doc_id is not null")
    cut = stored(df.mapInArrow(_cut(df.rdd.getNumPartitions()), CUT), "passages")
    band = [F.struct(F.col(f"k{i}").alias("key"), F.lit(i).cast("long").alias("band")) for i in range(PARAGRAPH_BANDS)]
    keys = F.explode(F.when(F.col("uid") < 0, F.array(*band)).otherwise(F.array(*band[:BANDS]))).alias("x")
    rows = cut.where("uid = local").select(keys, "uid", "digest").select("x.key", "uid", "digest", "x.band")
    found = stored(rows.repartition(parts, "key").sortWithinPartitions("key", "digest", "uid").mapInArrow(_grouped, FOUND), "passage-buckets")
    equal = found.where("rep is not null").select("rep", "uid")

    # different ones that share a band: their shingles come from the documents once more
    met = stored(found.where("sig is not null").select("sig", "member", "digest").distinct(), "passage-candidates")
    numbers = cut.where("uid >= 0").select(F.shiftright("uid", PASSAGE_BITS).alias("row"), "doc_id").distinct()
    wanted = met.select("member", "digest").distinct().withColumn("row", F.shiftright(_first_uid("member"), PASSAGE_BITS))
    wanted = wanted.join(numbers, "row").groupBy("doc_id").agg(F.collect_list(F.struct(_first_uid("member").bitwiseAND((1 << PASSAGE_BITS) - 1).alias("n"), F.col("digest").alias("d"), F.col("member").alias("u"))).alias("w"))
    texts = df.join(wanted, "doc_id").select("text", F.col("w.n").alias("n"), F.col("w.d").alias("d"), F.col("w.u").alias("u"))
    loads = stored(texts.mapInArrow(_shingles, "uid long, load binary").dropDuplicates(["uid"]), "passage-shingles")
    near = bucket_links(met.join(loads, met.member == loads.uid).select("sig", "member", "load"), jaccard_forest(similar), bucket_limit, "passage-links")
    roots = connected_components(near.distinct())

    # passage -> first equal one of its batch -> first equal one of all -> root of its component
    reps = equal.select("uid", "rep").unionByName(equal.select(F.col("rep").alias("uid"), "rep").distinct())
    tied = reps.join(roots, reps.rep == roots.node, "left").select(F.col("uid").alias("node"), F.coalesce("root", "rep").alias("root"))
    tied = stored(tied.unionByName(roots.join(reps, roots.node == reps.uid, "left_anti")).distinct(), "passage-roots")
    own = cut.drop("digest", *[f"k{i}" for i in range(BANDS)])
    member = own.join(tied, own.local == tied.node, "left").where("root is not null or many")
    member = stored(member.select("uid", "doc_id", "start", "end", "words", "parts", F.coalesce("root", "local").alias("component_id")), "passage-members")
    first, row = F.struct("doc_id", "start", "uid"), F.shiftright(_first_uid("uid"), PASSAGE_BITS)
    sets = member.groupBy("component_id").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"), *[f(x).alias(k) for x, k in (("doc_id", "doc"), (row, "row")) for f, k in ((F.min, k + "_a"), (F.max, k + "_b"))])
    sets = stored(sets.where("doc_a < doc_b or n > 1 and row_a = row_b").select(F.col("component_id").alias("c"), "first"), "passage-sets")
    shared = member.join(sets, F.col("component_id") == F.col("c")).drop("c").withColumns({"row": row, "lo": _first_uid("uid"), "whole": F.col("uid") < 0})
    shared = shared.withColumn("hi", F.col("lo") + F.col("parts"))
    # stretches of neighbours; a paragraph comes before its passages, which add no words to it
    order = W.partitionBy("row").orderBy("lo", F.desc("whole"))
    shared = shared.withColumn("reach", F.coalesce(F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)))
    shared = shared.withColumn("stretch", F.sum((F.col("lo") > F.col("reach")).cast("int")).over(order))
    shared = shared.withColumn("total", F.sum(F.when(F.col("lo") >= F.col("reach"), F.col("words"))).over(W.partitionBy("row", "stretch"))).where(F.col("total") >= least_words)
    # passages of paragraphs that are found, and of those that are removed
    found = F.max(F.when(F.col("whole"), F.col("hi"))).over(order)
    gone = F.max(F.when(F.col("whole") & (F.col("uid") != F.col("first.uid")), F.col("hi"))).over(order)
    shared = shared.withColumns({"inside": ~F.col("whole") & F.coalesce(found > F.col("lo"), F.lit(False)), "gone": ~F.col("whole") & F.coalesce(gone > F.col("lo"), F.lit(False))})
    shared = stored(shared.select("uid", "doc_id", "start", "end", "words", "component_id", "first", "inside", "gone"), "passage-stretches")
    # where a component's first passage goes with its paragraph, the first of those that don't stays instead
    went = shared.where("gone").select("uid")
    lost = stored(shared.where("gone and uid = first.uid").select(F.col("component_id").alias("c")), "passage-lost")
    left = member.join(lost, F.col("component_id") == F.col("c"), "left_semi").join(went, "uid", "left_anti")
    left = stored(left.groupBy(F.col("component_id").alias("c")).agg(F.min(first).alias("next")), "passage-kept")
    out = shared.where("not gone").join(left, F.col("component_id") == F.col("c"), "left").withColumn("first", F.coalesce("next", "first"))
    out = out.withColumn("removed", F.col("uid") != F.col("first.uid")).where("removed or not inside")
    return out.select("doc_id", "start", "end", F.col("words").cast("long").alias("words"), "component_id", F.col("first.doc_id").alias("kept_doc_id"), "removed")
