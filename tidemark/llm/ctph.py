"""Document fingerprints by context-triggered piecewise hashing, and their likeness by edit distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: Bytes of the rolling window, the smallest block size as a power of two, signature length at most, blocks in a text at
#: most, block sizes in a chunk at most, and the run of signature characters that two texts must share before they count
#: as alike at all (less by one below 24 characters, and by another below 8: chance matches stay under one in a hundred).
WINDOW, LEAST, SIGNATURE, CHUNKS, LONGEST, RUN = 7, 2, 64, 48, 4, 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SLICE = 500_000


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables = (_powers(_BASE, 1), _powers(_INVERSE, 1))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if len(_tables[0]) < n:
        _tables = (_powers(_BASE, n), _powers(_INVERSE, n))
    return _tables


def signatures(texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
    """(level, signature, signature at twice the block size) of each text; the block size is 2 ** level.

    A rolling hash over WINDOW bytes ends a chunk where its low bits are all ones; the block size follows from the
    text's length. Each chunk gives one character and the last one covers what is left, so whole texts count.
    """
    n = len(texts)
    lens = np.fromiter(map(len, texts), np.int64, n)
    gap = b"\0" * WINDOW
    data = np.frombuffer(gap + gap.join(texts) + b"\0", np.uint8).astype(np.uint64)
    begin = np.cumsum(lens + WINDOW) - lens  # place of each text's first byte
    end = begin + lens
    roll = np.zeros(len(data), np.uint32)
    for j in range(WINDOW):
        roll[j:] += data[: len(data) - j].astype(np.uint32) * np.uint32(pow(0x01000193, j + 1, 1 << 32))
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    # the smallest level whose blocks cut a text of this length into about 24 to 48 chunks
    level = np.maximum(LEAST, np.ceil(np.log2(np.maximum(lens, 1) / CHUNKS)).astype(np.int64))
    at = np.flatnonzero((roll & np.uint32((1 << LEAST) - 1)) == (1 << LEAST) - 1)
    doc = np.searchsorted(end, at, side="right")
    ok = doc < n
    at, doc = at[ok], doc[ok]
    ok = at >= begin[doc]
    at, doc = at[ok], doc[ok]
    h = roll[at]
    ones = np.bitwise_count((h ^ (h + np.uint32(1))) >> np.uint32(1)).astype(np.int64)
    up, down = _grown(len(data))
    total = np.cumsum((data + np.uint64(1)) * up[: len(data)])

    def signed(extra: int) -> list[bytes]:
        cut = ones >= level[doc] + extra
        # a chunk ends behind each boundary and at the end of the text
        stop = np.concatenate([at[cut] + 1, end])
        of = np.concatenate([doc[cut], np.arange(n)])
        order = np.lexsort((stop, of))
        stop, of = stop[order], of[order]
        first = np.concatenate([[True], of[1:] != of[:-1]])
        start = np.where(first, begin[of], np.concatenate([[0], stop[:-1]]))
        full = stop > start
        stop, of, start = stop[full], of[full], start[full]
        # and after LONGEST block sizes without a boundary, as in repetitive text
        most = LONGEST << (level[of] + extra)
        times = -(-(stop - start) // most)
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        of, most = np.repeat(of, times), np.repeat(most, times)
        start = np.repeat(start, times) + k * most
        stop = np.minimum(start + most, np.repeat(stop, times))
        # the last character of a full signature stands for the whole rest
        count = np.bincount(of, minlength=n)
        place = np.arange(len(of)) - (np.cumsum(count) - count)[of]
        stop = np.where(place == SIGNATURE - 1, end[of], stop)
        here = place < SIGNATURE
        of, start, stop = of[here], start[here], stop[here]
        value = (total[stop - 1] - total[start - 1]) * down[start]
        value = (value ^ (value >> np.uint64(29))) * _MIX
        chars = ALPHABET[(value >> np.uint64(58)).astype(np.int64)].tobytes()
        bounds = np.concatenate([[0], np.cumsum(np.minimum(count, SIGNATURE))]).tolist()
        return [chars[s:e] for s, e in zip(bounds, bounds[1:])]

    return list(zip(level.tolist(), signed(0), signed(1)))


def written(sig: tuple[int, bytes, bytes]) -> str:
    return f"{1 << sig[0]}:{sig[1].decode()}:{sig[2].decode()}"


def read(fingerprint: str) -> tuple[int, bytes, bytes]:
    size, one, two = fingerprint.split(":")
    return int(size).bit_length() - 1, one.encode(), two.encode()


def _matrix(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(sigs, f"S{SIGNATURE}").view(np.uint8).reshape(-1, SIGNATURE), np.fromiter(map(len, sigs), np.int64, len(sigs))


def _alike(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """1 - (insertions and deletions that turn a into b) / (both lengths), or 0 where they share no run of characters."""
    if not a:
        return np.zeros(0)
    (x, nx), (y, ny) = _matrix(a), _matrix(b)
    weights = np.uint64(1) << np.arange(SIGNATURE, dtype=np.uint64)
    inside = np.arange(SIGNATURE) < nx[:, None]
    # longest common subsequence, all pairs of texts at once, a bit for each character of a
    v = np.full(len(a), ~np.uint64(0))
    for j in range(int(ny.max(initial=0))):
        match = ((x == y[:, j : j + 1]) & inside) @ weights
        u = v & match
        v = np.where(j < ny, (v + u) | (v - u), v)
    common = np.bitwise_count(~v).astype(np.int64)
    near = 2 * common / np.maximum(nx + ny, 1)
    shorter = np.minimum(nx, ny)
    run = np.minimum(shorter, RUN - (shorter < 24) - (shorter < 8))
    shared = np.zeros(len(a), bool)
    for r in range(1, RUN + 1):
        rows = np.flatnonzero(run == r)
        if len(rows):
            gx, gy = (sum(m[rows, i : SIGNATURE - r + 1 + i].astype(np.uint32) << np.uint32(8 * i) for i in range(r)) for m in (x, y))
            fx, fy = (np.arange(SIGNATURE - r + 1) <= m[rows, None] - r for m in (nx, ny))
            gx, gy = np.where(fx, gx, 0), np.where(fy, gy, 1)
            for j in range(gy.shape[1]):
                shared[rows] |= (gx == gy[:, j : j + 1]).any(axis=1)
    return np.where(shared, near, 0.0)


def likeness(pairs: list[tuple]) -> np.ndarray:
    """Likeness (0 to 1) of pairs of signatures: at the same block size, or one at twice the other's; else 0. Equal ones: 1."""
    out = np.zeros(len(pairs))
    jobs: tuple[list, list, list] = ([], [], [])
    for i, (p, q) in enumerate(pairs):
        if p == q:
            out[i] = 1.0
            continue
        sides = [(p[1], q[1]), (p[2], q[2])] if p[0] == q[0] else [(p[1], q[2])] if p[0] == q[0] + 1 else [(p[2], q[1])] if p[0] + 1 == q[0] else []
        for s, t in sides:
            if s and t:
                for job, v in zip(jobs, (i, s, t)):
                    job.append(v)
    for s in range(0, len(jobs[0]), 8192):
        np.maximum.at(out, jobs[0][s : s + 8192], _alike(jobs[1][s : s + 8192], jobs[2][s : s + 8192]))
    return out


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _utf8(x: str) -> bytes:
    return x.encode("utf-8", "surrogatepass")


def _compared(batches):
    """Rows of (bucket, id, text, extra) in order; extra rows stand for the document behind a bucket's last one."""
    held = None  # bucket, id, text, signature of the row before
    for batch in batches:
        buckets, ids, texts, extra = (c.to_pylist() for c in batch.columns)
        for s, e in slices(texts, _SLICE):
            part = [x or "" for x in texts[s:e]]
            rows = list(zip(buckets[s:e], ids[s:e], part, signatures([_utf8(x) for x in part]), extra[s:e]))
            pairs = []
            for row in rows:
                if held is not None and held[0] == row[0]:
                    pairs.append((held, row))
                held = None if row[4] else row
            edits = [_utf8(edited_text(a[2], b[2])) for a, b in pairs]
            if not edits:
                continue
            marks = signatures(edits)
            near = likeness([(a[3], m) for (a, _), m in zip(pairs, marks)] + [(a[3], b[3]) for a, b in pairs])
            n = len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((
                [a[1] for a, _ in pairs], [len(a[2]) for a, _ in pairs], [hashlib.sha256(x).hexdigest() for x in edits],
                [written(a[3]) for a, _ in pairs], [written(m) for m in marks], near[:n], near[n:]), _OUT)], schema=_OUT)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness, and that to the next document's (see OUT).

    Documents stand in ascending order of id (null ids last, rows that repeat an id by text); the next of the last one
    is the first. Null text is empty. One document is its own next. An empty table gives an empty table. Texts are
    shuffled once, to sorted ranges of ids; only each range's first document is read a second time, for the range before.
    Other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cuts = sorted(set(df.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts))) or [0.0]
    dealt = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="x", outputCol="bucket", handleInvalid="keep").transform(df.withColumn("x", F.col("id").cast("double")))
    dealt = dealt.select(F.col("bucket").cast("int").alias("bucket"), "id", "text", F.lit(0).alias("extra"))
    firsts = dealt.groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()  # a row for each range
    if not firsts:
        return spark.createDataFrame([], OUT)
    follow = [(firsts[(i + 1) % len(firsts)]["id"], r["bucket"]) for i, r in enumerate(firsts)]
    wanted = F.broadcast(spark.createDataFrame(follow, "first long, before int"))
    known = [r for r, _ in follow if r is not None]
    heads = dealt.where(F.col("id").isin(known) | (F.col("id").isNull() if len(known) < len(follow) else F.lit(False)))
    heads = heads.groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).join(wanted, F.col("id").eqNullSafe(F.col("first")))
    rows = dealt.unionByName(heads.select(F.col("before").alias("bucket"), "id", "text", F.lit(1).alias("extra")))
    rows = rows.repartitionById(len(cuts) + 2, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.col("id").asc_nulls_last(), F.coalesce("text", F.lit("")))
    return rows.mapInArrow(_compared, OUT)
