"""Periodic runs of words: Lyndon arrays from the grouping phase of Baier's suffix sorter, extended into runs.

The grouping phase puts each suffix into the group of its longest Lyndon prefix, so it yields the Lyndon array without
a suffix array. It is done for an order of the words and for the reversed order; each run has a Lyndon root in one of
the two, and longest common extensions of the root to both sides give the run (Bannai et al., 2017; Baier, 2016).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, crc_mod, slices


def lyndon_array(s: list[int]) -> list[int]:
    """For each place of s, the length of the longest Lyndon word that begins there (a prefix of a word is smaller).

    Groups are worked on from the highest down. Each member of a group looks for the nearest place before it that is
    in a lower group; a place found by l members continues its own word with l words of that group, and moves to a new
    group just above the one it was in, above those found less often.
    """
    n = len(s)
    found = [1] * n
    members: list[list[int]] = []
    below: list[int] = []
    above: list[int] = []
    rank = {v: k for k, v in enumerate(sorted(set(s)))}
    group = [rank[v] for v in s]
    for k in range(len(rank)):
        members.append([])
        below.append(k - 1)
        above.append(k + 1)
    for i, g in enumerate(group):
        members[g].append(i)
    top = len(rank) - 1
    if top >= 0:
        above[top] = -1
    left = list(range(-1, n - 1))  # the next place to the left to look at; all between are in higher groups
    now = top
    while now >= 0:
        counts: dict[int, int] = {}
        own = [i for i in members[now] if group[i] == now]
        for i in own:
            group[i] = -1
        for i in own:
            j = left[i]
            path = [i]
            while j >= 0 and group[j] < 0:
                path.append(j)
                j = left[j]
            for k in path:
                left[k] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        if counts:
            length = found[own[0]]
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in counts.items():
                found[j] += times * length
                moved.setdefault((-times, group[j]), []).append(j)
            for (_, old), places in sorted(moved.items()):
                new = len(members)
                members.append(places)
                below.append(old)
                above.append(up := above[old])
                above[old] = new
                if up >= 0:
                    below[up] = new
                for j in places:
                    group[j] = new
        members[now] = []
        now = below[now]
    return found


def _common(x: bytes, a: int, b: int, most: int, width: int) -> int:
    """How many symbols of `width` bytes, `most` at most, are equal from places a and b on."""
    done, step = 0, 8
    while done < most:
        k = min(step, most - done)
        if x[(a + done) * width : (a + done + k) * width] == x[(b + done) * width : (b + done + k) * width]:
            done += k
            step *= 2
        elif k == 1:
            break
        else:
            most = done + k - 1
            step = max(1, k // 2)
    return done


def runs_of(s: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of s that is long enough, by start and period; min_exponent is 2 at least.

    A run is a stretch that keeps its smallest period and can't be extended. Roots of an order are looked at only where
    the word repeats min_exponent - 2 times more, as the first root of a long enough run does.
    """
    n, width = len(s), 4
    s = s.astype(np.uint32)
    ahead, back = s.tobytes(), s[::-1].tobytes()
    found = set()
    for order in (s.tolist(), (s.max(initial=0) - s).tolist()):
        length = np.array(lyndon_array(order), dtype=np.int64)
        at = np.flatnonzero(np.arange(n) + length * (min_exponent - 1) <= n)
        for k in range(1, min_exponent - 1):
            at = at[s[at] == s[at + k * length[at]]]
        last: dict[int, int] = {}  # by period, the end of the run that was found last
        for i, p in zip(at.tolist(), length[at].tolist()):
            if i + p <= last.get(p, -1):
                continue  # inside a run that is known
            end = i + p + _common(ahead, i, i + p, n - i - p, width)
            start = i - _common(back, n - i, n - i - p, i, width)
            last[p] = end
            if end - start >= max(min_length, min_exponent * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _pieces(ids: np.ndarray, doc: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Bounds of the stretches in which runs can be, for words `ids` of documents `doc` put end to end.

    All words of a run stand min_exponent times in it. So a word that a stretch holds less often than that is in no
    run of it, and cuts it; what is left is cut again until nothing changes. No run is lost or shortened.
    """
    at, piece = np.arange(len(ids)), doc
    while len(at):
        _, key, counts = np.unique(piece * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        keep = counts[key] >= min_exponent
        kept, of = at[keep], piece[keep]
        new = np.cumsum(np.concatenate([[0], (np.diff(kept) > 1) | (np.diff(of) > 0)])) if len(kept) else kept
        long_enough = np.bincount(new)[new] >= min_length if len(kept) else new.astype(bool)
        kept, new = kept[long_enough], new[long_enough]
        if len(kept) == len(at):
            break
        at, piece = kept, new
    cuts = np.flatnonzero(np.diff(piece)) + 1
    starts = np.concatenate([[0], cuts]) if len(at) else []
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(starts, [*cuts, len(at)])]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("id", pa.int64()), ("words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _slice(texts: list[bytes], min_length: int, min_exponent: int):
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    table: dict[bytes, int] = {}
    ids = np.fromiter((table.setdefault(w, len(table)) for ws in words for w in ws), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    runs: list[list] = [[] for _ in texts]
    for a, b in _pieces(ids, doc, min_length, min_exponent):
        k = int(doc[a])
        shift = a - int(starts[k])
        _, part = np.unique(ids[a:b], return_inverse=True)
        runs[k] += [(shift + i, n, p) for i, n, p in runs_of(part, min_length, min_exponent)]
    collapsed = []
    for ws, own in zip(words, runs):
        own.sort(key=lambda r: (r[0], r[2]))
        if own:
            keep = np.ones(len(ws), bool)
            for start, n, p in own:
                keep[start + p : start + n] = False
            ws = [ws[i] for i in np.flatnonzero(keep)]
        collapsed.append(b" ".join(ws))
    return sizes, runs, collapsed


def _find(min_length: int, min_exponent: int):
    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                sizes, runs, collapsed = _slice(texts[a:b], min_length, min_exponent)
                rows = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(rows, _OUT.field("runs").type), pa.array(collapsed, pa.binary())], schema=_OUT)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(id, words, runs, collapsed) of every row: its number of words, its runs (start, length, period, in words) by start
    and period, and the text without what repeats: of each run only the first period stays, words joined by one space.

    Words are runs without ASCII white space. Null texts and texts without words have no runs and an empty `collapsed`;
    null ids stay null; repeated rows are returned as often as they came. A text of any length is one row and is worked
    on whole, in memory in proportion to its length. An empty table gives an empty table. Other columns are not read.
    ValueError below min_exponent 2, where runs are not defined.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period twice at least")
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    out = df.mapInArrow(_find(min_length, min_exponent), f"id long, words long, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with the loops that the contract writes into a tenth of the texts: with h = crc32(id as text) and
    g = floor(h / 10), if h % 10 = 0, each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). A null id counts as the empty text; texts without words stay as they are."""
    h = crc_mod(id_col, 1 << 32)
    text = F.col(text_col).cast("string")
    df = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), h.alias("h"))
    # only the texts that are written anew are taken apart
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("words", words)
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    loops = (F.col("h") % 10 == 0) & (n > 0)
    df = df.withColumn("a", F.when(loops, (g % n).cast("int")))
    df = df.withColumn("p", F.when(loops, (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")))
    tail = F.transform(F.sequence(F.lit(0), n - F.col("a") - 1), lambda i: F.get("words", F.col("a") + i % F.col("p")))
    looped = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return df.select("id", F.when(loops, looped).otherwise(F.col("text")).alias("text"))


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def run_digests(found: DataFrame) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of rows of periodic_runs; the
    longest run is shown, of equally long ones the one with the smallest start, then period."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    start, length, period = -best.start, best.length, -best.period
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), hex_sha256(lines).alias("runs_sha256"), hex_sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )
