"""Packing documents into token sequences: best fit first, then a local search by swaps."""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import once, slices, stored

TOKENIZER = "word_bpe_49k.json"
#: Pieces that one task packs together, and the fill below which sequences are packed once more.
GROUP_PIECES, EMPTIER = 4096, 0.985
#: Steps of a group's search in which no sequence is saved, after which it ends.
SEARCH_STEPS = 2000
_MAX_CHUNKS, _SIGNS = 300_000, ".,;:!?*&$#%|"
#: Bytes of text that are split at once, and chunks whose ids are put together at once.
_SLICE, _RUN = 12_000_000, 500_000
#: What a special token begins with, and combining marks.
_CASED = r"<\||[\x{300}-\x{37f}]"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Chunks:
    """Token ids of texts, by chunks between ASCII white space: this tokenizer's tokens never reach over white space and
    don't depend on what is beyond it, so each distinct chunk is encoded once for as long as it is held."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Encode the chunks that aren't held yet. Of two tables the older one goes when the newer one is full, so that
        frequent chunks stay."""
        if len(self.ids) > _MAX_CHUNKS:
            self.ids, self.old = {}, self.ids
        known, old = self.ids, self.old
        # behind a letter that no normalisation joins to a sign, closing signs are tokens of their own
        whole, split = [], []
        for x in chunks:
            if x not in known:
                if x in old:
                    known[x] = old[x]
                    continue
                word = x.rstrip(_SIGNS)
                if 0 < len(word) < len(x) and (c := word[-1]) < "\u0250" and c.isalpha() and len(c.lower()) == 1:
                    split.append((x, word, x[len(word) :]))
                    whole += split[-1][1:]
                else:
                    whole.append(x)
        new = []
        for x in set(whole):
            if x in old:
                known[x] = old[x]
            elif x not in known:
                new.append(x)
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            known.update(zip(some, (array("I", e.ids).tobytes() for e in self.encode(some, add_special_tokens=False))))
        known.update((x, known[word] + known[signs]) for x, word, signs in split)

    def encoded(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, each closed by `end`, and where each text's ids end. Null is empty."""
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "").view(pa.string())
        # the vocabulary is of lower case: only a special token's own text, and capitals before a combining mark, which
        # compose to other letters than small ones do, must keep their case
        small = pc.if_else(pc.match_substring_regex(texts, _CASED), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(small)
        found = lists.values.dictionary_encode()
        chunks = [x.decode("utf-8", "replace") for x in found.dictionary.view(pa.binary()).to_pylist()]
        self._learn(chunks)
        known = list(map(self.ids.__getitem__, chunks))
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        known.append(np.array([end], "<u4").tobytes())
        flat = np.frombuffer(b"".join(known), "<u4")
        # after each text's chunks comes one more, which is the end id
        bounds = lists.offsets.to_numpy().astype(np.int64)
        word = np.insert(found.indices.to_numpy(), bounds[1:], len(size))
        size = np.append(size, 1)
        first = np.cumsum(size) - size
        out = [flat[:0]]
        for s in range(0, len(word), _RUN):
            w = word[s : s + _RUN]
            n = size[w]
            out.append(flat[np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return np.concatenate(out), np.cumsum(size[word])[bounds[1:] + np.arange(len(texts))]


_PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])


def _cut(name: str, size: int, end: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunks = once(("chunks", name), lambda: Chunks(name if "/" in name else tokenizer_path(name)))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for s, e in _byte_slices(texts):
                out = ([], [], [], [], [])
                data, ends = chunks.encoded(texts.slice(s, e - s), end)
                data, begin = memoryview(data).cast("B"), 0
                for doc, stop in zip(ids[s:e], ends.tolist()):
                    for k, at in enumerate(range(begin, stop, size)):
                        last = min(at + size, stop)
                        for column, v in zip(out, (doc, k, at - begin, last - at, zlib.crc32(data[4 * at : 4 * last]))):
                            column.append(v)
                    begin = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES)], schema=_PIECES)

    return run


def _byte_slices(texts: pa.Array):
    sizes = pc.binary_length(texts).fill_null(0).to_pylist()
    return slices([range(n) for n in sizes], _SLICE)


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, size: int = 2048, end: int = 0) -> DataFrame:
    """(id, piece, start, length, crc): the documents' ids, each document closed by `end` and cut only where longer than size."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return df.mapInArrow(_cut(tokenizer, size, end), "id long, piece int, start long, length long, crc long")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set if some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def swap_search(bins: list[list[int]], lengths: list[int], size: int, steps: int = SEARCH_STEPS) -> list[list[int]]:
    """Exchange items between underfull bins, as long as bins can be saved, so that the sum of squared fills grows.

    A step takes one bin and the best exchange that it has with any other underfull one: none, one or two of its items
    for none or one of the other's. Which of the two gets fuller is open, so moves, one for one and two for one are
    tried in both directions. The sum grows with every step, so the search ends: when no bin has an exchange left, when
    there are as few bins as the items' total allows, or after `steps` steps without a bin saved (the bound of its work).
    """
    least = -(-sum(lengths) // size)
    long = np.array(lengths, np.int64)
    of = np.empty(len(long), np.int64)
    for b, items in enumerate(bins):
        of[items] = b
    fill = np.bincount(of, long, len(bins)).astype(np.int64)
    used = len(bins)
    idle = 0
    while used > least:
        live = np.flatnonzero((fill > 0) & (fill < size))
        changed = False
        items = np.flatnonzero((fill[of] > 0) & (fill[of] < size))
        # items that are None of another bin: a pure move; one place for each live bin
        for a in live[np.argsort(fill[live], kind="stable")]:
            while 0 < fill[a] < size and idle < steps:
                idle += 1
                mine = items[of[items] == a]
                give, sums = _sets(mine, long)
                # what the other bin gives: one of its items, or nothing
                at = np.concatenate([of[items], live])
                take = np.concatenate([long[items], np.zeros(len(live), np.int64)])
                d = take[None, :] - sums[:, None]  # what bin a gains
                there = fill[at]
                fits = np.where(d > 0, fill[a] + d <= size, there[None, :] - d <= size) & (at != a) & (there > 0)
                gain = np.where(fits & (d != 0), d * (fill[a] - there[None, :] + d), 0)
                k = int(gain.argmax())
                if gain.flat[k] <= 0:
                    break
                g, t = divmod(k, len(at))
                b, change = at[t], d[g, t]
                of[give[g]] = b
                if t < len(items):
                    of[items[t]] = a
                fill[a] += change
                fill[b] -= change
                changed = True
                for c in (a, b):
                    if fill[c] == 0:
                        used, idle = used - 1, 0
                if used <= least:
                    break
            if used <= least or idle >= steps:
                break
        if not changed or idle >= steps:
            break
    out: list[list[int]] = [[] for _ in bins]
    for i, b in enumerate(of.tolist()):
        out[b].append(i)
    return [x for x in out if x]


def _sets(mine: np.ndarray, long: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """Nothing, one and two of the items, one choice for each sum of lengths, and the sums."""
    each: dict[int, list[int]] = {0: []}
    for i in mine.tolist():
        each.setdefault(int(long[i]), [i])
    for x, i in enumerate(mine.tolist()):
        for j in mine[x + 1 :].tolist():
            each.setdefault(int(long[i] + long[j]), [i, j])
    return list(each.values()), np.array(list(each), np.int64)


def pack(lengths: list[int], size: int) -> list[list[int]]:
    return swap_search(best_fit(lengths, size), lengths, size)


def _packer(size: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece", "row"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        seq, off, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for b, items in enumerate(pack(lengths, size)):
            at = 0
            for i in items:
                seq[i], off[i] = b, at
                at += lengths[i]
            fill[items] = at
        return pdf.assign(seq=(int(key[0]) << 20) + seq, offset=off, fill=fill)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, size: int = 2048, end: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(id, piece, start, length, crc, sequence_id, offset) of every piece; sequences hold at most `size` tokens.

    Pieces are dealt by hash to groups of about group_pieces, each of which one task packs by best fit and swap search;
    the pieces of the emptier sequences are then dealt out and packed once more, in groups of the same size. Whole pieces
    fill a sequence by themselves.
    Null text is empty: its document is the end id alone. Documents with a null id, and rows that repeat one, are packed
    as documents of their own. An empty table gives an empty table. Other columns are not read.
    """
    cut = stored(pieces(docs, id_col, text_col, tokenizer, size, end).withColumn("row", F.monotonically_increasing_id()), "pieces")
    part = cut.where(F.col("length") < size)
    out = "id long, piece int, start long, length long, crc long, row long, g long, seq long, offset long, fill long"
    cols = ["id", "piece", "start", "length", "crc", "row"]

    def packed(rows: DataFrame, salt: int) -> DataFrame:
        groups = max(1, -(-rows.count() // group_pieces))
        dealt = rows.select(*cols, F.pmod(F.xxhash64(F.lit(salt), "id", "piece", "row"), F.lit(groups)).alias("g"))
        return dealt.groupBy("g").applyInPandas(_packer(size), out)

    once_packed = stored(packed(part, 0), "packed")
    full = F.col("fill") >= F.lit(int(EMPTIER * size))
    again = packed(once_packed.where(~full), 1)
    keep = [*cols[:-1], "sequence_id", "offset"]
    whole = cut.where(F.col("length") == size).select(*cols[:-1], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = once_packed.where(full).select(*cols[:-1], (F.col("seq") * 2).alias("sequence_id"), "offset")
    last = again.select(*cols[:-1], (F.col("seq") * 2 + 1).alias("sequence_id"), "offset")
    return whole.unionByName(first).unionByName(last).select(*keep)
