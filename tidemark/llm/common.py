"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import new_folder, stored  # noqa: F401

#: Documents of an Arrow batch are handled in slices of about so many characters, which bounds a task's Python memory.
SLICE_CHARS = 2_000_000
#: A worker's table of known words is emptied when it holds more than this.
MAX_WORDS = 400_000
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of the contracts: any run without these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def crc_mod(id_col: str, m: int):
    """crc32(id as text) mod m; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m


def hashed_sample(df: DataFrame, order, rows: int) -> DataFrame:
    """At most `rows` rows, the same ones whenever it is called: those with the smallest hash of `order`."""
    return df.withColumn("_h", F.xxhash64(order)).orderBy("_h", order).limit(rows).drop("_h")


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold about `limit` characters together, one text at least."""
    start = total = 0
    for i, x in enumerate(texts):
        total += len(x) if x else 0
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class WordTable:
    """Rows of numbers for words, computed once for each word that a Python worker meets.

    `rows(words)` gives a 2-D array for a list of new words. Memory is bounded: the table is emptied beyond MAX_WORDS.
    """

    def __init__(self, rows, width: int, dtype=np.float32):
        self.make, self.width, self.dtype = rows, width, dtype
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.data = np.zeros((1024, self.width), self.dtype)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words; valid until clear() is called."""
        new = [w for w in set(words) if w not in self.ids]
        if new:
            n = len(self.ids)
            if n + len(new) > len(self.data):
                self.data = np.concatenate([self.data[:n], np.zeros((max(n, len(new)) + 1024, self.width), self.dtype)])
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.data[n + i : n + i + len(part)] = self.make(part)
            self.ids.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def trim(self, most: int = MAX_WORDS) -> None:
        if len(self.ids) > most:
            self.clear()


def codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words as a matrix, padded with 0 and cut at `width`: the table of words only, not of texts."""
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)


def arrow_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_cache: dict = {}


def once(key, make):
    """make() once for each Python worker and key. One entry is held: what an earlier stage of a pipeline needed goes."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = make()
    return _cache[key]
