"""SimHash near-duplicates: fingerprints that differ in few bits share blocks, which a join finds without losing any."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.buckets import bucket_links
from tidemark.llm.common import arrow_batch, slices, stored
from tidemark.llm.components import connected_components

BITS = 64


def fingerprint_of(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, as a signed long; 0 where there are no words.

    Words are runs without ASCII white space, A-Z in lower case. Each shingle of that many words, repeats included,
    votes with its XXH64; a bit is 1 if it is set in over half of them. Fewer words: the whole sequence is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, seed)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist())], dtype=np.uint64)
    set_in = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 4096):
        part = np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * set_in > len(h), bitorder="little").view(np.int64)[0])


_FP = pa.schema([("id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint_of(x.as_py(), shingle, seed) for x in texts], pa.int64())], schema=_FP)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) of every row. Null text counts as empty and gives fp 0."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints(shingle, seed), "id long, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of blocks that two fingerprints within `distance` must share: that many differing bits spoil as many blocks
    at most, so some choice of blocks - distance of them is equal."""
    if not 0 <= distance < blocks <= BITS:
        raise ValueError("blocks must be more than the distance, and 64 at most")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(one, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hamming_forest(distance: int):
    def link(ids: np.ndarray, parts: list) -> list:
        fps = np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts]).view(np.uint64)
        if len(fps) == 2:
            return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= distance else []
        edges, rest = [], np.arange(len(fps))
        while len(rest):
            front, rest = [int(rest[0])], rest[1:]
            while front and len(rest):
                i = front.pop()
                near = np.bitwise_count(fps[rest] ^ fps[i]) <= distance
                if near.any():
                    got = rest[near].tolist()
                    edges += [(i, j) for j in got]
                    front += got
                    rest = rest[~near]
        return edges

    return link


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, distance: int = 4, blocks: int = 7, bucket_limit: int = 20_000) -> DataFrame:
    """(id, fp, component_id) of every row of docs; fingerprints within `distance` bits are linked.

    component_id is the smallest id that links reach from the row, itself included. Texts with equal fingerprints are
    one node, so copies are never paired with each other. Null or empty texts have fingerprint 0 and are linked like
    any other. Rows with a null id get their fingerprint, link nothing and have a null component_id. Repeated rows are
    returned as often as they came. An empty table gives an empty table. Other columns of docs are not read.
    """
    each = stored(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    nodes = stored(each.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")), "simhash-nodes")
    masks = block_masks(distance, blocks)
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for i, m in enumerate(masks)]))
    links = bucket_links(nodes.select(keys.alias("key"), "id", "fp"), _hamming_forest(distance), bucket_limit, "simhash-links")
    roots = connected_components(links.distinct())
    of = nodes.join(roots, nodes.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    of = stored(of, "simhash-components")
    out = each.join(of, "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
