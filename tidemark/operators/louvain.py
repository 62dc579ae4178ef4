"""Communities by Louvain's method: nodes move inside blocks of the graph, each in one task, then communities become nodes.

A block holds nodes that have a neighbour in common, with all their links, up to a bound; moves inside it are made one
after another, as Louvain does. One shuffle makes a level, whatever the number of moves. When what is left of the graph
fits one block, all further levels are made there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import BUCKET, numbered, unique_pairs
from tidemark.sources.shared import bucketed, stored

#: Links (each in both directions) that one task works on.
BLOCK_LINKS = 1_000_000


def local_moves(src: np.ndarray, dst: np.ndarray, w: np.ndarray, inner: int, total: float, own: np.ndarray, size: np.ndarray, among: int, passes: int = 20, visits: list[int] | None = None) -> np.ndarray:
    """Communities of nodes, of which the first `inner` may move and have all their links here (src), from communities `own`
    with summed degrees `size`. Nodes move in turn, in a fixed random order, to the community of one of the first `among`
    nodes beside them that raises modularity most, of equals the least, until none moves, or for `passes`. After the first
    pass only nodes are looked at again of which a neighbour has moved to another community than theirs; visits: how many in each pass."""
    order = np.argsort(src, kind="stable")
    src, dst, w = src[order], dst[order], w[order]
    ends = np.searchsorted(src, np.arange(inner + 1))
    degree = np.bincount(src, weights=w, minlength=inner).tolist()
    near = [(dst[a:b].tolist(), w[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
    own, size, rng = own.tolist(), size.tolist(), np.random.default_rng(0)
    stale = [True] * inner
    for _ in range(passes):
        moved = 0
        if visits is not None:
            visits.append(sum(stale))
        for i in rng.permutation(inner).tolist():
            if not stale[i]:
                continue
            stale[i] = False
            k, home = degree[i], own[i]
            to: dict[int, float] = {}
            for j, x in zip(*near[i]):
                if j != i and j < among:
                    c = own[j]
                    to[c] = to.get(c, 0.0) + x
            size[home] -= k
            best, gain = home, to.get(home, 0.0) - k * size[home] / total
            for c, x in to.items():
                g = x - k * size[c] / total
                if g > gain + 1e-9 or (best != home and abs(g - gain) <= 1e-9 and c < best):
                    best, gain = c, g
            size[best] += k
            if best != home:
                own[i] = best
                moved += 1
                for j in near[i][0]:
                    if j < inner and own[j] != best:
                        stale[j] = True
        if not moved:
            break
    return np.array(own)


def _quality(src: np.ndarray, dst: np.ndarray, w: np.ndarray, own: np.ndarray, total: float) -> float:
    return w[own[src] == own[dst]].sum() / total - ((np.bincount(own[src], weights=w) / total) ** 2).sum()


def all_levels(src: np.ndarray, dst: np.ndarray, w: np.ndarray, nodes: int, total: float, levels: int, tolerance: float) -> np.ndarray:
    """The community of each node of a whole graph: levels of moves and contraction, then the same again from the
    communities found, in which single nodes can still leave, while modularity rises."""
    of, score = np.arange(nodes), -1.0
    while True:
        new, start = np.arange(nodes), of
        s, d, x, n = src, dst, w, nodes
        for _ in range(levels):
            size = np.bincount(start[s], weights=x, minlength=n)
            kinds, own = np.unique(local_moves(s, d, x, n, total, start, size, n), return_inverse=True)
            new = own[new]
            if len(kinds) == n:
                break
            n = len(kinds)
            pair, at = np.unique(own[s] * n + own[d], return_inverse=True)
            s, d, x, start = pair // n, pair % n, np.bincount(at, weights=x), np.arange(n)
        better = _quality(src, dst, w, new, total)
        if better <= score + tolerance:
            return of
        of, score = new, better


def _block(total: float, levels: int | None, tolerance: float):
    """For the links of a block. levels: it is the whole graph. Else nodes begin alone and join nodes of their block only; or,
    where links come with communities (a, of src, and b, of dst) and their degrees, nodes begin there and may join any."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # ids in order, those of the block first, so that results don't depend on the order of rows
        inside = np.unique(pdf["src"].to_numpy())
        ids = np.concatenate([inside, np.setdiff1d(pdf["dst"].to_numpy(), inside)])
        number = pd.Index(ids)
        src, dst, w = number.get_indexer(pdf["src"]), number.get_indexer(pdf["dst"]), pdf["w"].to_numpy()
        order = np.lexsort((dst, src))
        s, d, x = src[order], dst[order], w[order]
        n = len(inside)
        if levels is not None:
            own = all_levels(s, d, x, len(ids), total, levels, tolerance)
        elif "a" not in pdf:
            alone = np.arange(len(ids))
            own = local_moves(s, d, x, n, total, alone, np.bincount(s, weights=x, minlength=len(ids)), n)
        else:
            names, at = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
            start, size = np.empty(len(ids), np.int64), np.empty(len(names))
            start[src], start[dst] = at[: len(src)], at[len(src) :]
            size[at] = np.concatenate([pdf["a_all"].to_numpy(), pdf["b_all"].to_numpy()])
            own = local_moves(s, d, x, n, total, start, size, len(ids))
            return pd.DataFrame({"id": inside, "community": names[own[:n]]})
        # a community goes by its first node
        _, first, at = np.unique(own[:n], return_index=True, return_inverse=True)
        return pd.DataFrame({"id": inside, "community": inside[first[at]]})

    return run


def _dealt(links: DataFrame, blocks: int, limit: int, seed: int) -> DataFrame:
    """links with a block for each src: nodes go with the neighbour that they are linked to most. Where that neighbour draws
    more links than a block holds, its followers are split by hash. Nodes with more links than a block holds get none:
    they wait until their neighbours have become fewer."""
    best = F.max_by("dst", F.struct("w", F.xxhash64("dst", F.lit(seed)), "dst"))
    each = stored(links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), best.alias("anchor")).where(F.col("n") <= limit), "anchors")
    pieces = each.groupBy("anchor").agg(F.ceil(F.sum("n") / limit).alias("pieces"))
    each = each.join(pieces, "anchor")
    piece = F.pmod(F.xxhash64("id", F.lit(seed)), "pieces")
    block = F.pmod(F.xxhash64("anchor", piece), F.lit(blocks))
    return links.join(each.select(F.col("id").alias("src"), block.alias("block")), "src")


def modularity(links: DataFrame, own: DataFrame, total: float) -> float:
    """Of a partition (id, community); links stand in both directions, those inside a contracted node once, doubled."""
    ends = links.join(own.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    parts = ends.groupBy("a").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    return parts.agg(F.sum(F.col("inside") / total - F.pow(F.col("all") / total, 2))).first()[0] or 0.0


def _linked(pairs: DataFrame) -> DataFrame:
    """(src, dst, w): pairs (a, b, w) in both directions, nodes' links to themselves once."""
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    one, back = F.struct(a.alias("src"), b.alias("dst"), w.alias("w")), F.struct(b.alias("src"), a.alias("dst"), w.alias("w"))
    return pairs.select(F.explode(F.when(a == b, F.array(one)).otherwise(F.array(one, back))).alias("e")).select("e.*")


def _by_node(pairs: DataFrame) -> DataFrame:
    """The links of pairs in buckets of src, so that no count or join by src shuffles them again."""
    tasks = pairs.sparkSession.sparkContext.defaultParallelism
    return bucketed(_linked(pairs), "links", ["src"], max(tasks, -(-2 * pairs.count() // BUCKET)))


def _contracted(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs (a, b, w) of communities, the lesser first; links inside one are counted twice, as both directions are."""
    at = lambda c: own.select(F.col("id").alias(c), F.col("community").alias(f"{c}_own"))
    x, y = F.col("a_own"), F.col("b_own")
    w = F.when((F.col("a") != F.col("b")) & (x == y), 2 * F.col("w")).otherwise(F.col("w"))
    ends = pairs.join(at("a"), "a").join(at("b"), "b").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), w.alias("w"))
    return stored(ends.groupBy("a", "b").agg(F.sum("w").alias("w")), "contracted")


def _alone(links: DataFrame, total: float) -> float:
    """Modularity of links where each node is a community: that of communities, once they are contracted."""
    parts = links.groupBy("src").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("inside"))
    return parts.agg(F.sum(F.col("inside") / total - F.pow(F.col("all") / total, 2))).first()[0] or 0.0


def _with_all(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """moved with the nodes that were in no block, which stay where nodes (id, community) says."""
    m = moved.withColumnRenamed("community", "to")
    return stored(nodes.join(m, "id", "left").select("id", F.coalesce("to", "community").alias("community")), "moved")


def communities(edges: DataFrame, levels: int = 10, tolerance: float = 1e-4, block_links: int = BLOCK_LINKS) -> DataFrame:
    """(id, community) by Louvain's method on the undirected graph, named by the least id.

    A graph of block_links links or fewer is worked on whole, by one task. A larger one is made smaller by levels, at most
    `levels`: each moves nodes inside blocks and is kept if it raises modularity by more than `tolerance` (two on end that
    don't, with different blocks, are the end), then the rest is worked on whole if it fits. At last single nodes may leave
    their community for one beside them, block by block, once; that is kept if modularity rises. Repeated edges, both
    directions and self-loops count once or not at all; rows with a null end are left out; no edges: an empty table. Ids that
    are no numbers are numbered in their order first, so that blocks hold and compare numbers.
    """
    known = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if known.schema["src"].dataType.simpleString() not in ("int", "bigint"):
        number = stored(numbered(known.select(F.col("src").alias("id")).union(known.select("dst"))), "numbers")
        of = lambda c: number.select(F.col("id").alias(c), F.col("number").alias(f"{c}_number"))
        each = known.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst")
        found = communities(each.select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst")), levels, tolerance, block_links)
        found = found.select(F.col("id").alias("id_number"), F.col("community").alias("community_number"))
        return found.join(of("id"), "id_number").join(of("community"), "community_number").select("id", "community")
    first = pairs = stored(unique_pairs(known).withColumn("w", F.lit(1.0)), "pairs")
    n = 2 * pairs.count()
    total, small = float(n), n <= block_links
    each = links = _linked(pairs) if small else _by_node(pairs)
    member = links.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    if not n:
        return member
    kind = links.schema["src"].dataType.simpleString()
    out = f"id {kind}, community {kind}"
    score, idle = None if small else _alone(links, total), 0
    for level in range(levels + 1):
        if n <= block_links:
            moved = stored(links.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(_block(total, levels, tolerance), out), "moved")
            to = moved.select(F.col("id").alias("community"), F.col("community").alias("to"))
            member = stored(member.join(to, "community").select("id", F.col("to").alias("community")), "member")
            score = score if small else modularity(links, moved, total)
            break
        if level == levels or idle == 2:
            break
        alone = links.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
        dealt = _dealt(links, -(-n // block_links), block_links, level)
        moved = _with_all(alone, dealt.groupBy("block").applyInPandas(_block(total, None, tolerance), out))
        fewer = _contracted(pairs, moved)
        new = _alone(_linked(fewer), total)
        idle = 0 if new > score + tolerance else idle + 1
        if new > score:
            score, pairs = new, fewer
            to = moved.select(F.col("id").alias("community"), F.col("community").alias("to"))
            member = stored(member.join(to, "community").select("id", F.col("to").alias("community")), "member")
            n = pairs.agg(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(2))).first()[0]
            links = _linked(pairs) if n <= block_links else _by_node(pairs)
    if not small:
        degree = each.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("all"))
        all_of = degree.join(member, "id").groupBy("community").agg(F.sum("all").alias("all"))
        known = stored(member.join(all_of, "community").select("id", "community", "all"), "known")
        ends = _dealt(each, -(-int(total) // block_links), block_links, levels)
        for end, c in (("src", "a"), ("dst", "b")):
            ends = ends.join(known.select(F.col("id").alias(end), F.col("community").alias(c), F.col("all").alias(f"{c}_all")), end)
        moved = _with_all(member, ends.groupBy("block").applyInPandas(_block(total, None, tolerance), out))
        if _alone(_linked(_contracted(first, moved)), total) > score:
            member = moved
    least = member.groupBy("community").agg(F.min("id").alias("least"))
    return member.join(least, "community").select("id", F.col("least").alias("community"))
