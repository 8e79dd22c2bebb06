"""Pairs of clusters that share frequent entities, judged block against block.

An entity that n clusters have makes n(n-1)/2 pairs, and frequent ones make the same pair again and again. So
each cluster's frequent entities become a row of a matrix, clusters are dealt to blocks of bounded size, and a
task multiplies one block by another: every pair is judged once, and only what holds leaves the task. Rare
entities stay with the equi-join, which makes few pairs of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import micros
from ..schema import SATURATED, SATURATED_MIN_WEIGHT, TEMPORAL_WINDOW_DAYS, W_JACCARD, W_TEMPORAL, WEAK_MIN_JACCARD, WEAK_THRESHOLD
from ..session import ship

#: Clusters of a block, cells of a block's matrix, rows that are multiplied at once, and tasks.
BLOCK, CELLS, TILE, TASKS = 4096, 1 << 24, 512, 512
#: Clusters of a block of which each cluster's best edges alone leave a task: larger ones tell fewer.
WIDE = 16384
#: An entity of fewer clusters than this is always rare.
RARE = 64
#: Products are compared with so much to spare, before a pair's entities are added up.
SPARE = 1e-9

EDGES = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("strong", pa.bool_()), ("score", pa.float64()), ("word", pa.int32())])
BEST = EDGES.append(pa.field("sure", pa.bool_()))
TREES = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("sure", pa.bool_())])


def frequent(posts: DataFrame, rare: int = RARE) -> DataFrame:
    """(entity, strong, weight) of entities that at least as many clusters have as the root of all rows: so there
    are no more of them than that, and the others make at most that many pairs for each row."""
    df = posts.groupBy("entity").agg(F.count(F.lit(1)).alias("df"), F.any_value("strong").alias("strong"), F.any_value("weight").alias("weight"))
    return df.filter(F.col("df") >= max(rare, math.isqrt(posts.count()))).select("entity", "strong", "weight")


def judged(nodes: DataFrame, posts: DataFrame, words: list, trees: bool = False, best: bool = False) -> DataFrame:
    """What holds of all pairs i < j of nodes (n, last_event_time, total) by the frequent entities `words`, as
    frequent() collected them and by words_in_order(), among posts (n, entity).

    Edges (i, j, strong, score, word), word being the number of what the reason names; or with trees (i, j, sure):
    spanning forests of each two blocks, and one by one the pairs that a rare entity might yet rule out; or with best
    edges and sure: the first of each node's in each two blocks, strong ones first, then by score, i and j, and one by one
    those same pairs."""
    ship(nodes.sparkSession)
    number = nodes.sparkSession.createDataFrame([(w["entity"], k) for k, w in enumerate(words)], "entity string, k int")
    rows = posts.join(F.broadcast(number), "entity").groupBy("n").agg(F.collect_list("k").alias("k"))
    count = nodes.count()
    # where only some edges for each cluster of two blocks are told, fewer blocks tell fewer, but enough are left for tasks
    block = min(min(max(BLOCK, WIDE), max(BLOCK, count // 16)) if best else BLOCK, max(256, CELLS // (len(words) + 2)))
    blocks = -(-count // block)
    placed = nodes.join(rows, "n").select("n", micros(F.col("last_event_time")).alias("at"), "total", "k", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int").alias("x"))
    placed = placed.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = placed.withColumns({"p": F.least("x", "y"), "q": F.greatest("x", "y")}).repartition(min(blocks * (blocks + 1) // 2, TASKS), "p", "q")
    kinds = "i long, j long, sure boolean" if trees else "i long, j long, strong boolean, score double, word int" + (", sure boolean" if best else "")
    strong, weight = np.array([w["strong"] for w in words]), np.array([w["weight"] for w in words])
    return dealt.groupBy("p", "q").applyInArrow(_judge(strong, weight, trees, best), kinds)


def words_in_order(words: DataFrame) -> list:
    """Frequent entities in the order in which reasons name them: strong ones by name, weak ones by weight. There
    are at most as many as the root of all rows."""
    return words.orderBy(F.desc("strong"), F.when(~F.col("strong"), -F.col("weight")), "entity").collect()


class _Side:
    def __init__(self, t: pa.Table, words: int):
        self.n, self.at, self.total = (t.column(c).to_numpy() for c in ("n", "at", "total"))
        k = t.column("k").combine_chunks()
        sizes = np.diff(k.offsets.to_numpy()) if len(k) else np.zeros(0, int)
        self.has = np.zeros((len(self.n), words), np.uint8)
        self.has[np.repeat(np.arange(len(self.n)), sizes), k.flatten().to_numpy()] = 1


def _judge(strong: np.ndarray, weight: np.ndarray, trees: bool, best: bool = False) -> Callable:
    """A function of the blocks (p, q) as one table."""
    share = WEAK_MIN_JACCARD / (1 + WEAK_MIN_JACCARD)
    firm = int(strong.sum())  # strong words come first

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p, q = (k.as_py() for k in key)
        x = table.column("x").to_numpy()
        left = _Side(table.filter(pa.array(x == p)), len(weight))
        right = left if p == q else _Side(table.filter(pa.array(x == q)), len(weight))
        # a pair's product is what it shares, less what an edge needs of both totals
        across = np.hstack([right.has, np.ones((len(right.n), 1)), share * right.total[:, None]]).T
        up = np.arange(len(left.n) + (0 if p == q else len(right.n)))
        got = []
        firsts = [np.zeros(0, t) for t in (np.int64, np.int64, bool, float, np.int32)]
        for start in range(0, len(left.n), TILE):
            own = slice(start, start + TILE)
            has = left.has[own]
            down = np.hstack([has * weight, -share * left.total[own, None], -np.ones((len(has), 1))])
            may = down @ across >= -SPARE
            if firm:
                may |= (has[:, :firm].astype(float) @ across[:firm]) > 0.5
            a, b = np.nonzero(may)
            a += start
            if p == q:
                a, b = a[a < b], b[a < b]
            both = left.has[a] & right.has[b]
            shared = both @ weight
            tied = both[:, :firm].any(axis=1)
            total = left.total[a] + right.total[b]
            union = total - shared
            wj = np.where(union > 0, shared / np.where(union > 0, union, 1.0), 0.0)
            near = np.maximum(1.0 - np.abs(left.at[a] - right.at[b]) // 1_000_000 / 86_400.0 / TEMPORAL_WINDOW_DAYS, 0.0)
            score = W_JACCARD * wj + W_TEMPORAL * near
            holds = tied | ((score >= WEAK_THRESHOLD) & (wj >= WEAK_MIN_JACCARD) & ~((wj >= SATURATED) & (shared < SATURATED_MIN_WEIGHT)))
            a, b, tied = a[holds], b[holds], tied[holds]
            i, j = left.n[a], right.n[b]
            # with rare entities in common too, a pair of so little weight might be saturated
            sure = tied | (np.minimum(left.total[a], right.total[b]) > SATURATED_MIN_WEIGHT / SATURATED + SPARE)
            if trees:
                up = _united(up, a[sure], b[sure] + (0 if p == q else len(left.n)))
                got.append((np.minimum(i, j)[~sure], np.maximum(i, j)[~sure], np.zeros((~sure).sum(), bool)))
                continue
            word = both[holds].argmax(axis=1).astype(np.int32)
            edges = np.minimum(i, j), np.maximum(i, j), tied, np.where(tied, 1.0, score[holds]), word
            if best:
                got.append(tuple(c[~sure] for c in (*edges, sure)))
                # a node's first edge of this tile and of those before
                told = [np.concatenate(c) for c in zip(firsts, [c[sure] for c in edges], strict=True)]
                firsts = _firsts(*told)
            else:
                got.append(edges)
        if best:
            got.append((*firsts, np.ones(len(firsts[0]), bool)))
        if trees:
            n = left.n if p == q else np.concatenate([left.n, right.n])
            child = np.nonzero(up != np.arange(len(up)))[0]
            i, j = n[child], n[up[child]]
            got.append((np.minimum(i, j), np.maximum(i, j), np.ones(len(i), bool)))
        schema = TREES if trees else BEST if best else EDGES
        columns = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0)] * len(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _firsts(i: np.ndarray, j: np.ndarray, strong: np.ndarray, score: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Those edges that are the first of either end, once each."""
    order = np.lexsort((j, i, -score, ~strong))
    rank = np.argsort(order)
    ends, ranks = np.concatenate([i, j]), np.concatenate([rank, rank])
    by = np.lexsort((ranks, ends))
    keep = order[np.unique(ranks[by[np.unique(ends[by], return_index=True)[1]]])]
    return [c[keep] for c in (i, j, strong, score, word)]


def _united(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """up, each place's least place of its tree, after ties of places a and b."""
    while len(a):
        ra, rb = up[a], up[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        up = up.copy()
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(above := up[up], up):
            up = above
    return up
