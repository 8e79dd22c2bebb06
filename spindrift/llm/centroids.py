"""Centroid clustering by ball-tree filtering.

Vectors are turned to integers, cut into blocks where they lie, and each block gets a metric tree, once:
a ball stores its centre, radius, count and integer sum. In each round, all balls of a tree are compared
with the centroids level by level. A centroid that by the triangle inequality is farther from every vector
of a ball than another one is dropped for that ball and all below it; a ball with one centroid left is
given to it whole, by its sum and count. Where several are left at a leaf, its vectors are compared with
those exactly, in integers. So rounds give exact sums, and their results don't depend on how vectors are
dealt to blocks.

What a round sends on are sums, one row for each centroid and task, so it shuffles no vectors; the driver
gets one row for each centroid. Trees are kept in the shared folder and read again in each round.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, durable, small_batches, stored

#: Vectors in a block, and in a leaf of its tree, at most.
BLOCK, LEAF = 4096, 24
#: Vectors become integers by this factor.
SCALE = 256
_HEAD = struct.Struct("<qqq")


def largest(dim: int) -> int:
    """How large an integer component may be, so that squared distances fit 63 bits."""
    return int((2**61 // max(dim, 1)) ** 0.5)


@dataclass
class Tree:
    """A block's balls, parents before children; a ball holds the vectors from `first` to `end`."""

    ids: np.ndarray
    known: np.ndarray
    vectors: np.ndarray
    first: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    def packed(self) -> bytes:
        parts = [np.ascontiguousarray(x).tobytes() for x in (self.ids, self.known, self.vectors, self.first, self.end, self.parent, self.leaf, self.centre, self.radius, self.total)]
        return _HEAD.pack(*self.vectors.shape, len(self.first)) + b"".join(parts)

    @classmethod
    def unpacked(cls, blob: bytes) -> Tree:
        n, dim, balls = _HEAD.unpack_from(blob)
        at, found = _HEAD.size, []
        for kind, shape in (("i8", n), ("?", n), ("i8", (n, dim)), ("i8", balls), ("i8", balls), ("i8", balls), ("?", balls), ("f8", (balls, dim)), ("f8", balls), ("i8", (balls, dim))):
            count = int(np.prod(shape))
            found.append(np.frombuffer(blob, kind, count, at).reshape(shape))
            at += found[-1].nbytes
        return cls(*found)


def build(ids: np.ndarray, known: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    """A ball is halved at the median along the direction between two of its vectors that are far apart;
    one of equal vectors is a leaf whatever its count."""
    order = np.arange(len(vectors))
    values = vectors.astype(np.float64)
    todo, balls = [(0, len(vectors), -1)], []
    while todo:
        first, end, parent = todo.pop()
        own = values[order[first:end]]
        centre = own.mean(0)
        apart = ((own - centre) ** 2).sum(1)
        far = int(apart.argmax())
        radius = float(apart[far]) ** 0.5
        split = end - first > leaf and bool((own != own[0]).any())
        balls.append((first, end, parent, not split, centre, radius))
        if split:
            other = int(((own - own[far]) ** 2).sum(1).argmax())
            along = own @ (own[other] - own[far])
            middle = len(own) // 2
            order[first:end] = order[first:end][np.argpartition(along, middle, kind="introselect")]
            at = len(balls) - 1
            todo += [(first, first + middle, at), (first + middle, end, at)]
    first, end, parent, is_leaf, centre, radius = zip(*balls, strict=True)
    vectors = vectors[order]
    before = np.concatenate([np.zeros((1, vectors.shape[1]), np.int64), np.cumsum(vectors, 0)])
    first, end = np.array(first, np.int64), np.array(end, np.int64)
    # a radius a little too large costs comparisons, one too small would be wrong
    return Tree(ids[order], known[order], vectors, first, end, np.array(parent, np.int64), np.array(is_leaf), np.array(centre), np.array(radius) * (1 + 1e-9) + 1e-9, before[end] - before[first])


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to integer centroids. Products go by floating point
    where all sums are whole numbers below 2^52."""
    top = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * top * top * max(vectors.shape[1], 1) < 1 << 52:
        a, b = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1) if len(centroids) else np.zeros((len(vectors), 0), np.int64)


def filtered(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(ball, first, end, candidates) of balls that cover all vectors, each once: with one candidate, the
    centroid nearest to all of them; else a leaf and the centroids that may be nearest to some."""
    centres = centroids.astype(np.float64)
    square = (tree.centre**2).sum(1)[:, None] - 2 * (tree.centre @ centres.T) + (centres**2).sum(1)[None]
    # the expansion cancels: its error is a few units in the last place of what it adds up
    error = np.sqrt(1e-13 * ((tree.centre**2).sum(1).max(initial=0) + (centres**2).sum(1).max(initial=0)))
    apart = np.sqrt(np.maximum(square, 0))
    slack = 2 * (tree.radius + error) * (1 + 1e-9) + 1e-9
    near = np.ones(apart.shape, bool)
    open_ = np.ones(len(tree.first), bool)
    for ball in range(len(tree.first)):
        parent = tree.parent[ball]
        if parent >= 0:
            if not open_[parent]:
                open_[ball] = False
                continue
            near[ball] = near[parent]
        own = np.where(near[ball], apart[ball], np.inf)
        near[ball] &= own <= own.min() + slack[ball]
        candidates = np.flatnonzero(near[ball])
        if len(candidates) == 1 or tree.leaf[ball]:
            open_[ball] = False
            yield ball, int(tree.first[ball]), int(tree.end[ball]), candidates


def summed(tree: Tree, centroids: np.ndarray, totals: np.ndarray, counts: np.ndarray) -> int:
    """Add a tree's vectors to the sums and counts of their nearest centroids. Returns how many vectors
    were given away in whole balls."""
    whole = 0
    for ball, first, end, near in filtered(tree, centroids):
        if len(near) == 1:
            totals[near[0]] += tree.total[ball]
            counts[near[0]] += end - first
            whole += end - first
        else:
            best = near[squared(tree.vectors[first:end], centroids[near]).argmin(1)]
            np.add.at(totals, best, tree.vectors[first:end])
            np.add.at(counts, best, 1)
    return whole


def assigned(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, of equally near ones the first, and its squared distance."""
    cluster, distance = np.zeros(len(tree.ids), np.int64), np.zeros(len(tree.ids), np.int64)
    for _, first, end, near in filtered(tree, centroids):
        to = squared(tree.vectors[first:end], centroids[near])
        best = to.argmin(1)
        cluster[first:end], distance[first:end] = near[best], to[np.arange(end - first), best]
    return cluster, distance


def whole_vectors(vectors: DataFrame, *, id_col: str, vec_col: str, dim: int, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors of exactly `dim` components, none null or not finite, as integers
    floor(scale * x). Vectors with an integer beyond largest(dim) are left out too, as their squared
    distances don't fit a long."""
    v = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < float(largest(dim))))
    return vectors.filter((F.size(vec_col) == dim) & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def trees(kept: DataFrame, dim: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row for each block of at most `block` vectors of a partition, with its tree packed."""
    small_batches(kept.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def packed() -> pa.RecordBatch:
            ids, known, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([build(ids, known, v, leaf).packed()], pa.binary())], names=["tree"])

        for batch in batches(it):
            ids = batch.column("id")
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            parts.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), flat.reshape(-1, dim)))
            held += batch.num_rows
            if held >= block:
                yield packed()
                parts, held = [], 0
        if parts:
            yield packed()

    return kept.mapInArrow(run, "tree binary")


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:id`, in that order; of a repeated id's, smaller
    components first."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = kept.select(sha.alias("sha"), "v").orderBy("sha", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def _round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after each has been replaced by its vectors' mean, rounded down."""
    k, dim = centroids.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches(it):
            for blob in batch.column("tree"):
                summed(Tree.unpacked(blob.as_py()), centroids, totals, counts)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(counts[own], pa.int64()), pa.array(list(totals[own]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = blocks.mapInArrow(run, "cluster long, n long, total array<long>")
    sums = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dim)]
    new = [list(map(int, c)) for c in centroids]
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # k rows at most
        new[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(dim)]
    return np.array(new, np.int64)


def centroid_clusters(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = SCALE,
    block: int = BLOCK, leaf: int = LEAF,
) -> DataFrame:
    """Every kept vector's cluster: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `dim` components, none null or not finite, or so large that a squared
    distance wouldn't fit a long (see whole_vectors). Components become floor(scale * x). Centroids start
    as the k vectors of smallest sha256 of `seed:id`; each round assigns every vector to the nearest (of
    equally near ones the smaller number) and replaces each centroid that has vectors by their mean,
    rounded down; then vectors are assigned once more. inertia sums squared distances, cluster_inertia
    those of the cluster, centroid_sha256 is of the final centroid's components, joined by commas.

    With fewer vectors than k there are as many centroids as vectors. A null id counts as an empty string
    for the start. Repeated rows count as often as they occur and are all returned. Other columns are
    ignored. A table without kept vectors gives no rows.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, id_col=id_col, vec_col=vec_col, dim=dim, scale=scale)
    centroids = first_centroids(kept, k, seed)
    shape = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], shape)
    blocks = stored(trees(kept, dim, block, leaf))
    for _ in range(rounds):
        centroids = _round(blocks, centroids)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            for blob in batch.column("tree"):
                tree = Tree.unpacked(blob.as_py())
                cluster, distance = assigned(tree, centroids)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64(), mask=~tree.known), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    found = durable(blocks.mapInArrow(run, "id long, cluster int, distance long"))
    by = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)
    return found.select(
        F.col("id").alias(id_col), "cluster", "distance", of([by.get(c, 0) for c in range(len(sha))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(by.values())).cast("long").alias("inertia"), of(sha).alias("centroid_sha256"),
    )
