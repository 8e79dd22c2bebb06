"""Connected components of edge tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, number_batches, thin

#: Edges that a task unites at once before it sends on what is left of them.
UNITE = 1 << 18


class Forest:
    """Union-find over integer ids; each root is the smallest id of its tree."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root:
            up[x], x = root, above
        return root

    def unite(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        """An edge from each id to its root, roots left out."""
        ids = [x for x in self.up if self.up[x] != x]
        return ids, [self.find(x) for x in ids]


def _contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, of the same components and fewer: each task replaces its own by a spanning
    forest, in parts of bounded size."""

    def emit(forest: Forest) -> pa.RecordBatch:
        ids, roots = forest.stars()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in it:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.unite(a, b)
            if len(forest.up) > UNITE:
                yield emit(forest)
                forest = Forest()
        yield emit(forest)

    return edges.mapInArrow(run, "a long, b long")


def _step(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step. Least neighbours are minima, which combine before they are
    shuffled; the joins are on one row for each node, so AQE can split a hub's edges."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    smallest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    joined = large.join(smallest, F.col("a") == F.col("n"))
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(smallest.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of integer ids: rows (id, component) for every id of an edge, component being the
    smallest id reachable. Loops and repeated edges do no harm; no edges give no rows.

    Tasks first replace their own edges by spanning forests. Large-star and small-star steps then alternate
    until nothing changes, or until the edges left fit one part of the bounded size UNITE; this takes a number
    of rounds that grows with the logarithm of the size. The state of each is kept in the shared folder.
    """
    spark = edges.sparkSession
    ids = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    with number_batches(spark):
        now = durable(thin(_contract(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")).distinct()))
        mark = _mark(now)
        while mark[0]:
            # what is left of the edges may be few enough for one part, which makes stars of all of them
            if mark[0] <= UNITE // 2:
                now = durable(_contract(now.coalesce(1)))
                break
            now = durable(thin(_contract(_step(now)).distinct()))
            was, mark = mark, _mark(now)
            if mark == was:
                break
    alone = ids.distinct().join(now.withColumnRenamed("a", "child").withColumnRenamed("b", "root"), F.col("id") == F.col("child"), "left")
    return alone.select("id", F.coalesce("root", "id").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """What tells one round's edges from another's."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
