"""Connected components of edge tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..storage import kept

#: Edges that one task may unite.
UNITE = 1 << 17


def _forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of the same components, a > b, and fewer: each task unites its own, in parts of bounded
    size, and sends on an edge from each id to the smallest of its tree."""
    kind = edges.schema["a"].dataType.simpleString()

    def stars(up: dict) -> pa.RecordBatch:
        found = [(x, _root(up, x)) for x in up if up[x] != x]
        return pa.RecordBatch.from_pydict({"a": [x for x, _ in found], "b": [r for _, r in found]}, schema=schema)

    schema = pa.schema([(c, pa.string() if kind == "string" else pa.int64()) for c in "ab"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        for batch in it:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = _root(up, a), _root(up, b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > 4 * UNITE:
                yield stars(up)
                up = {}
        yield stars(up)

    return edges.mapInArrow(run, f"a {kind}, b {kind}")


def _root(up: dict, x):
    root = x
    while (above := up.setdefault(root, root)) != root:
        root = above
    while up[x] != root:
        up[x], x = root, up[x]
    return root


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: ids are tied to the least of their neighbours instead of to
    each other. Least neighbours are minima, which combine before they are shuffled."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    smallest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = large.join(smallest, F.col("a") == F.col("n")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(smallest.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def min_label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of nodes (id) by undirected edges (a, b); component is the smallest id reachable.

    Tasks replace their edges by spanning forests; star steps follow, whose number grows with the logarithm
    of the size, until the edges left are few enough for one task or nothing changes. Loops, repeated edges
    and ids that are no nodes do no harm.
    """
    ship(edges.sparkSession)
    now = kept(_forest(edges.select("a", "b").filter("a <> b")))
    was = None
    while (mark := _mark(now)) != was and mark[0]:
        if mark[0] <= UNITE:
            now = kept(_forest(now.coalesce(1)))
            break
        now, was = kept(_forest(_star(now))), mark
    roots = now.select(F.col("a").alias("_child"), F.col("b").alias("_root"))
    return nodes.select("id").distinct().join(roots, F.col("id") == F.col("_child"), "left").select("id", F.coalesce("_root", "id").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """What tells one round's edges from another's."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
