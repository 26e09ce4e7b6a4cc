"""Connected components of an undirected graph, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import cut, scratch, spread_join

ROUNDS = 60
#: Edges that one task joins up by itself: some 20 MB there. Larger graphs are contracted until so many are left.
ONE_TASK = 100_000


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a partition; the smaller root wins, so a root is its component's smallest id."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["u", "p"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(a long, b long) -> (id, component): the smallest id reachable, for every id that has an edge.

    Each round every node hooks to the smallest of itself and its neighbours, chains are shortened, and
    the edges are carried over to what their ends hook to. Minima are taken in each task before the
    shuffle, and a node with very many edges is dealt over several tasks where it is joined. The last
    one_task edges are joined up in one task. Self-loops and repeated edges do no harm.
    """
    with scratch(edges.sparkSession) as keep:
        left = cut(edges.select("a", "b").where("a <> b").distinct())
        label = None

        def follow(up: DataFrame) -> DataFrame:
            if label is None:
                return cut(up.select(F.col("u").alias("id"), F.col("p").alias("component")))
            named = spread_join(label, up.withColumnRenamed("u", "component"), ["component"], "left")
            return cut(named.select("id", F.coalesce("p", "component").alias("component")))

        for _ in range(ROUNDS):
            if left.count() <= one_task:
                return keep(follow(cut(left.coalesce(1).mapInArrow(_join_up, "u long, p long"))))
            up = cut(left.union(left.select("b", "a")).groupBy(F.col("a").alias("u")).agg(F.least("a", F.min("b")).alias("p")))
            for _ in range(2):
                further = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
                up = cut(spread_join(up, further, ["p"], "left").select("u", F.coalesce("q", "p").alias("p")))
            label = follow(up)
            for end in ("a", "b"):
                left = cut(spread_join(left, up.select(F.col("u").alias(end), "p"), [end]).drop(end).withColumnRenamed("p", end))
            left = cut(left.select("a", "b").where("a <> b").distinct())
    raise RuntimeError("the components did not settle")
