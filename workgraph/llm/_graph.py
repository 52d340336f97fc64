"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


class Forest:
    """Union-find over the ids of one task; the smallest id is a set's root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        """(node, root) of every node that is not a root."""
        return [(x, self.root(x)) for x in self.up]


def forest_of(batches: Iterable[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Edge batches (a, b) as fewer edges of the same components; at most so many nodes are held at a time."""
    f = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            f.join(a, b)
        if len(f.up) > most:
            yield edge_batch(f.edges())
            f = Forest()
    yield edge_batch(f.edges())


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b): component is the smallest id that can be reached.

    Each task first reduces its edges to a spanning forest. Then large stars and small stars alternate until nothing
    changes, in about log(n) rounds; every round is a written table. Nodes of a hub meet their hub's minimum in an
    equi-join that Spark splits when it is skewed. No edges: an empty table.
    """
    e = edges.mapInArrow(forest_of, "a long, b long").filter("a <> b")
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while True:
        state = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == was or state[0] == 0:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        was = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        e = written(small.filter("a <> b").distinct())
