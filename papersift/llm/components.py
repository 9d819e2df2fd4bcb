"""Connected components of a link table, as alternating large-star and small-star steps.

Every step is a minimum per node and a join back, so a node with very many links is pre-aggregated before
the shuffle and its join can be split; nothing is collected.  Links inside a partition are first contracted
there, which leaves few steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import column, freed, stored

#: Links that one contraction holds in memory at a time.
CONTRACT = 500_000


class Union:
    """Union-find whose root is the smallest id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        r = x
        while parent.get(r, r) != r:
            r = parent[r]
        while parent.get(x, x) != r:
            parent[x], x = r, parent[x]
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def contracted(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its part) for every node that is not the smallest."""
    union = Union()
    for a, b in pairs:
        union.join(a, b)
    return [(x, union.root(x)) for x in union.parent if union.root(x) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple[int, int]] = []

    def made() -> pa.RecordBatch:
        rows = contracted(waiting)
        return pa.RecordBatch.from_pydict({"u": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64())})

    for batch in batches:
        waiting.extend(zip(column(batch, "u").to_pylist(), column(batch, "v").to_pylist()))
        if len(waiting) >= CONTRACT:
            yield made()
            waiting.clear()
    yield made()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of node and neighbours."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them.  ``links`` has u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller one, or links to larger ones only: then each is linked to its smallest."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    apart = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
    return apart.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest id reachable) of every node that has links, but the smallest itself.

    ``links`` has long columns u and v.  Ends as soon as the links are stars, without a round that only finds no change.
    """
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stored(ordered.mapInArrow(freed(_contract), "u long, v long"), "links")
    while not _stars(now):
        now = stored(_small_star(_large_star(now)), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
