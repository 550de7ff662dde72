"""Connected components of a graph too large for one machine.

Links are contracted inside each partition with union-find, then the
alternating large-star and small-star steps of Kiveris et al. (2014) run as
DataFrame joins until nothing changes. No step brings the links of all nodes
to one place: minima are partly aggregated before they are shuffled, and what
is found of a node is looked up by its links, much-linked nodes as hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import cut, looked_up

#: Links that a task contracts at a time.
HELD = 1 << 20
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class Forest:
    """Union-find over integers; a root is the smallest of its set."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        """True if the two were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) for what a partition's links hold together, HELD links at a time."""
    forest, held = Forest(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        held += batch.num_rows
        if held >= HELD:
            yield from _stars(forest)
            forest, held = Forest(), 0
    yield from _stars(forest)


def _stars(forest: Forest) -> Iterator[pa.RecordBatch]:
    nodes = [x for x in forest.parent if forest.root(x) != x]
    for i in range(0, len(nodes), 65536):
        part = nodes[i : i + 65536]
        roots = [forest.root(x) for x in part]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(roots, pa.int64())], schema=_LINK)


def components(links: DataFrame, most_rounds: int = 60, small: bool | None = None) -> DataFrame:
    """``links`` has longs u and v. Returns (node, root), root being the smallest reachable node.

    Nodes without a link to another node aren't returned. Links from a node
    to itself and repeated links change nothing; no links give no rows.
    """
    first, second = links.columns
    edges = links.select(F.col(first).alias("u"), F.col(second).alias("v")).where("u <> v")
    edges = cut(edges.mapInArrow(_contract, "u long, v long").distinct())
    for _ in range(most_rounds):
        after = cut(_small_star(cut(_large_star(edges, small)), small))
        same = _digest(after) == _digest(edges)
        edges = after
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _large_star(edges: DataFrame, small: bool | None = None) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links"))
    least = cut(least.select("u", F.least("u", "m").alias("m"), "links"))
    out = looked_up(both.where("v > u"), least, "u", "links", small).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame, small: bool | None = None) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")))
    out = looked_up(down, least, "u", "links", small).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
