"""Connected components of large graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.indexing import checkpointed, counted

from .common import ship

#: Edges that one task merges at most, a few MB.
EDGES_PER_TASK = 1 << 18


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the edges of a task connect, as stars: an edge for each node but the least of each component."""
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(x.num_rows for x in waiting) > len(u) + EDGES_PER_TASK // 4:
            u, v = spanning(*(np.concatenate([own, *(x.column(c).to_numpy() for x in waiting)]) for c, own in (("u", u), ("v", v))))
            waiting = []
    u, v = spanning(*(np.concatenate([own, *(x.column(c).to_numpy() for x in waiting)]) for c, own in (("u", u), ("v", v))))
    yield pa.RecordBatch.from_pydict({"u": u, "v": v})


def parents(edges: DataFrame, a: str = "a", b: str = "b", per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component): each node with an edge but the least of its component, and that least node; ids are longs.

    Each task merges the edges that it holds to stars. Where these are too many for one task, large-star and small-star
    steps (Kiveris et al., 2014) alternate with such merges: every edge moves towards the least node known, until all are
    stars, after a number of rounds that grows with the logarithm of the longest path. Each step is an aggregation and a
    join on nodes, between exchanges whose skew the engine can split; their counts go to the driver, nothing else.
    """
    ship(edges.sparkSession)
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    pairs, seen = counted(pairs.mapInArrow(_forest, "u long, v long"))
    state = None
    while seen.n:
        tasks = -(-seen.n // per_task)
        pairs = checkpointed(pairs.coalesce(tasks).mapInArrow(_forest, "u long, v long"))
        if tasks == 1:
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
        large = checkpointed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs, seen = counted(small.coalesce(2 * tasks).distinct(), sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(edges: DataFrame, a: str = "a", b: str = "b", per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component): each node with an edge and the least node that it is connected to; see ``parents``."""
    found = parents(edges, a, b, per_task)
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
