"""Clusters of result pages, of whole results, and selections within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import ship
from .indexing import checkpointed
from .partials import matrix_of, merged

MOST_IN_GROUP = 5_000
#: Clustering features of a whole result at most.
GROUPS = 2_000


def ward(x: np.ndarray, weights: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (representative, representative, height) of Ward linkage, lowest first, by nearest-neighbour chains.

    A cluster is represented by its first child's representative; a row's is the row itself. A row of weight w stands for w
    equal ones, whose merges at height 0 are left out.
    """
    n = len(x)
    size = np.ones(n) if weights is None else weights.astype(float)
    d = np.maximum(0.0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T)
    if weights is not None:
        d *= 2 * size[:, None] * size[None] / (size[:, None] + size[None])
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        merges.append((a, b, float(np.sqrt(d[a, b]))))
        new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / (size[a] + size[b] + size)
        size[a], alive[b] = size[a] + size[b], False
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
    return sorted(merges, key=lambda m: m[2])


def cut(n: int, merges: list[tuple[int, int, float]], strength: float) -> list[int]:
    """Each row's cluster, named by its least row: merges up to (strength/100)² of the highest hold; at 0 none does."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, height in merges if strength else []:
        if height <= (strength / 100) ** 2:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _grouped(f: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, int, float]]]:
    if len(f) > MOST_IN_GROUP:
        raise ValueError(f"a group of {len(f)} is too large to cluster at once; use whole_clusters")
    f = f.sort_values("rank", kind="stable").reset_index(drop=True)
    merges = ward(np.stack(f["embedding"].to_numpy()).astype(float), f["weight"].to_numpy() if "weight" in f else None)
    highest = max((m[2] for m in merges), default=0.0)
    return f, [(a, b, h / highest if highest > 0 else 0.0) for a, b, h in merges]


def page_merges(pages: DataFrame, page: str = "page") -> DataFrame:
    """(page, step, a, b, dist): the merges of each page of (page, rank, item_id, embedding); a and b are places in it."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        key = f[page].iloc[0]
        _, merges = _grouped(f)
        return pd.DataFrame([(key, k, *m) for k, m in enumerate(merges)], columns=["page", "step", "a", "b", "dist"])

    return pages.groupBy(page).applyInPandas(run, "page long, step int, a int, b int, dist double")


def page_clusters(pages: DataFrame, strength: float, page: str = "page") -> DataFrame:
    """(page, item_id, rank, cluster): clusters of each page at a strength of 0 to 100, named by their least rank."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f, merges = _grouped(f)
        f["cluster"] = f["rank"].to_numpy()[cut(len(f), merges, strength)]
        return f[[page, "item_id", "rank", "cluster"]].set_axis(["page", "item_id", "rank", "cluster"], axis=1)

    return pages.groupBy(page).applyInPandas(run, "page long, item_id long, rank long, cluster long")


def by_size(clusters: DataFrame, keys: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """Clusters, the largest first, ties by name."""
    return clusters.groupBy(*keys).agg(F.count("*").alias("size")).orderBy(F.desc("size"), *keys)


def coarse_clusters(found: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """Any number of rows (item_id, embedding, ...) with a coarse ``leaf``, of ``k`` at most, of any size; see ``whole_clusters``.

    A column ``weight`` says how many rows each stands for.
    """
    rows = found.withColumn("features", array_to_vector(V.doubles(F.col("embedding"))))
    means = BisectingKMeans(k=k, seed=seed, predictionCol="leaf")
    means = means.setWeightCol("weight") if "weight" in found.columns else means
    return means.fit(rows).transform(rows).drop("features").withColumn("leaf", F.col("leaf").cast("long"))


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T)


class Features:
    """Clustering features: at most ``most`` groups of vectors that lie near each other, each with its number and mean.

    Vectors join the nearest group within ``reach``, which is 0 at first: as long as there are no more distinct vectors
    than ``most``, the groups are these. Once there are more, the reach grows to the median distance of a group to its
    nearest one, and groups within reach of each other become one, until they are few enough.
    """

    def __init__(self, dim: int, most: int):
        self.most, self.reach = most, 0.0
        self.mean, self.n = np.empty((0, dim)), np.empty(0)

    def add(self, x: np.ndarray, n: np.ndarray, reach: float = 0.0) -> None:
        for a in range(0, len(x), 1024):
            self._add(x[a : a + 1024], n[a : a + 1024], max(reach, self.reach))

    def _add(self, x: np.ndarray, n: np.ndarray, reach: float) -> None:
        self.reach = reach
        if reach and len(self.n):
            far = squared_distances(x, self.mean)
            near = far.argmin(axis=1)
            own = far[np.arange(len(x)), near] <= reach**2
            sums = self.mean * self.n[:, None]
            np.add.at(sums, near[own], x[own] * n[own, None])
            np.add.at(self.n, near[own], n[own])
            self.mean = sums / self.n[:, None]
            x, n = x[~own], n[~own]
        self._join(np.vstack([self.mean, x]), np.append(self.n, n))
        while len(self.n) > self.most:
            self.reach = max(1.25 * self.reach, self._median())
            self._join(self.mean, self.n)

    def _median(self) -> float:
        nearest = []
        for a in range(0, len(self.mean), 512):
            far = squared_distances(self.mean[a : a + 512], self.mean)
            far[np.arange(len(far)), a + np.arange(len(far))] = np.inf
            nearest.append(far.min(axis=1))
        return float(np.sqrt(np.median(np.concatenate(nearest)))) or float(np.finfo(float).tiny)

    def _join(self, x: np.ndarray, n: np.ndarray) -> None:
        """The vectors as groups: equal ones together, and with a reach the largest first, each with all that are left within it."""
        x, at = np.unique(x, axis=0, return_inverse=True)
        n = np.bincount(at.ravel(), n, len(x))
        if self.reach:
            group, left = np.full(len(x), -1), np.argsort(-n, kind="stable")
            while len(left):
                own = ((x[left] - x[left[0]]) ** 2).sum(axis=1) <= self.reach**2
                own[0] = True
                group[left[own]] = left[0]
                left = left[~own]
            _, at = np.unique(group, return_inverse=True)
            sums = np.zeros((at.max() + 1 if len(at) else 0, x.shape[1]))
            np.add.at(sums, at, x * n[:, None])
            n = np.bincount(at, n)
            x = sums / n[:, None]
        self.mean, self.n = x, n


def features(vectors: DataFrame, dim: int, most: int = GROUPS, column: str = "embedding") -> Features:
    """The clustering features of all vectors of ``dim`` numbers: tasks make their own, which are merged in steps.

    What a task holds, and what comes to the driver, are at most ``most`` means.
    """

    def row(found: Features) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"n": pa.array([found.n.tobytes()], pa.binary()), "mean": pa.array([found.mean.tobytes()], pa.binary()), "reach": pa.array([found.reach])})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Features(dim, most)
        for batch in batches:
            x = matrix_of(batch.column("x"), dim)
            found.add(x[np.isfinite(x).all(axis=1)], np.ones(int(np.isfinite(x).all(axis=1).sum())))
        yield row(found)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Features(dim, most)
        for batch in batches:
            for n, mean, reach in zip(*(batch.column(k) for k in ("n", "mean", "reach")), strict=True):
                found.add(np.frombuffer(mean.as_buffer()).reshape(-1, dim), np.frombuffer(n.as_buffer()), reach.as_py())
        yield row(found)

    rows = vectors.select(V.doubles(F.col(column)).alias("x")).where(F.size("x") == dim)
    r = merged(rows.mapInArrow(make, "n binary, mean binary, reach double"), fold).collect()[0]
    found = Features(dim, most)
    found.mean, found.n, found.reach = np.frombuffer(r["mean"]).reshape(-1, dim), np.frombuffer(r["n"]), r["reach"]
    return found


def whole_clusters(found: DataFrame, strength: float, most: int = GROUPS) -> DataFrame:
    """(item_id, rank, cluster): Ward clusters of any number of rows (rank, item_id, embedding), named by their least rank.

    Rows are condensed to at most ``most`` clustering features, which Ward linkage merges with their numbers as weights; one
    cut, at a strength of 0 to 100, holds for the whole result, and each row goes with the feature nearest to it. With no
    more distinct vectors than ``most`` that is Ward linkage of all rows; with more, features take the place of what lies
    within their reach. At a strength of 0 each row is a cluster. Vectors that are null, hold null or non-finite numbers or
    have another length than most are clusters of their own.
    """
    ship(found.sparkSession)
    rows = found.select("item_id", F.col("rank").cast("long").alias("rank"), V.doubles(F.col("embedding")).alias("x"))
    sizes = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first() if strength else None
    if sizes is None:
        return rows.select("item_id", "rank", F.col("rank").alias("cluster"))
    dim = sizes["size"]
    groups = features(rows, dim, most, "x")
    merges = ward(groups.mean, groups.n)
    highest = max((m[2] for m in merges), default=0.0)
    label = np.array(cut(len(groups.n), [(a, b, h / highest if highest > 0 else 0.0) for a, b, h in merges], strength), np.int64)
    mean = groups.mean

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, -1, np.int64)
            vectors = [x.values for x in batch.column("x")]
            mine = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == dim and not v.null_count and np.isfinite(v.to_numpy()).all()], np.int64)
            for at in np.array_split(mine, -(-len(mine) // 512) or 1):
                if len(at):
                    x = np.stack([vectors[i].to_numpy() for i in at])
                    few = np.argsort(squared_distances(x, mean), axis=1, kind="stable")[:, :4]  # the nearest but for rounding
                    exact = ((x[:, None] - mean[few]) ** 2).sum(axis=2)
                    out[at] = label[few[np.arange(len(at)), exact.argmin(axis=1)]]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("rank"), pa.array(out)], ["item_id", "rank", "_label"])

    schema = T.StructType([rows.schema["item_id"], rows.schema["rank"], T.StructField("_label", T.LongType())])
    labelled = checkpointed(rows.mapInArrow(nearest, schema))
    names = labelled.where("_label >= 0").groupBy("_label").agg(F.min("rank").alias("cluster"))  # a row a cluster, at most ``most``
    return labelled.join(F.broadcast(names), "_label", "left").select("item_id", "rank", F.coalesce("cluster", "rank").alias("cluster"))


def inverted(clusters: DataFrame, selected: DataFrame) -> DataFrame:
    """The items of the clusters that aren't selected."""
    return clusters.join(selected.select("item_id"), "item_id", "left_anti")
