"""k-means over integer vectors: nearest centroids by a tournament of linear sign tests, all sums exact."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.indexing import counted

from .common import ship

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
#: Vectors that a task tests at once, a few MB.
BLOCK = 4096


def whole_numbers(vectors: pa.Array, dimensions: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``dimensions`` components, none null or non-finite, and floor(scale * x) of these, exactly.

    The second array holds longs where distances of such numbers fit into longs, Python integers otherwise.
    """
    vectors = vectors.cast(pa.large_list(pa.float64()))
    starts = vectors.offsets.to_numpy()[:-1]
    lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy()), -1)
    rows = np.flatnonzero(lengths == dimensions)
    flat = vectors.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    values = flat[starts[rows][:, None] + np.arange(dimensions)] if len(rows) else np.empty((0, dimensions))
    finite = np.isfinite(values).all(axis=1)
    rows, values = rows[finite], values[finite]
    kept = np.zeros(len(vectors), bool)
    kept[rows] = True
    if not len(values) or np.abs(values).max() * scale < _bound(dimensions):
        return kept, np.floor(values * scale).astype(np.int64)
    whole = [[math.floor(scale * x) if abs(x) < 2.0**52 else scale * int(x) for x in v] for v in values.tolist()]
    return kept, _array(whole, dimensions)


def _bound(dimensions: int) -> float:
    """Below it, sums over all dimensions of products of a number and twice a difference fit into longs."""
    return 2.0 ** ((60 - math.ceil(math.log2(max(2, dimensions)))) // 2)


def _array(rows: list, dimensions: int) -> np.ndarray:
    """Longs where distances of the rows' numbers fit into longs; else Python integers, which are exact at any size."""
    wide = any(abs(x) >= _bound(dimensions) for r in rows for x in r)
    out = np.empty((len(rows), dimensions), object if wide else np.int64)
    for k, r in enumerate(rows):
        out[k] = r
    return out


class Bisectors:
    """The planes between all pairs of centroids: a vector v is nearer to j than to i where normal[i, j] * v > threshold[i, j]."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = _array(centroids, len(centroids[0]))
        self.normal = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        own = (self.centroids * self.centroids).sum(axis=1)
        self.threshold = own[None, :] - own[:, None]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (ties: the smaller number) and its squared distance, by k - 1 sign tests each."""
        winner = np.zeros(len(vectors), np.int64)
        for other in range(1, len(self.centroids)):
            normal, threshold = self.normal[winner, other], self.threshold[winner, other]
            side = (vectors * normal).sum(axis=1) - threshold if object in (vectors.dtype, normal.dtype) else np.einsum("ij,ij->i", vectors, normal) - threshold
            winner[(side > 0).astype(bool)] = other
        away = vectors - self.centroids[winner]
        return winner, (away * away).sum(axis=1)


def _assigned(batches: Iterator[pa.RecordBatch], vector_col: str, bisectors: Bisectors, dimensions: int):
    """For blocks of vectors: the batch's rows that are kept, their whole numbers, nearest centroids and distances."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            kept, values = whole_numbers(part.column(vector_col), dimensions)
            if len(values):
                yield part.filter(pa.array(kept)), values, *bisectors.nearest(values)


def _long(x: int) -> int | None:
    return int(x) if x < 1 << 63 else None


def first_centroids(vectors: DataFrame, vector_col: str, order: Column, k: int, dimensions: int = DIMENSIONS) -> list[list[int]]:
    """The whole numbers of the ``k`` vectors that come first by ``order`` (ties: by their components), at most ``k`` rows in memory."""

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, _ = whole_numbers(batch.column("v"), dimensions)
            yield batch.filter(pa.array(kept))

    rows = vectors.select(order.alias("o"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("o").isNotNull() & (F.size("v") == dimensions))
    rows = rows.mapInArrow(valid, "o string, v array<double>").orderBy("o", "v").limit(k).collect()
    return [[int(x) for x in r] for r in whole_numbers(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), dimensions)[1]] if rows else []


def moved(vectors: DataFrame, vector_col: str, centroids: list[list[int]], dimensions: int = DIMENSIONS) -> list[list[int]]:
    """Each centroid replaced by the floor of the mean of the vectors nearest to it; a centroid without any stays.

    Each task sends the sums of its vectors, a row for each centroid; the rows of a centroid are added up exactly. Sums
    travel as text, so they have no bound.
    """
    bisectors = Bisectors(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * dimensions for _ in centroids], [0] * len(centroids)
        for _, values, winner, _ in _assigned(batches, vector_col, bisectors, dimensions):
            for c in np.unique(winner):
                own = values[winner == c]
                counts[c] += len(own)
                sums[c] = [a + int(b) for a, b in zip(sums[c], own.sum(axis=0), strict=True)]
        some = [c for c, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_pydict({"c": pa.array(some, pa.int32()), "n": pa.array([counts[c] for c in some], pa.int64()), "s": pa.array([[str(x) for x in sums[c]] for c in some], pa.list_(pa.string()))})

    def merged(parts: pa.Table) -> pa.Table:
        sums = [0] * dimensions
        for row in parts.column("s"):
            sums = [a + int(b) for a, b in zip(sums, row.as_py(), strict=True)]
        n = sum(parts.column("n").to_pylist())
        return pa.table({"c": parts.column("c")[:1], "s": pa.array([[str(x // n) for x in sums]], pa.list_(pa.string()))})

    parts = vectors.select(vector_col).mapInArrow(partial, "c int, n long, s array<string>")
    new = {r["c"]: [int(x) for x in r["s"]] for r in parts.groupBy("c").applyInArrow(merged, "c int, s array<string>").collect()}  # a row a centroid
    return [new.get(c, old) for c, old in enumerate(centroids)]


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: str = "2"
) -> DataFrame:
    """A row per vector of ``dimensions`` finite components: its cluster after ``rounds`` rounds of k-means over whole numbers.

    Components become floor(256 * x). The first centroids are the ``k`` vectors whose ``<seed>:<id>`` has the smallest
    sha256, numbered in that order. For all pairs of centroids the normal and the threshold of the plane between them are
    integers, computed once a round; each vector then passes k - 1 sign tests, the winner so far against the next
    centroid, where zero favours the smaller number, so ties need no rule of their own. Distances are exact. Every round
    reads the vectors once and shuffles a row per task and centroid; nothing else moves, so no cluster can be too large.

    Vectors that are null, of another length or hold null or non-finite components are left out. Rows with a null id are
    clustered, but start no centroid; repeated rows are clustered each. With fewer vectors than ``k`` there are as many
    centroids; without any there are no rows. Further columns are ignored. Distances and sums of distances beyond a long
    are null. Broadcasts are ``k`` rows.

    Returns: key, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_cluster.
    """
    ship(vectors.sparkSession)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    rows = vectors.select(F.col(id_col).alias("key"), F.col(vector_col).alias("v"))
    centroids = first_centroids(vectors, vector_col, name, k, dimensions)
    key = rows.schema["key"]
    schema = T.StructType([T.StructField("key", key.dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.StringType())])
    if not centroids:
        found = rows.where(F.lit(False)).select("key", F.lit(0).alias("cluster"), F.lit("0").alias("distance"))
    else:
        for _ in range(rounds):
            centroids = moved(rows, "v", centroids, dimensions)
        bisectors = Bisectors(centroids)

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _, winner, distance in _assigned(batches, "v", bisectors, dimensions):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(winner, pa.int32()), pa.array([str(x) for x in distance], pa.string())], ["key", "cluster", "distance"])

        found = rows.mapInArrow(last, schema)
    found, _ = counted(found)
    # digits beyond a decimal's 38 don't occur in sums that fit a long; such distances count as null
    wide = F.when(F.length("distance") <= 27, F.col("distance").cast("decimal(28,0)"))
    sums = found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(wide).alias("s"), F.count_if(wide.isNull()).alias("lost")).collect()  # a row a cluster
    total, lost = sum(int(r["s"] or 0) for r in sums), any(r["lost"] for r in sums)
    rows = [(r["cluster"], r["n"], None if r["lost"] else _long(int(r["s"])), None if lost else _long(total), centroid_digest(centroids[r["cluster"]])) for r in sums]
    clusters = vectors.sparkSession.createDataFrame(rows, "cluster int, n_cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    distance = F.when(wide <= F.lit((1 << 63) - 1).cast("decimal(28,0)"), wide.cast("long")).alias("distance")
    return found.select("key", "cluster", distance).join(F.broadcast(clusters), "cluster").select("key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_cluster")
