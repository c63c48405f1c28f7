"""Aggregates of vectors: a partial result per task, merged in steps, so that no row per number is made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks among which the partial results are dealt in the first step.
FAN = 16

Fold = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def merged(parts: DataFrame, fold: Fold, fan: int = FAN, whole: bool = True) -> DataFrame:
    """The partial rows of all tasks, folded in ``fan`` tasks as they come in and then, with ``whole``, in one."""
    first = parts.repartition(fan).mapInArrow(fold, parts.schema)
    return first.repartition(1).mapInArrow(fold, parts.schema) if whole else first


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of ``dim`` numbers without nulls as rows of a matrix; others are left out."""
    column = column.filter(column.is_valid()).cast(pa.large_list(pa.float64()))
    starts, values = column.offsets.to_numpy(), column.values
    holes = np.append(0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False)))
    good = (np.diff(starts) == dim) & (holes[starts[1:]] == holes[starts[:-1]])
    return values.to_numpy(zero_copy_only=False)[starts[:-1][good][:, None] + np.arange(dim)] if good.any() else np.empty((0, dim))


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], tuple[float, np.ndarray]], size: int, fan: int = FAN, tasks: int | None = None) -> tuple[float, np.ndarray]:
    """The sums of a value and of a vector of ``size`` numbers that ``part`` gives for each batch; ``fan`` vectors come to the driver.

    Where the rows are known to be in no more than ``fan`` ``tasks``, these send their sums themselves.
    """

    def table(pairs: Iterator[tuple[float, np.ndarray]]) -> pa.Table:
        value, slope = 0.0, np.zeros(size)
        for v, g in pairs:
            value, slope = value + v, slope + g
        return pa.table({"value": pa.array([value]), "slope": pa.array([slope.tobytes()], pa.binary())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[float, np.ndarray]]:
        return ((v.as_py(), np.frombuffer(g.as_buffer())) for b in batches for v, g in zip(b.column("value"), b.column("slope"), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from table(part(b) for b in batches).to_batches()

    parts = rows.mapInArrow(run, "value double, slope binary")
    if tasks is None or tasks > fan:
        parts = merged(parts, lambda batches: table(read(batches)).to_batches(), fan, whole=False)
    done = table(read(parts.toArrow().to_batches()))
    return done.column("value")[0].as_py(), np.frombuffer(done.column("slope")[0].as_buffer())


def pooled(vectors: DataFrame, how: str, column: str = "embedding") -> DataFrame:
    """One row: the element-wise mean (``avg``) or maximum (``max``) of all vectors; null if there is no number.

    Null vectors and numbers are left out; of vectors of different lengths each place counts those that have it. A task
    sends a sum, a count and a maximum for each place.
    """

    def reduced(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums, counts, tops = np.empty(0), np.empty(0), np.empty(0)
        for s, n, m in parts:
            more = max(len(s), len(sums))
            sums, counts = (np.pad(x, (0, more - len(x))) + np.pad(y, (0, more - len(y))) for x, y in ((sums, s), (counts, n)))
            tops = np.maximum(*(np.pad(x, (0, more - len(x)), constant_values=-np.inf) for x in (tops, m)))
        return sums, counts, tops

    def of_batch(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        values = values.filter(values.is_valid())
        starts = values.offsets.to_numpy()
        flat, null = values.values.to_numpy(zero_copy_only=False), values.values.is_null().to_numpy(zero_copy_only=False)
        sizes = np.diff(starts)
        for size in np.unique(sizes[sizes > 0]):
            at = starts[:-1][sizes == size][:, None] + np.arange(size)
            x, gone = flat[at], null[at]
            yield np.where(gone, 0, x).sum(axis=0), (~gone).sum(axis=0).astype(float), np.where(gone, -np.inf, x).max(axis=0)

    names = ("sums", "counts", "tops")

    def table(found: tuple[np.ndarray, ...]) -> pa.Table:
        return pa.table({k: pa.array([x], pa.list_(pa.float64())) for k, x in zip(names, found, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from table(reduced(p for b in batches for p in of_batch(b.column("v")))).to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(b.column(k)[i].values.to_numpy() for k in names) for b in batches for i in range(b.num_rows))
        yield from table(reduced(rows)).to_batches()

    parts = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, ", ".join(f"{k} array<double>" for k in names))
    one = merged(parts, merge)
    value = F.try_divide if how == "avg" else lambda s, n: F.when(n > 0, s)
    each = F.transform(F.arrays_zip(F.col({"avg": "sums", "max": "tops"}[how]).alias("x"), F.col("counts").alias("n")), lambda e: value(e["x"], e["n"]))
    return one.select(F.when(F.size("counts") > 0, each).alias(column))
