"""Similarity search, rankings, pages and slices of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import public_path
from ..session import ship
from .annotations import per_item
from .clustering import page_clusters
from .indexing import checkpointed, running_totals
from .items import in_range
from .partials import pooled

PAGE = 500
#: First rows of an order that every task may keep; beyond, the order is made by a range partitioning.
FIRST_ROWS = 100_000


def query_vector(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: the element-wise mean of the query vectors."""
    return pooled(vectors, "avg", column).withColumnRenamed(column, "query")


def measured(vectors: list[np.ndarray | None], query: np.ndarray, metric: str) -> np.ndarray:
    """Distance or dot product of each vector and the query; a row is summed up from first to last, as SQL engines do."""
    out = np.full(len(vectors), np.nan)
    mine = [i for i, v in enumerate(vectors) if v is not None and len(v) == len(query)]
    if mine and len(query):
        x = np.stack([vectors[i] for i in mine]).astype(float)
        total = np.cumsum((x - query) ** 2 if metric == "l2" else x * query, axis=1)[:, -1]
        out[mine] = np.sqrt(total) if metric == "l2" else total
    return out


def vectors_of(column: pa.Array, dim: int) -> list[np.ndarray | None]:
    """The vectors of a column of lists, at once where all have ``dim`` numbers."""
    whole = column.flatten().to_numpy(zero_copy_only=False) if not column.null_count else np.empty(0)
    if dim and len(column) and whole.size == len(column) * dim and (np.diff(column.offsets.to_numpy()) == dim).all():
        return list(whole.reshape(len(column), dim))
    return [np.array(x.as_py(), float) if x.is_valid else None for x in column]


def distances(embeddings: DataFrame, query: DataFrame, metric: str = "l2") -> DataFrame:
    """Rows (item_id, dist) over all embeddings, computed a batch at a time; the query is one row.

    Null vectors, and those of another length than the query, have no distance (null).
    """
    if metric not in ("l2", "dot"):
        raise ValueError(metric)
    ship(embeddings.sparkSession)
    row = query.first()
    q = np.array(row["query"] if row and row["query"] is not None else [], float)
    kind = embeddings.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id"), "dist": pa.array(measured(vectors_of(batch.column("embedding"), len(q)), q, metric), from_pandas=True)})

    return embeddings.select("item_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"item_id {kind}, dist double")


def normalised(scored: DataFrame, column: str = "dist") -> DataFrame:
    """Scales a column to [0, 1] by its least and greatest value over all rows; where these are equal it is null."""
    ends = scored.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    return scored.crossJoin(F.broadcast(ends)).withColumn(column, F.try_divide(F.col(column) - F.col("_low"), F.col("_high") - F.col("_low"))).drop("_low", "_high")


def knn(items: DataFrame, embeddings: DataFrame, query: DataFrame, metric: str = "l2", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Items with their normalised distance within the range, unordered; ``order`` says how they rank.

    Distances are computed once, then normalised over the whole embedding set, before items are filtered. A set whose
    distances are all equal gives no items.
    """
    found = normalised(checkpointed(distances(embeddings, query, metric))).where(in_range(F.col("dist"), low, high))
    return items.join(found, "item_id")


def order(metric: str = "l2") -> list[Column]:
    """Nearest first: ascending for distances, descending for dot products and scores; ties by item_id."""
    return [F.col("dist").asc() if metric == "l2" else F.col("dist").desc(), F.col("item_id").asc()]


def score_ranking(items: DataFrame, scores: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Items with their model score as ``dist``, not normalised, within the range."""
    return items.join(scores.select("item_id", F.col("score").cast("double").alias("dist")).where(in_range(F.col("dist"), low, high)), "item_id")


def browse(items: DataFrame, how: str = "id", seed: int = 0) -> DataFrame:
    """Items with distance -1 and a sort key: the id, or a seeded hash of it for a repeatable random order."""
    key = F.col("item_id").cast("string") if how == "id" else F.md5(F.concat_ws("|", F.col("item_id").cast("string"), F.lit(str(seed))))
    ordered = items.withColumn("dist", F.lit(-1.0))
    return ordered.withColumn("sort_key", F.lpad(key, 20, "0") if how == "id" else key)


def top(found: DataFrame, k: int, by: list[Column]) -> DataFrame:
    """The first ``k`` rows; Spark keeps ``k`` rows a task and doesn't sort the rest."""
    return found.orderBy(*by).limit(k)


def ranked(found: DataFrame, by: list[Column | str]) -> DataFrame:
    """Adds ``rank`` from 0 over all rows, without gathering them in one task."""
    return running_totals(found, by, index="rank")


def page(found: DataFrame, number: int, by: list[Column | str], size: int = PAGE) -> DataFrame:
    """The rows of one page of an order, with ``rank``. Early pages need no sort of what comes after them."""
    start = number * size
    if start + size > FIRST_ROWS:
        return ranked(found, by).where(F.col("rank").between(start, start + size - 1))
    rows = found.orderBy(*by).offset(start).limit(size)
    return rows.withColumn("rank", (F.row_number().over(Window.orderBy(*by)) - 1 + start).cast("long"))  # a page of rows


def hydrated(page_rows: DataFrame, items: DataFrame) -> DataFrame:
    """A page's rows (at most a page size of them, so they are broadcast) with their items and public paths, in order."""
    found = items.join(F.broadcast(page_rows.select("item_id", "rank", "dist")), "item_id")
    return found.withColumn("public_path", public_path(F.col("directory"), F.col("path"))).orderBy("rank")


def result_page(found: DataFrame, number: int, by: list[Column | str], items: DataFrame, annotations: DataFrame, embeddings: DataFrame, strength: float, size: int = PAGE) -> DataFrame:
    """(rank, item_id, public_path, tags, cluster): what a page of results shows; items without tags have an empty list."""
    rows = checkpointed(page(found, number, by, size).select("item_id", "rank", "dist"))
    mine = F.broadcast(rows.select("item_id"))
    tags = per_item(annotations.join(mine, "item_id", "left_semi")).select("item_id", "tags")
    vectors = embeddings.join(F.broadcast(rows), "item_id").select(F.lit(number).cast("long").alias("page"), "rank", "item_id", "embedding")
    clusters = page_clusters(vectors, strength).select("item_id", "cluster")
    shown = hydrated(rows, items).join(tags, "item_id", "left").join(clusters, "item_id", "left")
    none = F.array().cast("array<struct<category:string,value:string>>")
    return shown.select("rank", "item_id", "public_path", F.coalesce("tags", none).alias("tags"), "cluster").orderBy("rank")


def bounds(n: int | Column, low: float, high: float) -> tuple[Column, Column]:
    """Half-open rank bounds of the slice from ``low`` to ``high`` of a ranking of ``n``, in doubles."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("double")
    return F.ceil(n * (1.0 - F.lit(float(high)))), F.floor(n * (1.0 - F.lit(float(low))))


def percentile_slice(ranking: DataFrame, low: float, high: float) -> DataFrame:
    size = ranking.agg(F.count("*").alias("_n"))
    start, end = bounds(F.col("_n"), low, high)
    return ranking.crossJoin(F.broadcast(size)).where((F.col("rank") >= start) & (F.col("rank") < end)).drop("_n")


def stride_sample(items: DataFrame, target: int, by: list[str]) -> DataFrame:
    """Every stride-th row in order, the stride being the rows over the target, at least 1."""
    total = items.agg(F.greatest(F.floor(F.count("*") / target), F.lit(1)).alias("_stride"))
    return ranked(items, by).crossJoin(F.broadcast(total)).where(F.col("rank") % F.col("_stride") == 0).drop("_stride")


def first_rows(found: DataFrame, n: int, by: list[Column | str]) -> DataFrame:
    """The first ``n`` rows of an order, whether ``n`` is a few or grows with the data."""
    return top(found, n, by) if n <= FIRST_ROWS else ranked(found, by).where(F.col("rank") < n).drop("rank")


def best(scored: DataFrame, t: int, column: str = "score") -> DataFrame:
    """The ``t`` highest scores, ties by item_id; 0 keeps all."""
    return first_rows(scored, t, [F.col(column).desc(), F.col("item_id").asc()]) if t else scored


def to_label(queue: DataFrame, labelled: DataFrame, n: int = 10) -> DataFrame:
    """The next of a queue (item_id, rank) that aren't labelled yet."""
    return queue.join(labelled.select("item_id"), "item_id", "left_anti").orderBy("rank").limit(n)
