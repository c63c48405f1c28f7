"""Embedding and inference jobs, element maps that survive failures, and reductions."""

from __future__ import annotations

import hashlib
import os
import pickle
import socket
import time
import traceback
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .indexing import running_totals
from .partials import pooled
from .ranking import measured, vectors_of


class Embedder(Protocol):
    """Turns a batch of inputs into vectors of ``dim`` numbers. ``open`` is called once a task, before the first batch."""

    dim: int

    def open(self) -> None: ...

    def embed(self, inputs: list) -> np.ndarray: ...


class HashingEmbedder:
    """Text embedder without a model: signed counts of hashed words, scaled to length 1. Texts without words are zero.

    A word's place and sign come from the first 52 bits of its MD5. The words of a batch are hashed once each.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def open(self) -> None:
        pass

    def embed(self, inputs: list) -> np.ndarray:
        words = [(text or "").lower().split() for text in inputs]
        text = np.repeat(np.arange(len(inputs)), [len(x) for x in words])
        which, distinct = pd.factorize(np.array([w for x in words for w in x], object))
        h = np.array([int(hashlib.md5(w.encode()).hexdigest()[:13], 16) for w in distinct], np.int64)
        at, sign = (h % self.dim)[which], np.where(h >> 51, 1.0, -1.0)[which]
        out = np.bincount(text * self.dim + at, sign, len(inputs) * self.dim).reshape(len(inputs), self.dim)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.maximum(size, 1e-12)).astype(np.float32)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image of any number of channels at another size, interpolated between the four nearest pixels' centres."""

    def ends(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = ends(image.shape[0], height), ends(image.shape[1], width)
    rows = image[y0] * (1 - fy)[:, None, None] + image[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


class CroppedImages:
    """Embeds image bytes with a pluggable decoder and model: crop by fractions (x1, y1, x2, y2), resize, normalise, then pool and scale.

    ``decode`` gives (height, width, channels); ``size`` is (height, width); ``mean`` and ``std`` are by channel. A query image
    goes the same way as the images of a job.
    """

    def __init__(
        self, decode: Callable[[bytes], np.ndarray], model: Callable[[np.ndarray], np.ndarray], dim: int, unit: bool = False, size: tuple[int, int] | None = None,
        mean: list[float] | float = 0.0, std: list[float] | float = 1.0,
    ):
        self.decode, self.model, self.dim, self.unit, self.size, self.mean, self.std = decode, model, dim, unit, size, mean, std

    def open(self) -> None:
        pass

    def embed(self, inputs: list) -> np.ndarray:
        out = []
        for data, crop in inputs:
            image = self.decode(data)
            if crop is not None:
                h, w = image.shape[:2]
                x1, y1, x2, y2 = crop
                image = image[int(y1 * h) : max(int(y2 * h), int(y1 * h) + 1), int(x1 * w) : max(int(x2 * w), int(x1 * w) + 1)]
            image = resized(image, *self.size) if self.size else image
            v = np.asarray(self.model((image - np.asarray(self.mean)) / np.asarray(self.std)), float)
            v = v.mean(axis=tuple(range(v.ndim - 1))) if v.ndim > 1 else v
            out.append(v / max(np.linalg.norm(v), 1e-12) if self.unit else v)
        return np.stack(out).astype(np.float32) if out else np.empty((0, self.dim), np.float32)


def embed_images(images: DataFrame, embedder: CroppedImages, id_col: str = "item_id", image_col: str = "image", crop_col: str | None = None, batch: int = 32) -> DataFrame:
    """(item_id, embedding) of images, decoded or as bytes, each cropped to its struct (x1, y1, x2, y2) of fractions.

    A null image has no embedding (null); a null crop, or one with a null in it, is the whole image. Images go to the model ``batch`` at a time.
    """
    kind = images.schema[id_col].dataType.simpleString()
    crop = F.col(crop_col) if crop_col else F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    rows = images.select(F.col(id_col).alias("item_id"), F.col(image_col).alias("image"), crop.alias("crop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder.open()
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                part = whole.slice(a, batch)
                given = [(x, None if c is None or None in c.values() else tuple(c[k] for k in ("x1", "y1", "x2", "y2"))) for x, c in zip(part.column("image").to_pylist(), part.column("crop").to_pylist(), strict=True)]
                found = iter(embedder.embed([x for x in given if x[0] is not None]).tolist())
                out = [None if x is None else next(found) for x, _ in given]
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(out, pa.list_(pa.float32()))], ["item_id", "embedding"])

    return rows.mapInArrow(run, f"item_id {kind}, embedding array<float>")


def embed(items: DataFrame, embedder: Embedder, input_col: str, id_col: str = "item_id", batch: int = 32) -> DataFrame:
    """(item_id, embedding): one pass over the items, in batches; the embedder is opened once a task."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder.open()
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                yield pd.DataFrame({"item_id": part["item_id"], "embedding": list(embedder.embed(part["input"].tolist()))})

    return items.select(F.col(id_col).alias("item_id"), F.col(input_col).alias("input")).mapInPandas(run, f"item_id {kind}, embedding array<float>")


def infer(embeddings: DataFrame, weights: list[float], bias: float = 0.0) -> DataFrame:
    """Scores of a linear model: (item_id, embedding, score), a batch at a time; null for vectors that are null or of another length."""
    w = np.array(weights, float)
    rows = embeddings.select("item_id", "embedding", F.col("embedding").cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(measured(vectors_of(batch.column("x"), len(w)), w, "dot") + bias, from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("embedding"), score], ["item_id", "embedding", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType())]))


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def map_elements(rows: DataFrame, function: Callable[[Any], Any], input_col: str, id_col: str = "item_id", output: str = "double", setup: Callable[[], None] | None = None) -> DataFrame:
    """(id, output, status, error): an element that fails is skipped alone, not fatal; a null output counts as skipped.

    The error is its kind and message, with the trace where a task meets the kind for the first time.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if setup:
            setup()
        met: set[type] = set()
        for f in frames:
            out = []
            for key, x in zip(f["id"], f["input"], strict=True):
                try:
                    y = function(x)
                    out.append((key, y, "skipped" if y is None else "processed", None))
                except Exception as e:  # the job goes on without this element
                    out.append((key, None, "skipped", _said(e) if type(e) in met else traceback.format_exc(limit=3)))
                    met.add(type(e))
            yield pd.DataFrame(out, columns=["id", "output", "status", "error"])

    return rows.select(F.col(id_col).alias("id"), F.col(input_col).alias("input")).mapInPandas(run, f"id {kind}, output {output}, status string, error string")


def tallies(mapped: DataFrame) -> DataFrame:
    """By task: how many elements it processed and skipped."""
    return mapped.groupBy(F.spark_partition_id().alias("task")).agg(F.count_if(F.col("status") == "processed").alias("processed"), F.count_if(F.col("status") == "skipped").alias("skipped"))


class Mapper:
    """What a job does with chunks of elements; override what is needed. Instances are sent to the tasks.

    ``open`` is called once a task, then ``start`` with the job's arguments; what it returns is handed to all later calls.
    ``chunk`` gives an output for each input, ``finish`` an output of the whole chunk and the final outputs.
    """

    def __init__(self) -> None:
        self.timings: dict[str, list[float]] = {}

    def open(self) -> None:
        pass

    def start(self, args: Any) -> Any:
        return args

    def element(self, x: Any, job: Any) -> Any:
        raise NotImplementedError

    def chunk(self, inputs: list, job: Any) -> list:
        return [self.element(x, job) for x in inputs]

    def finish(self, inputs: list, outputs: list, job: Any) -> tuple[Any, list]:
        return None, outputs

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        """Measures what is done inside, as one more timing of that name in the job's profile."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timings.setdefault(name, []).append(time.perf_counter() - began)


class Progress:
    """How far a running job is, read by the driver while it runs: tasks report what they have done as they end.

    A task that runs again after its executor was lost reports again; final counts are those of ``job_counts``.
    """

    def __init__(self, spark: SparkSession, n_total: int | None = None):
        sc = spark.sparkContext
        self.n_total, self.began = n_total, time.monotonic()
        self.processed, self.skipped = sc.accumulator(0), sc.accumulator(0)

    def status(self) -> dict[str, Any]:
        n, elapsed = self.processed.value + self.skipped.value, time.monotonic() - self.began
        out = {"n_processed": self.processed.value, "n_skipped": self.skipped.value, "elapsed_time": elapsed}
        if self.n_total is not None:
            out |= {"n_total": self.n_total, "finished": n >= self.n_total, "time_left": time_left(n, max(0, self.n_total - n), elapsed)}
        return out


CHUNK, RETRIES = 64, 3
#: Chunks are sent on together, up to so many elements or bytes of elements.
ELEMENTS, HELD = 4096, 8 << 20


def values_of(column: pa.Array) -> list:
    """What ``to_pylist`` gives, faster for numbers and for structs of them."""
    kind = column.type
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        rows = [dict(zip(names, x, strict=True)) for x in zip(*(values_of(c) for c in column.flatten()), strict=True)]
        return rows if not column.null_count else [x if good else None for x, good in zip(rows, column.is_valid().to_pylist(), strict=True)]
    if not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def map_chunks(
    rows: DataFrame, mapper: Mapper, input_col: str, id_col: str = "item_id", output: str = "double", args: Any = None, size: int = CHUNK, retries: int = RETRIES,
    order: list[str | Column] | None = None, chunk_output: str = "string", progress: Progress | None = None,
) -> DataFrame:
    """A row per chunk of ``size`` elements: what ``mapper`` made of it in at most ``retries`` attempts.

    A chunk that fails is tried again inside its task; after the last attempt it is skipped whole. So is a chunk whose
    mapper gives another number of outputs. A null output skips the element alone. With ``order``, chunks are the next
    ``size`` elements of the whole table in that order, numbered from 0 (elements are sorted once and dealt by chunk);
    without, they are cut from each task's own rows, the last of a task may be shorter, numbers have gaps and nothing is
    shuffled. Null inputs are handed on as None.

    Returns: chunk, worker, n, attempts, status, error (kind and message of the last failure), trace (of a task's first
    failure of a kind), seconds (of the last attempt), timings (map of lists), chunk_output, elements (array of id, output, status).
    """
    kind = rows.schema[id_col].dataType.simpleString()
    narrow = rows.select(F.col(id_col).alias("id"), F.col(input_col).alias("input"), *(c.alias(f"o{k}") if isinstance(c, Column) else F.col(c).alias(f"o{k}") for k, c in enumerate(order or [])))
    if order is None:
        planned = narrow.withColumn("chunk", F.shiftleft(F.spark_partition_id().cast("long"), 33))
    else:
        placed = running_totals(narrow, [f"o{k}" for k in range(len(order))])
        planned = placed.withColumn("chunk", F.floor(F.col("row_no") / size).cast("long")).repartition("chunk").sortWithinPartitions("chunk", "row_no")
    planned = planned.select("chunk", "id", "input")
    schema = T.StructType.fromDDL(
        f"chunk long, worker string, n int, attempts int, status string, error string, trace string, seconds double, timings map<string,array<double>>, chunk_output {chunk_output}, elements array<struct<id:{kind},output:{output},status:string>>"
    )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
        number, ids, inputs, cut = None, [], [], 0
        for batch in batches:
            for c, i, x in zip(*(values_of(batch.column(k)) for k in ("chunk", "id", "input")), strict=True):
                if ids and (len(ids) == size or c != number):
                    yield number + cut, ids, inputs
                    ids, inputs, cut = [], [], cut + (order is None)
                number = c
                ids.append(i)
                inputs.append(x)
        if ids:
            yield number + cut, ids, inputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, worker, met = to_arrow_schema(schema), f"{socket.gethostname()}:{os.getpid()}", set()
        whole_kind, element = fields.field("chunk_output").type, fields.field("elements").type.value_type
        mapper.timings = {}
        mapper.open()
        job = mapper.start(args)
        rows, wholes, parts, held = [], [], [], 0

        def sent() -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(x) for x in parts)], dtype=np.int32)
            columns = [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), fields, strict=False)]
            elements = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts)).cast(fields.field("elements").type)
            return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays(wholes), elements], schema=fields)

        for number, ids, inputs in chunks(batches):
            outputs, whole, error, trace, attempt = None, None, None, None, 0
            while outputs is None and attempt < retries:
                attempt += 1
                mapper.timings = {}
                began = time.perf_counter()
                try:
                    whole, found = mapper.finish(inputs, mapper.chunk(list(inputs), job), job)
                    if len(found) != len(inputs):
                        raise ValueError(f"{len(found)} outputs for {len(inputs)} inputs")
                    outputs = list(found)
                except Exception as e:  # tried again, then skipped whole
                    error, trace = _said(e), trace if type(e) in met else traceback.format_exc(limit=4)
                    met.add(type(e))
            seconds = time.perf_counter() - began
            good = outputs is not None
            states = ["skipped" if y is None else "processed" for y in outputs or [None] * len(ids)]
            if progress:
                progress.processed.add(states.count("processed"))
                progress.skipped.add(states.count("skipped"))
            part = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip((ids, outputs or [None] * len(ids), states), element, strict=True)], fields=list(element))
            rows.append((number, worker, len(ids), attempt, "processed" if good else "skipped", error, trace, seconds, list(mapper.timings.items())))
            wholes.append(pa.array([whole if good else None], whole_kind))
            parts.append(part)
            held += max(part.nbytes + wholes[-1].nbytes, len(part) * (HELD // ELEMENTS))
            if held >= HELD:
                yield sent()
                rows, wholes, parts, held = [], [], [], 0
        if rows:
            yield sent()

    return planned.mapInArrow(run, schema)


def elements(done: DataFrame) -> DataFrame:
    """(chunk, attempts, id, output, status): the elements of a job's chunks."""
    return done.select("chunk", "attempts", F.inline("elements"))


def timing_profile(done: DataFrame) -> DataFrame:
    """(name, n, mean, std) of the named timings of processed chunks, and of their ``total_time``."""
    good = done.where("status = 'processed'")
    named = good.select(F.explode("timings").alias("name", "all")).select("name", F.explode("all").alias("x"))
    every = named.unionByName(good.select(F.lit("total_time").alias("name"), F.col("seconds").alias("x")))
    return every.groupBy("name").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))


def utilisation(done: DataFrame) -> DataFrame:
    """(worker, chunks): how many chunks each worker process has processed."""
    return done.where("status = 'processed'").groupBy("worker").agg(F.count("*").alias("chunks"))


def job_counts(done: DataFrame) -> DataFrame:
    """One row: chunks, attempts, n_total, n_processed, n_skipped."""
    good = F.size(F.filter("elements", lambda e: e["status"] == "processed"))
    sums = {"attempts": F.col("attempts"), "n_total": F.col("n"), "n_processed": good, "n_skipped": F.col("n") - good}
    return done.agg(F.count("*").alias("chunks"), *(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in sums.items()))


def time_left(processed: int, remaining: int, elapsed: float) -> float:
    return remaining * elapsed / processed if processed else -1.0


def running_stats(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return rows.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"), F.coalesce(F.var_samp(c), F.lit(0.0)).alias("variance"),
        F.min(c).alias("min"), F.max(c).alias("max"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"),
    )


def pool(vectors: DataFrame, how: str = "avg", column: str = "embedding") -> DataFrame:
    """Element-wise mean or maximum of all vectors as one row; ``none`` leaves them as they are."""
    return vectors if how == "none" else pooled(vectors, how, column)


def top_k(rows: DataFrame, score: str, k: int, tie: str = "item_id") -> DataFrame:
    return rows.orderBy(F.desc(score), tie).limit(k)


def grouped_top_k(rows: DataFrame, keys: list[str], score: str, k: int, tie: str = "item_id") -> DataFrame:
    """The ``k`` highest of each group with their ``rank`` from 0: first of each task's own rows of a group, then of those.

    A row's number is compared as it is, so that Spark drops a task's lower rows before it shuffles them; where ``k`` is too
    large for that, the first step shuffles all rows, but spreads a group by the task that they come from.
    """

    def highest(some: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
        return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    own = highest(rows.withColumn("_task", F.spark_partition_id()), *keys, "_task").drop("_task", "rank")
    return highest(own, *keys).withColumn("rank", F.col("rank") - 1)


class Reducer(Protocol):
    """A reduction of one's own. ``output`` names and types the columns of a result; states are small and can be pickled."""

    output: str

    def start(self) -> Any: ...

    def add(self, state: Any, rows: pd.DataFrame) -> Any: ...

    def merge(self, state: Any, other: Any) -> Any: ...

    def finish(self, state: Any) -> tuple: ...


#: States of groups that a task holds before it sends them on.
STATES = 10_000


def reduced(rows: DataFrame, keys: list[str], reducer: Reducer) -> DataFrame:
    """(keys, output of the reducer): each task reduces its own rows of a group, then the states of a group are merged.

    A group's rows never meet, only a state for each task that has some; null keys are a group. Without keys all rows are one.
    """
    keys = keys or ["_all"]
    rows = rows if keys != ["_all"] else rows.withColumn("_all", F.lit(0))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, tuple[list, Any]] = {}

        def sent() -> pd.DataFrame:
            done = [(*key, pickle.dumps(state)) for key, state in states.values()]
            states.clear()
            return pd.DataFrame(done, columns=[*keys, "_state"])

        for f in frames:
            for _, part in f.groupby(keys, sort=False, dropna=False):
                key = [part[k].iloc[0] for k in keys]
                name = tuple(None if pd.isna(x) else x for x in key)
                state = states[name][1] if name in states else reducer.start()
                states[name] = (list(name), reducer.add(state, part))
            if len(states) > STATES:
                yield sent()
        yield sent()

    def final(f: pd.DataFrame) -> pd.DataFrame:
        state = None
        for i, x in enumerate(f["_state"]):
            state = reducer.merge(state, pickle.loads(x)) if i else pickle.loads(x)
        return pd.DataFrame([(*(f[k].iloc[0] for k in keys), *reducer.finish(state))])

    done = rows.mapInPandas(partial, f"{kinds}, _state binary").groupBy(*keys).applyInPandas(final, f"{kinds}, {reducer.output}")
    return done.drop("_all")
