"""Readers of flat float32 matrices and ``.npy`` score arrays, split by rows."""

from __future__ import annotations

import ast
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import located, read_range, size_of


class Rows(InputPartition):
    def __init__(self, path: str, first: int, start: int, stop: int):
        self.path, self.first, self.start, self.stop = path, first, start, stop  # rows of a file whose first row is ``first``


class MatrixReader(DataSourceReader):
    """Row ranges of a file of fixed-size rows, or of a folder of such parts; tasks read the bytes of their own range.

    ``low`` and ``high`` bound the rows. They are options and not pushed filters: what a Python source takes over from one
    query's filter is kept for the next query on the same data frame.
    """

    STEP = 1 << 16

    def __init__(self, options: dict):
        self.path, self.dim, self.kind, self.skip = options["path"], int(options.get("dim", 1)), np.dtype(options.get("dtype", "<f4")), int(options.get("skip", 0))
        self.vector = options.get("vector", "true") == "true"
        self.low, self.high = int(options.get("low", 0)), int(options["high"]) if "high" in options else None

    def partitions(self) -> list[Rows]:
        out, width = [], self.kind.itemsize * self.dim
        for path, first, size in part_files(self.path):
            stop = first + (size - (self.skip if first == 0 else 0)) // width
            low, high = max(first, self.low), stop if self.high is None else min(stop, self.high)
            out += [Rows(path, first, a, min(a + self.STEP, high)) for a in range(low, high, self.STEP)]
        return out or [Rows(self.path, 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        width, n = self.dim * self.kind.itemsize, part.stop - part.start
        data = read_range(part.path, (self.skip if part.first == 0 else 0) + (part.start - part.first) * width, n * width) if n else b""
        data = np.frombuffer(data, self.kind).astype(np.float32)
        index = pa.array(np.arange(part.start, part.stop))
        if self.vector:
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.dim, pa.int32()), pa.array(data))
            yield pa.RecordBatch.from_arrays([index, values], ["row_idx", "embedding"])
        else:
            yield pa.RecordBatch.from_arrays([index, pa.array(data)], ["row_idx", "score"])


PART = re.compile(r"rows-(\d+)-[0-9a-f]+\.bin$")


def part_files(path: str) -> list[tuple[str, int, int]]:
    """(path, first row, bytes) of a file, or of the parts in a folder that its list of parts names, in order of their rows."""
    store, name = located(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, 0, info.size)]
    listed = read_range(f"{path}/parts", 0, size_of(f"{path}/parts")).decode().split()
    return [(f"{path}/{x}", int(PART.match(x)[1]), int(n)) for x, n in zip(listed[::2], listed[1::2], strict=True)]


class PartsWriter(DataSourceArrowWriter):
    """Writes each run of consecutive rows as a file of its own; at last the driver writes the list of those that count."""

    def __init__(self, options: dict):
        self.path, self.dim, self.header = options["path"], int(options.get("dim", 1)), bytes.fromhex(options.get("header", ""))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, name = located(self.path)
        store.create_dir(name, recursive=True)
        done, out, upto, at = [], None, -1, None
        try:
            for batch in batches:
                row, data = _numbers(batch, self.dim)
                for a, b in pairwise([*np.flatnonzero(np.append(True, np.diff(row) != 1)[: len(row)]).tolist(), len(row)]):
                    if row[a] != upto:
                        if out:
                            out.close()
                            done.append((at, upto))
                        at = f"rows-{int(row[a]):015d}-{uuid.uuid4().hex}.bin"
                        out = store.open_output_stream(f"{name}/{at}")
                        if row[a] == 0:
                            out.write(self.header)
                    out.write(data[a:b].tobytes())
                    upto = int(row[b - 1]) + 1
        finally:
            if out:
                out.close()
                done.append((at, upto))
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, name = located(self.path)
        parts = sorted((int(PART.match(x)[1]), x, stop) for m in messages if m for x, stop in m.parts)
        if any(stop != then for (_, _, stop), (then, _, _) in pairwise(parts)) or parts and parts[0][0]:
            raise ValueError("rows aren't numbered from 0 without gaps or repeats")
        if not parts:
            parts = [(0, f"rows-{0:015d}-{uuid.uuid4().hex}.bin", 0)]
            store.create_dir(name, recursive=True)
            with store.open_output_stream(f"{name}/{parts[0][1]}") as f:
                f.write(self.header)
        with store.open_output_stream(f"{name}/parts") as f:  # from now on the parts are there
            f.write("".join(f"{x} {(stop - first) * self.dim * 4 + (len(self.header) if first == 0 else 0)}\n" for first, x, stop in parts).encode())


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[str, int]]


def _numbers(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column(1)
    values = values.flatten() if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else values
    return batch.column(0).to_numpy(), values.to_numpy(zero_copy_only=False).astype("<f4").reshape(batch.num_rows, dim)


class MatrixWriter(DataSourceArrowWriter):
    """Writes rows at their place in one file, on a path that all executors see; to write one again changes nothing."""

    def __init__(self, options: dict):
        self.path, self.dim, self.skip = options["path"], int(options.get("dim", 1)), int(options.get("skip", 0))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        with open(re.sub(r"^file:/*", "/", self.path), "r+b") as f:
            for batch in batches:
                row, data = _numbers(batch, self.dim)
                runs = np.flatnonzero(np.append(True, np.diff(row) != 1)) if len(row) else []
                for a, b in zip(runs, [*runs[1:], len(row)]):
                    f.seek(self.skip + int(row[a]) * self.dim * 4)
                    f.write(data[a:b].tobytes())
        return WriterCommitMessage()


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "float_matrix"

    def schema(self) -> str:
        return "row_idx long, embedding array<float>" if self.options.get("vector", "true") == "true" else "row_idx long, score float"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PartsWriter(self.options) if self.options.get("parts", "false") == "true" else MatrixWriter(self.options)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(MatrixSource)
    return spark


def _bounds(low: int, high: int | None) -> dict[str, int]:
    return {"low": max(0, low)} | ({} if high is None else {"high": high})


def read_embedding_matrix(spark: SparkSession, path: str, rows: int, low: int = 0, high: int | None = None) -> DataFrame:
    """(row_idx, embedding) of a raw float32 matrix, a file or a folder of parts by path or URI.

    Its width follows from its size and the number of listed rows. Of a range of rows, from ``low`` to below ``high``, only its own bytes are read.
    """
    size = sum(n for *_, n in part_files(path))
    if rows <= 0 or size % (4 * rows):
        raise ValueError(f"{size} bytes aren't {rows} rows of float32")
    return _registered(spark).read.format("float_matrix").options(dim=size // (4 * rows), **_bounds(low, high)).load(path)


def _write(rows: DataFrame, path: str, header: bytes, parts: bool, **options) -> None:
    if parts:
        rows, options = rows.repartitionByRange("row_idx").sortWithinPartitions("row_idx"), options | {"parts": "true", "header": header.hex()}
    else:
        with open(re.sub(r"^file:/*", "/", path), "wb") as f:
            f.write(header)
    _registered(rows.sparkSession)
    rows.write.format("float_matrix").options(skip=len(header), **options).mode("append").save(path)


def write_embedding_matrix(rows: DataFrame, path: str, dim: int, parts: bool = False) -> None:
    """Rows (row_idx, embedding), numbered from 0 without gaps, as a raw float32 matrix.

    On a mounted path tasks write their own ranges of one file. With ``parts``, in any store, the matrix is a folder: tasks
    write a file for each run of rows, and the driver commits them by writing their list.
    """
    _write(rows.select("row_idx", F.col("embedding").cast("array<float>").alias("embedding")), path, b"", parts, dim=dim)


def write_scores(rows: DataFrame, path: str, n: int, parts: bool = False) -> None:
    """``n`` rows (row_idx, score), numbered from 0 without gaps, as a one-dimensional ``.npy`` array; ``parts`` as for matrices."""
    text = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({n},), }}"
    text += " " * (-(len(text) + 11) % 64) + "\n"
    _write(rows.select("row_idx", F.col("score").cast("float").alias("score")), path, b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text)) + text.encode(), parts)


def npy_header(path: str) -> tuple[int, np.dtype, tuple[int, ...]]:
    """Offset of the data, its type and shape."""
    store, name = located(part_files(path)[0][0])
    with store.open_input_file(name) as f:
        magic = f.read(8)
        if magic[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} isn't an .npy file")
        (size,) = struct.unpack("<H" if magic[6] == 1 else "<I", f.read(2 if magic[6] == 1 else 4))
        header = ast.literal_eval(f.read(size).decode("latin1"))
        return f.tell(), np.dtype(header["descr"]), header["shape"]


def read_scores(spark: SparkSession, path: str, low: int = 0, high: int | None = None) -> DataFrame:
    """(row_idx, score) of a one-dimensional ``.npy`` array, or of its rows from ``low`` to below ``high``."""
    skip, kind, shape = npy_header(path)
    if len(shape) != 1:
        raise ValueError(f"{path} has shape {shape}, not one dimension")
    return _registered(spark).read.format("float_matrix").options(vector="false", skip=skip, dtype=kind.str, **_bounds(low, high)).load(path)


def aligned(values: DataFrame, image_list: DataFrame, items: DataFrame) -> DataFrame:
    """Values by item: rows of a matrix or score file joined to the list lines and the items that they name."""
    return values.join(image_list.select("row_idx", "identifier"), "row_idx").join(items.select("identifier", "item_id"), "identifier").drop("row_idx", "identifier")
