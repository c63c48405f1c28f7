"""Image files: decoded in tasks by Spark's image source, written as PNG by the tasks that hold them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .image_lists import write_files


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image) of all files under a folder, decoded by the tasks that read them; what isn't an image is null."""
    found = spark.read.format("image").option("recursiveFileLookup", True).load(folder)
    return found.select(F.col("image.origin").alias("path"), F.when(F.col("image.height") > 0, F.col("image")).alias("image"))


def pixels(image: dict[str, Any]) -> np.ndarray:
    """(height, width, channels) of a decoded image; colours are red, green, blue and, where there is one, alpha."""
    x = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    return (x if x.shape[2] < 3 else np.concatenate([x[:, :, 2::-1], x[:, :, 3:]], axis=2)).astype(float)


def png(x: np.ndarray) -> bytes:
    """An image of one channel (grey) or three (red, green, blue) of bytes as a PNG file."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width, channels = x.shape
    lines = b"".join(b"\0" + line.tobytes() for line in x.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_images(rows: DataFrame, folder: str) -> None:
    """Rows (path, height, width, values), values from 0 to 255 pixel by pixel, each as a PNG file under the folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [png(np.array(r["values"]).reshape(r["height"], r["width"], -1)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(files, pa.binary())], ["path", "content"])

    write_files(rows.select("path", "height", "width", "values").mapInArrow(encode, "path string, content binary"), folder)
