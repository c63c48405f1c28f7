"""Directories of images, and the text files that list them."""

from __future__ import annotations

from collections.abc import Iterator
from io import BufferedReader

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import export_path
from ..operators.indexing import running_totals
from .files import located, parts_of

IMAGE = r"\.(jpg|JPG|jpeg|JPEG|png|PNG)$"


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    """Files under a folder. The driver lists folders down to ``depth`` levels only; tasks list what is in them."""

    def __init__(self, options: dict):
        self.path, self.depth = options["path"], int(options.get("depth", 1))

    def partitions(self) -> list[Folder]:
        store, root = located(self.path.rstrip("/") or "/")
        found, level = [], [root]
        for _ in range(self.depth):
            found += [Folder(x, False) for x in level]
            level = [x.path for own in level for x in store.get_file_info(fs.FileSelector(own)) if x.type == fs.FileType.Directory]
        return found + [Folder(x, True) for x in level]

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        own = [part.path]
        while own:  # a folder at a time, so that a task holds the names of one
            listing = store.get_file_info(fs.FileSelector(own.pop()))
            files = [x for x in listing if x.type == fs.FileType.File]
            own += [x.path for x in listing if part.deep and x.type == fs.FileType.Directory]
            if files:
                yield pa.RecordBatch.from_pydict({"path": pa.array([x.path for x in files]), "size": pa.array([x.size for x in files], pa.int64())})


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, size long"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def listed_files(spark: SparkSession, directory: str, depth: int = 1) -> DataFrame:
    """(path, size) of all files under a directory, by path or URI; ``depth`` levels of folders become tasks that list the rest."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder_listing").option("depth", depth).load(directory)


def scan_items(spark: SparkSession, train_dir: str, val_dir: str | None = None, reproducible: bool = True, depth: int = 1) -> DataFrame:
    """(path, identifier, is_val) of the images under the directories; contents aren't read, and the driver doesn't hold the listing."""

    def files(directory: str, is_val: bool) -> DataFrame:
        name = F.sha2("path", 256) if reproducible else F.expr("uuid()")
        return listed_files(spark, directory, depth).where(F.col("path").rlike(IMAGE)).select("path", name.alias("identifier"), F.lit(is_val).alias("is_val"))

    found = files(train_dir, False)
    return found.unionByName(files(val_dir, True)) if val_dir else found


class LineRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int, before: int):
        self.path, self.start, self.stop, self.before = path, start, stop, before


class LineReader(DataSourceReader):
    """Lines of a file, or of a folder's parts in order of their names, by byte range: a line belongs to the range in which it begins."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("step", 64 << 20))

    def partitions(self) -> list[LineRange]:
        found, before = [], 0
        for path, size in parts_of(self.path):
            found += [LineRange(path, a, min(a + self.step, size), before) for a in range(0, size, self.step)]
            before += size
        return found or [LineRange("", 0, 0, 0)]

    def read(self, part: LineRange) -> Iterator[tuple[int, str]]:
        if part.stop == 0:
            return
        store, _ = located(self.path)
        with store.open_input_file(part.path) as raw:
            at = max(0, part.start - 1)
            raw.seek(at)
            f = BufferedReader(raw, 1 << 20)
            if part.start:
                at += len(f.readline())  # the end of a line that began before
            while at < part.stop and (line := f.readline()):
                yield part.before + at, line.decode().rstrip("\r\n")
                at += len(line)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_lines"

    def schema(self) -> str:
        return "byte_offset long, line string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def numbered_lines(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """(row_idx, line) of a list file, numbered from 0.

    A list of under 100 MB is one row while it is split; a large one is read by byte ranges and numbered by prefix sums, and
    may be a folder of parts, as written by many tasks: they follow each other in order of their names.
    """
    if large:
        spark.dataSource.register(LineSource)
        lines = spark.read.format("text_lines").load(path)
        return running_totals(lines, ["byte_offset"], index="row_idx").select("row_idx", "line")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("row_idx", "line")).select(F.col("row_idx").cast("long").alias("row_idx"), "line")


def read_image_list(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """(row_idx, split, identifier, path) of lines ``split identifier path``; the path may hold spaces."""
    pattern = r"^(\S*) (\S*) (.*)$"
    lines = numbered_lines(spark, path, large).where(F.trim("line") != "")
    return lines.select("row_idx", *(F.regexp_extract("line", pattern, k).alias(n) for k, n in ((1, "split"), (2, "identifier"))), F.trim(F.regexp_extract("line", pattern, 3)).alias("path"))


def image_list_lines(items: DataFrame) -> DataFrame:
    return items.select(F.concat_ws(" ", F.when(F.col("is_val"), "val").otherwise("train"), "identifier", "path").alias("value"))


def write_image_list(items: DataFrame, path: str) -> None:
    image_list_lines(items).write.text(path)


def read_file_list(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """(row_idx, line): lines up to the first blank one, without the white space around them."""
    lines = numbered_lines(spark, path, large).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    blank = lines.where("line = ''").agg(F.min("row_idx").alias("stop"))
    return lines.crossJoin(F.broadcast(blank)).where("stop is null or row_idx < stop").drop("stop")


def export_paths(items: DataFrame) -> DataFrame:
    split = F.when(F.col("is_val"), "val").otherwise("train")
    return items.select("item_id", export_path(split, F.col("path")).alias("export_path"))


def write_files(rows: DataFrame, folder: str) -> None:
    """Rows (path, content): each content as a file under the folder (a path that all executors see, or a URI), written by its own task."""

    def write(part: Iterator) -> None:
        store, root = located(folder)
        for row in part:
            path = f"{root}/{row['path']}"
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path) as f:
                f.write(row["content"])

    rows.select("path", "content").foreachPartition(write)
