"""Model outputs that are registered, and tables that are listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """Metadata tables kept as Parquet."""
    return [spark.read.parquet(f"{folder}/{x}") for x in names]


def add_model_output(items: DataFrame, name: str, paths: DataFrame | None = None, image_list: DataFrame | None = None, embeddings: str | None = None, scores: str | None = None) -> DataFrame:
    """(model, row_idx, item_id): which item each row of an output's files belongs to.

    Rows come from ``paths`` (row_idx, path) or an image list (row_idx, identifier). A row that names no item fails the query.
    """
    if not (embeddings or scores):
        raise ValueError("embeddings or scores are needed")
    if paths is None and image_list is None:
        raise ValueError("paths or an image list are needed")
    rows, key = (paths, "path") if paths is not None else (image_list, "identifier")
    found = rows.select("row_idx", key).join(items.select(key, "item_id"), key, "left")
    known = F.coalesce("item_id", F.raise_error(F.concat(F.lit("no item has "), F.coalesce(key, F.lit("null")))).cast("long"))
    return found.select(F.lit(name).alias("model"), "row_idx", known.alias("item_id"))


def paths_in_order(table: DataFrame, column: str = "paths") -> DataFrame:
    return table.select(F.posexplode(column).alias("row_idx", "path"))


def insert_if_absent(outputs: DataFrame, jobs: DataFrame) -> DataFrame:
    """The outputs, and those of jobs (dataset, name, finished, failed, ...) that finished well and aren't there yet."""
    done = jobs.where("finished and not failed").join(outputs.select("dataset", "name"), ["dataset", "name"], "left_anti").select(outputs.columns)
    return outputs.unionByName(done.dropDuplicates(["dataset", "name"]))
