"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.indexing import checkpoint_folder
from sightline.session import ship

__all__ = ["BROADCAST_ROWS", "scratch", "sent_if_small", "ship", "table"]

#: Rows of a few ids each that are broadcast at most, some 25 MB; more are joined by shuffling.
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors share."""
    return checkpoint_folder(spark)


def sent_if_small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, whose number has been counted, to be broadcast where they are few; else as they are."""
    return F.broadcast(df) if rows <= most else df
