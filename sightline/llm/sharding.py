"""Contiguous shards of nearly equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.indexing import checkpointed, running_totals

from .common import ship

ROW_BYTES = 16


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed share for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def byte_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts the rows, ordered by id, into ``n_shards`` runs whose bytes are as equal as whole rows allow.

    Global prefix sums come from per-partition totals: the narrow rows (id, size, checksum) are range-partitioned and
    sorted once, the totals of the partitions (a row each) are summed up in order, and each partition then adds its own
    running sum to its offset. A row goes to the shard in which the middle of its bytes falls, so a shard differs from
    the target by less than the largest row.

    Texts are read once and don't move: only id, size and checksum are kept and shuffled. Ties of the id, repeated rows included, are ordered by
    checksum, size and input position, which also splits an id that holds a large share of all rows. Null ids come
    first; a null text counts as empty. An empty table gives no rows. Further columns of ``docs`` are ignored.

    Returns: key (the id), size, text_crc32, shard, slot (gapless from 0 in each shard).
    """
    ship(docs.sparkSession)
    text = F.col(text_col)
    narrow = docs.select(F.col(id_col).alias("key"), text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    placed = running_totals(checkpointed(narrow), ["key", "text_crc32", "size"], ("size",)).withColumn(
        "shard", F.expr(f"cast(((2 * size_before + size) * {n_shards}) div (2 * size_total) as int)")
    )
    firsts = placed.groupBy("shard").agg(F.min("row_no").alias("first_row"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "key", "size", "text_crc32", "shard", (F.col("row_no") - F.col("first_row")).alias("slot")
    )
