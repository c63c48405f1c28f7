"""Global positions and running totals without a single-task window."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import Row

#: Narrow rows that are worth a task of their own.
ROWS_PER_TASK = 1 << 16


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; where it names none, in local mode, a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes an intermediate table that has been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, so that later reads don't run what lies before again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame, **further: Column) -> tuple[DataFrame, Row]:
    """The rows, checkpointed, and what has been observed of them on the way: ``n``, their number, and further aggregates."""
    seen = Observation()
    done = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in further.items())))
    return done, Row(**{"n": 0, **dict.fromkeys(further), **seen.get})


def few_tasks(df: DataFrame, rows: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows in no more tasks than their number is worth, so that small intermediate results don't make many tiny files."""
    return df.coalesce(max(1, -(-rows // per_task)))


def running_totals(df: DataFrame, order: list[str | Column], sums: tuple[str, ...] = (), index: str = "row_no") -> DataFrame:
    """Adds ``index``, the 0-based position in the order, and ``<x>_before`` and ``<x>_total`` for each summed column.

    The rows are range-partitioned and sorted once; each partition's totals (one row a partition) are summed up in
    order; each partition then adds its own running sums to its offset. Ties are split by input position, so a value
    that holds a large share of the rows is spread too. Summed columns must not be null. Without any, the position in the
    partition is kept with the sorted rows and nothing goes through Python.
    """
    tie = "_position"
    ordered = df.withColumn(tie, F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    ordered = ordered.withColumn("_part", F.spark_partition_id())
    if not sums:  # the lower 33 bits number a partition's rows
        ordered = ordered.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ordered = checkpointed(ordered)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(x).cast("long").alias(f"_sum_{x}") for x in sums))
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
        *(F.coalesce(F.sum(f"_sum_{x}").over(before), F.lit(0)).alias(f"_first_{x}") for x in sums),
        *(F.sum(f"_sum_{x}").over(every).alias(f"{x}_total") for x in sums),
    )
    if not sums:
        return ordered.join(F.broadcast(parts), "_part").withColumn(index, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")
    own = [f.name for f in df.schema]
    totals = [f"{x}_total" for x in sums]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, done = 0, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = {x: batch.column(x) for x in [*own, *totals]}
            out[index] = batch.column("_first").to_numpy() + seen + np.arange(batch.num_rows)
            seen += batch.num_rows
            for x in sums:
                values = batch.column(x).to_numpy()
                ends = values.cumsum()
                out[f"{x}_before"] = batch.column(f"_first_{x}").to_numpy() + done[x] + ends - values
                done[x] += int(ends[-1])
            yield pa.RecordBatch.from_pydict(out)

    longs = [*totals, index, *(f"{x}_before" for x in sums)]
    schema = T.StructType([*df.schema, *(T.StructField(x, T.LongType()) for x in longs)])
    return ordered.join(F.broadcast(parts), "_part").mapInArrow(add, schema)
