"""The annotation log as a stream: running counts, and the state in force."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.annotations import TOMBSTONE, current

#: Parts of a compacted state.
PARTS = 64
#: Counts of (batch, mode) of a key that a trigger holds before it writes them to the state.
HELD = 10_000
DELTA = "item_id long, category string, mode string, delta long"


class TagDeltas(StatefulProcessor):
    """Per item and category, which counts change with each log row.

    Keeps the latest replacing batch and the number of tags of each (batch, mode); rows of an older batch than that are
    ignored, so the order of arrival doesn't matter. Boxes only add.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "batch long")
        self.tags = handle.getMapState("tags", "batch long, mode string", "n long")

    def handleInitialState(self, key, rows: pd.DataFrame, timers) -> None:
        """Takes over an item's compacted rows of a category, possibly in several pieces."""
        rows = rows[~rows["is_box"]]
        replaced = rows["batch_id"][rows["kind"] == "replace"]
        if len(replaced):
            latest = int(replaced.max())
            if not self.latest.exists() or self.latest.get()[0] < latest:
                self.latest.update((latest,))
        for (batch, mode), n in rows.groupby(["batch_id", "mode"]).size().items():
            at = (int(batch), mode)
            old = self.tags.getValue(at)[0] if self.tags.containsKey(at) else 0
            self.tags.updateValue(at, (old + int(n),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        """Counts a trigger's rows before it asks the state store, which is called for what is left of them, not for each row."""
        item, category = key
        changed: dict[str, int] = {}
        fresh: dict[tuple[int, str], int] = {}

        def count(mode: str, n: int) -> None:
            if mode != TOMBSTONE:
                changed[mode] = changed.get(mode, 0) + n

        latest = known = self.latest.get()[0] if self.latest.exists() else None

        def settle() -> None:
            if latest != known:
                self.latest.update((latest,))
                for (batch, mode), (n,) in list(self.tags.iterator()):
                    if batch < latest:
                        count(mode, -n)
                        self.tags.removeKey((batch, mode))
            for at, n in fresh.items():
                old = self.tags.getValue(at)[0] if self.tags.containsKey(at) else 0
                self.tags.updateValue(at, (old + n,))
                count(at[1], n)
            fresh.clear()

        for f in rows:
            every = list(zip(*(f[x].tolist() for x in ("batch_id", "kind", "mode", "is_box")), strict=True))
            newest = max((batch for batch, kind, _, is_box in every if kind == "replace" and not is_box), default=None)
            if newest is not None and (latest is None or newest > latest):
                latest = newest
                fresh = {at: n for at, n in fresh.items() if at[0] >= latest}
            for batch, _, mode, is_box in every:
                if is_box:
                    count(mode, 1)
                elif latest is None or batch >= latest:
                    fresh[batch, mode] = fresh.get((batch, mode), 0) + 1
            if len(fresh) > HELD:
                settle()
                known = latest
        settle()
        moved = [(item, category, m, n) for m, n in changed.items() if n]
        if moved:
            yield pd.DataFrame(moved, columns=["item_id", "category", "mode", "delta"])

    def close(self) -> None:
        pass


def tag_deltas(log: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """A stream of (item_id, category, mode, delta) against what ``start`` holds; needs the RocksDB state store.

    start: a compacted log as ``compacted`` or ``current_state`` gives it.
    """
    columns = ["item_id", "category", "batch_id", "kind", "mode", "is_box"]
    return log.select(columns).groupBy("item_id", "category").transformWithStateInPandas(
        statefulProcessor=TagDeltas(), outputStructType=DELTA, outputMode="Update", timeMode="None", initialState=None if start is None else start.select(columns).groupBy("item_id", "category"),
    )


def counted_tags(state: DataFrame) -> DataFrame:
    """(category, mode, n) of a compacted log."""
    return in_force(state).where(F.col("mode") != TOMBSTONE).groupBy("category", "mode").agg(F.count("*").alias("n"))


def running_counts(log: DataFrame, target: str, checkpoint: str, start: DataFrame | None = None) -> StreamingQuery:
    """Keeps (category, mode, n) as Parquet under ``target``/batch=k, the highest k being the state; the version before is kept too.

    With ``start``, a compacted log, counts begin with its own and the stream goes on from its rows: later batches replace
    them and older rows that come late are ignored, as if the stream had read all of it. It is used by the first trigger
    alone; a stream that goes on after a stop finds its state under ``checkpoint``.
    """

    def apply(deltas: DataFrame, k: int) -> None:
        sums = deltas.groupBy("category", "mode").agg(F.sum("delta").alias("n"))
        before = latest_version(deltas.sparkSession, target, k)
        if before is None and start is not None:
            before = counted_tags(start)
        every = sums if before is None else before.unionByName(sums).groupBy("category", "mode").agg(F.sum("n").alias("n"))
        every.where("n <> 0").write.mode("overwrite").parquet(f"{target}/batch={k}")
        drop_versions(deltas.sparkSession, target, k - 1)

    return tag_deltas(log, start).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def compacted(rows: DataFrame) -> DataFrame:
    """The log rows in force, and the tombstones, which still outdate older rows that come late."""
    kept = current(rows.withColumn("mode", F.when(F.col("mode") == TOMBSTONE, "\0" + TOMBSTONE).otherwise(F.col("mode"))))
    return kept.withColumn("mode", F.regexp_replace("mode", "^\\x00", ""))


def versions(spark: SparkSession, target: str) -> tuple:
    """The file system of ``target`` and the versions there by number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [x.getPath() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    return fs, {int(p.getName()[6:]): p for p in paths if p.getName().startswith("batch=") and p.getName()[6:].isdigit()}


def latest_version(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The newest version under ``target``, older than ``below`` if given; None if there is none."""
    found = [k for k in versions(spark, target)[1] if below is None or k < below]
    return spark.read.parquet(f"{target}/batch={max(found)}") if found else None


def drop_versions(spark: SparkSession, target: str, below: int) -> None:
    """Removes versions older than ``below``: a trigger that is run again needs the one before its own, no other."""
    fs, found = versions(spark, target)
    for k, path in found.items():
        if k < below:
            fs.delete(path, True)


def parts(spark: SparkSession, target: str, below: int | None = None) -> dict[int, tuple[int, str]]:
    """The newest version, older than ``below`` if given, of each part of a state under ``target``, and where it is."""
    fs, found = versions(spark, target)
    newest: dict[int, tuple[int, str]] = {}
    for k in sorted(x for x in found if below is None or x < below):
        for x in fs.listStatus(found[k]):
            name = x.getPath().getName()
            if name.startswith("part="):
                newest[int(name[5:])] = (k, x.getPath().toString())
    return newest


def current_state(spark: SparkSession, target: str) -> DataFrame | None:
    """All parts of a state in their newest versions; None if there is none."""
    found = parts(spark, target)
    return spark.read.parquet(*(path for _, path in found.values())) if found else None


def current_annotations(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Compacts the log to the annotations in force, batch by batch; equals ``operators.annotations.current`` of the whole log.

    What is kept between triggers are the rows in force and the tombstones, which still outdate older rows that come late.
    The state is parted by item; a trigger reads and writes the parts of its own items alone, as ``target``/batch=k/part=p,
    and of each part its last two versions stay. ``current_state`` reads it.
    """

    def apply(rows: DataFrame, k: int) -> None:
        spark = rows.sparkSession
        part = F.pmod(F.xxhash64("item_id"), F.lit(PARTS)).cast("int").alias("part")
        rows = rows.persist()
        try:
            touched = {r["part"] for r in rows.select(part).distinct().collect()}  # PARTS at most
            before = {p: x for p, x in parts(spark, target, k).items() if p in touched}
            every = rows.unionByName(spark.read.parquet(*(path for _, path in before.values()))) if before else rows
            kept = compacted(every).select("*", part).repartition("part")
            kept.write.mode("overwrite").partitionBy("part").parquet(f"{target}/batch={k}")
        finally:
            rows.unpersist()
        for p, (version, _) in before.items():
            fs, found = versions(spark, target)
            for older in (found[x] for x in found if x < version):
                old = older.suffix(f"/part={p}")
                if fs.exists(old):
                    fs.delete(old, True)

    return log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def in_force(state: DataFrame) -> DataFrame:
    """The annotations of a compacted state: without the tombstones that it keeps."""
    return state.where(F.col("is_box") | (F.col("mode") != TOMBSTONE))
