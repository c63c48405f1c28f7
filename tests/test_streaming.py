import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_annotations import LOG, log

from sightline.operators.annotations import current
from sightline.streaming import annotation_stream as S


def some_log(spark, n=120):
    r = random.Random(4)
    return log(spark, *[(i // 6, r.choice(["replace", "replace", "append"]), r.randint(0, 4), r.choice("ab"), r.choice(["POSITIVE", "NEGATIVE", "TOMBSTONE"]), False) for i in range(n)], (3, "replace", 1, "a", "POSITIVE", True))


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The log in three files, written in no order."""
    folder = str(tmp_path_factory.mktemp("log"))
    rows = some_log(spark)
    for k in range(3):
        rows.where(F.pmod(F.hash("batch_id"), F.lit(3)) == (k * 2) % 3).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)


def test_compaction_equals_batch(spark, shuffled, tmp_path):
    S.current_annotations(stream(spark, shuffled), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    cell = ["item_id", "category", "mode", "batch_id", "is_box"]
    got = sorted(tuple(r) for r in S.in_force(S.current_state(spark, str(tmp_path / "out"))).select(cell).collect())
    assert got == sorted(tuple(r) for r in current(some_log(spark)).select(cell).collect())
    kept = list((tmp_path / "out").glob("batch=*/part=*"))
    each = [sum(x.name == f"part={p}" for x in kept) for p in S.parts(spark, str(tmp_path / "out"))]
    assert len(each) == 5 and max(each) == 2  # a part for each item here; the newest version and the one before


def test_a_trigger_leaves_other_parts_alone(spark, tmp_path):
    """A second log of one item: only its part has a second version."""
    for k, item in enumerate((None, 3)):
        rows = some_log(spark).where("true" if item is None else f"item_id = {item}").withColumn("batch_id", F.col("batch_id") + 100 * k)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        S.current_annotations(stream(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=1/part=*"))) == 1
    cell = ["item_id", "category", "mode", "batch_id", "is_box"]
    got = sorted(tuple(r) for r in S.in_force(S.current_state(spark, str(tmp_path / "out"))).select(cell).collect())
    assert got == sorted(tuple(r) for r in current(spark.read.parquet(str(tmp_path / "log"))).select(cell).collect())


def test_counts_keep_two_versions(spark, shuffled, tmp_path):
    S.running_counts(stream(spark, shuffled), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert len(S.versions(spark, str(tmp_path / "out"))[1]) == 2


def test_running_counts_equal_batch(spark, shuffled, tmp_path):
    S.running_counts(stream(spark, shuffled), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(tuple(r) for r in S.latest_version(spark, str(tmp_path / "out")).select("category", "mode", "n").collect())
    want = current(some_log(spark)).groupBy("category", "mode").agg(F.count("*").alias("n"))
    assert got == sorted(tuple(r) for r in want.collect())


class Held:
    """A value or map state in memory that counts its calls."""

    def __init__(self):
        self.all, self.calls = {}, 0

    def _of(self, key):
        self.calls += 1
        return self.all.get(key)

    def exists(self):
        return self._of(None) is not None

    def get(self):
        return self._of(None)

    def update(self, value):
        self.updateValue(None, value)

    def containsKey(self, key):  # noqa: N802
        return self._of(key) is not None

    def getValue(self, key):  # noqa: N802
        return self._of(key)

    def updateValue(self, key, value):  # noqa: N802
        self._of(key)
        self.all[key] = value

    def removeKey(self, key):  # noqa: N802
        self._of(key)
        del self.all[key]

    def iterator(self):
        self.calls += 1
        return iter(self.all.items())


@pytest.mark.parametrize("most", [2, 10_000])
def test_state_is_asked_for_what_is_left_of_a_trigger(monkeypatch, most):
    """Three triggers of several pieces each, all of one key; the state store isn't called for each row."""
    monkeypatch.setattr(S, "HELD", most, raising=False)
    r, p, seen, total = random.Random(1), S.TagDeltas(), [], {}
    p.latest, p.tags = Held(), Held()
    for _ in range(3):
        rows = [(r.randint(0, 400), r.choice(["replace", "append"]), r.choice(["POSITIVE", "NEGATIVE", "TOMBSTONE"]), r.random() < 0.1) for _ in range(3000)]
        pieces = [pd.DataFrame(rows[k : k + 500], columns=["batch_id", "kind", "mode", "is_box"]) for k in range(0, 3000, 500)]
        for f in p.handleInputRows((1, "a"), iter(pieces), None):
            for mode, n in zip(f["mode"], f["delta"], strict=True):
                total[mode] = total.get(mode, 0) + n
        seen += rows
        latest = max(b for b, kind, _, is_box in seen if kind == "replace" and not is_box)
        alive = [mode for b, _, mode, is_box in seen if (is_box or b >= latest) and mode != "TOMBSTONE"]
        assert {m: n for m, n in total.items() if n} == {m: alive.count(m) for m in set(alive)}
    assert p.latest.calls + p.tags.calls < 300


@pytest.mark.parametrize("first", ["batch_id < 10", "batch_id % 2 = 0", "batch_id >= 10", "batch_id % 3 > 0", "false", "true"])
def test_counts_go_on_from_a_compacted_log(spark, tmp_path, first):
    """Batch first, then stream, is as a batch of all, also where the stream brings rows older than those of the batch."""
    rows = some_log(spark)
    rows.where(f"not ({first})").repartition(2).write.parquet(str(tmp_path / "log"))
    start = S.compacted(rows.where(first))
    S.running_counts(stream(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "cp"), start).awaitTermination()
    rows.where("batch_id = 19").withColumn("batch_id", F.lit(30).cast("long")).write.mode("append").parquet(str(tmp_path / "log"))  # after a stop
    S.running_counts(stream(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "cp"), start).awaitTermination()
    got = sorted(tuple(r) for r in S.latest_version(spark, str(tmp_path / "out")).select("category", "mode", "n").collect())
    every = rows.union(rows.where("batch_id = 19").withColumn("batch_id", F.lit(30).cast("long")))
    assert got == sorted(tuple(r) for r in current(every).groupBy("category", "mode").agg(F.count("*").alias("n")).collect())
