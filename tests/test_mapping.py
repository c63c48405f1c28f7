"""Jobs over chunks: retries, hooks, profile and progress."""

import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.operators import mapping as M


def odd():
    # made in a function, so that it is sent to the tasks whole
    class Odd(M.Mapper):
        """Counts its calls; fails on the value in the arguments, by turns, or gives too few outputs."""

        def open(self):
            self.opened = getattr(self, "opened", 0) + 1

        def start(self, args):
            return dict(args, calls=0, opened=self.opened)

        def chunk(self, inputs, job):
            job["calls"] += 1
            with self.timed("call"):
                if None in inputs and job.get("null") == "short":
                    return []
                if job.get("bad") in inputs:
                    raise KeyError("bad")
            with self.timed("twice"), self.timed("call"):
                return [None if x is None else 2 * x for x in inputs]

        def finish(self, inputs, outputs, job):
            return f"{len(inputs)}:{job['opened']}", outputs

    return Odd()


def made(spark, n, parts=3):
    return spark.range(0, n, 1, parts).select(F.col("id").alias("item_id"), F.when(F.col("id") % 10 != 9, F.col("id").cast("double")).alias("x"), F.lit("c").alias("chunk"))


@pytest.mark.parametrize("order", [None, ["item_id"]])
def test_chunks(spark, order):
    done = M.map_chunks(made(spark, 103), odd(), "x", args={"bad": 40.0}, size=8, order=order, retries=2).collect()
    rows = {e.id: (e.output, e.status) for r in done for e in r.elements}
    assert sum(r.n for r in done) == 103 == len(rows)
    if order:
        assert sorted(r.chunk for r in done) == list(range(13)) and sorted(r.n for r in done) == [7] + [8] * 12
        assert all([e.id for e in r.elements] == list(range(8 * r.chunk, 8 * r.chunk + r.n)) for r in done)
    else:
        assert len({r.chunk for r in done}) == len(done) and all(r.n <= 8 for r in done)
    bad = next(r for r in done if any(e.id == 40 for e in r.elements))
    assert (bad.attempts, bad.status, bad.error, bad.chunk_output) == (2, "skipped", "KeyError: 'bad'", None) and "Traceback" in bad.trace
    assert all((e.output, e.status) == (None, "skipped") for e in bad.elements)
    for r in done:
        if r is not bad:
            assert (r.attempts, r.status, r.error, r.chunk_output) == (1, "processed", None, f"{r.n}:1")
            assert all((e.output, e.status) == ((None, "skipped") if e.id % 10 == 9 else (2.0 * e.id, "processed")) for e in r.elements)


def test_a_wrong_number_of_outputs_fails_the_chunk(spark):
    done = M.map_chunks(made(spark, 30, 1), odd(), "x", args={"null": "short"}, size=5, order=["item_id"]).collect()
    assert [(r.attempts, r.status) for r in sorted(done)] == [(1, "processed"), (3, "skipped")] * 3
    assert {r.error for r in done} == {None, "ValueError: 0 outputs for 5 inputs"}
    assert sum(r.trace is not None for r in done) == len({r.worker for r in done if r.error})


def test_profile_and_counts(spark):
    done = M.map_chunks(made(spark, 90), odd(), "x", args={"bad": 3.0}, size=4, order=["item_id"]).persist()
    rows = done.collect()
    got = {r.name: r for r in M.timing_profile(done).collect()}
    good = [r for r in rows if r.status == "processed"]
    values = {"total_time": [r.seconds for r in good], "call": [x for r in good for x in r.timings["call"]], "twice": [x for r in good for x in r.timings["twice"]]}
    assert set(got) == set(values) and len(values["call"]) == 2 * len(good)
    for name, xs in values.items():
        assert got[name].n == len(xs) and abs(got[name]["mean"] - statistics.mean(xs)) < 1e-9 and abs(got[name]["std"] - statistics.stdev(xs)) < 1e-9
    assert tuple(M.job_counts(done).first()) == (23, 25, 90, 77, 13)
    assert sum(r.chunks for r in M.utilisation(done).collect()) == 22
    done.unpersist()


def test_progress(spark):
    p = M.Progress(spark, 60)
    assert p.status()["time_left"] == -1.0 and not p.status()["finished"]
    M.map_chunks(made(spark, 60), odd(), "x", args={"bad": -1.0}, size=7, progress=p).count()
    assert (p.status()["n_processed"], p.status()["n_skipped"]) == (54, 6) and p.status()["finished"] and p.status()["time_left"] == 0


def test_no_rows(spark):
    done = M.map_chunks(made(spark, 0), odd(), "x", args={}, order=["item_id"])
    assert done.count() == 0 and tuple(M.job_counts(done).first()) == (0, 0, 0, 0, 0)


def test_errors_of_elements_are_short(spark):
    rows = made(spark, 200, 1)
    got = M.map_elements(rows, lambda x: 1 / (x - x) if x is not None and x == x else None, "x").collect()
    errors = [r.error for r in got if r.error]
    assert len(errors) == 180 and sum("Traceback" in e for e in errors) == 1 and errors[1] == "ZeroDivisionError: float division by zero"


def test_chunks_are_sent_on_together(spark, monkeypatch):
    """100 chunks in few record batches, which hold what each chunk gave at its time; numbers and structs come as Python's own."""
    runs = []
    rows = spark.range(1).select(F.col("id").alias("item_id"), F.struct(F.col("id").alias("a"), F.lit(1.5).alias("b")).alias("input"))
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: runs.append(run))

    class Kept(M.Mapper):
        def start(self, args):
            return []

        def chunk(self, inputs, job):
            job[:] = [x["a"] for x in inputs]
            if job[0] == 128:
                raise ValueError("no")
            return [None if x["b"] is None else x["b"] for x in inputs]

        def finish(self, inputs, outputs, job):
            return job, outputs

    M.map_chunks(rows, Kept(), "input", chunk_output="array<bigint>")
    n = 6400
    given = pa.array([{"a": i, "b": None if i == 3 else i / 2} for i in range(n)], pa.struct([("a", pa.int64()), ("b", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([5 << 33] * n), pa.array(range(n)), given], ["chunk", "id", "input"])
    out = list(runs[0](iter([batch.slice(k, 1000) for k in range(0, n, 1000)])))
    assert len(out) <= 3
    found = [x for b in out for x in b.to_pylist()]
    assert [x["chunk"] - (5 << 33) for x in found] == list(range(100)) and [x["n"] for x in found] == [64] * 100
    for c, x in enumerate(found):
        bad, ids = c == 2, range(64 * c, 64 * c + 64)
        assert (x["status"], x["attempts"], x["chunk_output"]) == (("skipped", 3, None) if bad else ("processed", 1, list(ids)))
        outputs = [None if bad or i == 3 else i / 2 for i in ids]
        assert x["elements"] == [{"id": i, "output": y, "status": "skipped" if y is None else "processed"} for i, y in zip(ids, outputs, strict=True)]


def test_values_of_is_to_pylist():
    nested = pa.array([{"a": 1, "b": {"c": "x", "d": [1, 2]}}, None, {"a": None, "b": None}, {"a": 4, "b": {"c": None, "d": []}}])
    for x in (nested, nested.slice(1), nested.slice(3), pa.array([1.5, None]), pa.array([1.5, 2.0]), pa.array([1, 2], pa.int8()), pa.array([True, None]), pa.array([]), pa.array(["a"])):
        assert M.values_of(x) == x.to_pylist()
