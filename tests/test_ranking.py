import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import learning as L
from sightline.operators import mapping as M
from sightline.operators import ranking as R
from sightline.operators.indexing import counted, few_tasks, remove, running_totals
from sightline.operators.solvers import lbfgs


def test_flat_vectors_give_nothing(spark):
    emb = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "item_id long, embedding array<float>")
    assert R.knn(emb.select("item_id"), emb, R.query_vector(emb)).count() == 0


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_normalised_ends(spark, metric):
    emb = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "item_id long, embedding array<float>")
    found = R.knn(emb.select("item_id"), emb, R.query_vector(emb.where("item_id = 0")), metric)
    low, high, n = found.agg(F.min("dist"), F.max("dist"), F.count("*")).first()
    assert (n, high) == ((9, 1.0) if metric == "l2" else (0, None)) or (low, high) == (0.0, 1.0)


def test_percentile_bounds(spark):
    assert tuple(spark.range(1).select(*R.bounds(100, 0.0, 0.95)).first()) == (6, 100)


def test_rows_are_counted_as_they_are_checkpointed(spark, tmp_path):
    rows, seen = counted(spark.range(1000, numPartitions=7).where("id % 3 = 0"), most=F.max("id"))
    assert (rows.count(), seen.n, seen.most) == (334, 334, 999)
    assert few_tasks(rows, seen.n, 200)._jdf.rdd().getNumPartitions() == 2
    rows, seen = counted(spark.createDataFrame([], "id long"))
    assert rows.count() == seen.n == 0 and few_tasks(rows, seen.n).count() == 0
    spark.range(3).write.parquet(str(tmp_path / "t"))
    remove(spark, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


@pytest.mark.parametrize("n", [0, 1, 7, 2000])
def test_running_totals(spark, n):
    df = spark.range(n).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 5).alias("v"))
    got = sorted(tuple(r) for r in running_totals(df, ["k", "id"], ("v",)).collect())
    want, before = [], 0
    rows = sorted((i % 3, i, i % 5) for i in range(n))
    total = sum(v for *_, v in rows)
    for r, (k, i, v) in enumerate(rows):
        want.append((k, i, v, total, r, before))
        before += v
    assert got == want


def test_ranking_is_not_gathered_in_one_task(spark):
    plan = R.ranked(spark.range(1000).withColumn("dist", F.rand(1)).withColumnRenamed("id", "item_id"), R.order())._jdf.queryExecution().toString()
    assert "Exchange SinglePartition" not in plan.split("Scan ExistingRDD")[0].split("BroadcastExchange")[0]


def test_limit_is_a_top_k(spark):
    plan = R.best(spark.range(100).withColumn("score", F.rand(1)).withColumnRenamed("id", "item_id"), 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_zero_keeps_the_whole_domain(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.7)], "item_id long, score double")
    assert R.best(rows, 0).count() == 2
    assert [r.item_id for r in R.best(rows, 1).collect()] == [2]


def test_svm_separates_and_scale_does_not_matter(spark):
    emb = spark.createDataFrame([(i, [float(i % 2) + 0.01 * i, 1.0]) for i in range(20)], "item_id long, embedding array<float>")
    w = L.fit_svm(emb.select("item_id", (F.col("item_id") % 2).cast("int").alias("label")), emb)
    order = [r.item_id % 2 for r in L.svm_query(emb.select("item_id"), emb, w).orderBy(F.desc("dist")).collect()]
    assert order == sorted(order, reverse=True)
    twice = L.svm_query(emb.select("item_id"), emb, [2 * x for x in w])
    assert twice.join(L.svm_query(emb.select("item_id"), emb, w).withColumnRenamed("dist", "d"), "item_id").where("abs(dist - d) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        L.fit_svm(emb.select("item_id", F.lit(1).alias("label")), emb)


def test_metrics_without_hits_are_null(spark):
    row = L.training_metrics(spark.createDataFrame([(1, 0.1), (0, 0.2)], "label int, score double")).first()
    assert (row.precision, row.recall, row.f1) == (None, 0.0, None)


def test_failed_elements_are_skipped(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 0.0)], "item_id long, x double")
    mapped = M.map_elements(rows, lambda x: 1 / x, "x")
    assert {r.id: r.status for r in mapped.collect()} == {1: "processed", 2: "skipped"}
    assert M.tallies(mapped).agg(F.sum("processed"), F.sum("skipped")).first() == (1, 1)
    assert M.time_left(0, 5, 2.0) == -1 and M.time_left(2, 4, 3.0) == 6


def test_image_embedder_crops_pools_and_scales():
    import numpy as np

    e = M.CroppedImages(lambda b: np.frombuffer(b, np.uint8).reshape(4, 4, 1).astype(float), lambda x: x.repeat(2, axis=2), 2, unit=True)
    out = e.embed([(bytes(range(16)), None), (bytes(range(16)), (0.0, 0.0, 0.5, 0.5))])
    assert out.shape == (2, 2) and abs(float((out[0] ** 2).sum()) - 1) < 1e-6


def test_image_embedder_resizes_and_normalises():
    import numpy as np

    image = np.random.default_rng(1).random((5, 7, 3))
    assert np.allclose(M.resized(image, 5, 7), image)
    assert np.allclose(M.resized(np.ones((3, 9, 2)), 4, 4), 1)
    assert np.allclose(M.resized(np.arange(8.0).reshape(1, 8, 1), 1, 4).ravel(), [0.5, 2.5, 4.5, 6.5])
    wide = M.resized(image, 11, 3)
    for y, x in ((0, 0), (5, 1), (10, 2)):  # between the four nearest centres
        fy, fx = np.clip((y + 0.5) * 5 / 11 - 0.5, 0, 4), np.clip((x + 0.5) * 7 / 3 - 0.5, 0, 6)
        a, b = int(fy), int(fx)
        c, d = min(a + 1, 4), min(b + 1, 6)
        want = (1 - fy + a) * ((1 - fx + b) * image[a, b] + (fx - b) * image[a, d]) + (fy - a) * ((1 - fx + b) * image[c, b] + (fx - b) * image[c, d])
        assert np.allclose(wide[y, x], want)
    e = M.CroppedImages(lambda b: np.frombuffer(b, np.uint8).reshape(4, 4, 1).astype(float), lambda x: x, 1, size=(2, 2), mean=[7.5], std=[2.0])
    assert np.allclose(e.embed([(bytes(range(16)), None)]), 0) and e.embed([]).shape == (0, 1)


@pytest.mark.parametrize("start", [0, 7])
def test_late_pages_are_cut_from_the_whole_order(spark, monkeypatch, start):
    rows = spark.range(95).select(F.col("id").alias("item_id"), (F.col("id") % 10).alias("dist"))
    want = [r.item_id for r in rows.orderBy("dist", "item_id").collect()][start * 10 : start * 10 + 10]
    for most in (100_000, 5):
        monkeypatch.setattr(R, "FIRST_ROWS", most)
        got = R.page(rows, start, ["dist", "item_id"], 10).orderBy("rank").collect()
        assert [(r["rank"], r.item_id) for r in got] == [(start * 10 + i, x) for i, x in enumerate(want)]
        assert [r.item_id for r in R.first_rows(rows, 12, ["dist", "item_id"]).orderBy("dist", "item_id").collect()] == [r.item_id for r in rows.orderBy("dist", "item_id").limit(12).collect()]
        assert R.page(rows, 50, ["dist", "item_id"], 10).count() == 0


def test_vectors_that_cannot_be_compared_have_no_distance(spark):
    emb = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [1.0]), (4, [0.0, None])], "item_id long, embedding array<double>")
    query = spark.createDataFrame([([0.0, 0.0],)], "query array<double>")
    assert {r.item_id: r.dist for r in R.distances(emb, query).collect()} == {1: 5.0, 2: None, 3: None, 4: None}
    assert {r.item_id: r.dist for r in R.distances(emb.where("item_id = 1"), query, "dot").collect()} == {1: 0.0}


def test_positions_alone_need_no_python(spark):
    df = spark.range(0, 3000, 1, 6).select((F.col("id") % 3).alias("k"), F.col("id").alias("v`.w"))
    found = running_totals(df, [F.desc("k"), F.col("`v``.w`")])
    assert found.columns == ["k", "v`.w", "row_no"] and found.schema["row_no"].dataType.simpleString() == "bigint"
    want = sorted(((i % 3, i) for i in range(3000)), key=lambda x: (-x[0], x[1]))
    assert [tuple(r) for r in found.orderBy("row_no").collect()] == [(*x, i) for i, x in enumerate(want)]
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_grouped_top_k(spark):
    rows = spark.range(100).select(F.col("id").alias("item_id"), (F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("score"))
    got = sorted((r.k, r["rank"], r.item_id) for r in M.grouped_top_k(rows, ["k"], "score", 4).collect())
    want = [(k, i, x) for k in range(3) for i, x in enumerate(sorted(range(k, 100, 3), key=lambda x: (-(x % 7), x))[:4])]
    assert got == want


@pytest.mark.parametrize("k", [4, 1500])
def test_grouped_top_k_shuffles_what_tasks_have_left(spark, k):
    """One group in several tasks: rows that others of their task outrank don't reach the task that ranks the group."""
    rows = spark.range(0, 8000, 1, 4).select(F.col("id").alias("item_id"), F.lit(1).alias("k"), (F.col("id") % 7).alias("score"))
    found = M.grouped_top_k(rows, ["k"], "score", k)
    assert [(r["rank"], r.item_id) for r in found.orderBy("rank").collect()] == list(enumerate(sorted(range(8000), key=lambda x: (-(x % 7), x))[:k]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "SPARK_PARTITION_ID" in plan and ("WindowGroupLimit" in plan) == (k == 4)


def test_reductions_of_ones_own(spark):
    class Widest:
        """Number of rows, and the first item with the longest text."""

        output = "n long, item_id long"

        def start(self):
            return 0, -1, -1

        def add(self, state, rows):
            for i, text in zip(rows["item_id"], rows["text"]):
                state = self.merge(state, (1, len(text), int(i)))
            return state

        def merge(self, state, other):
            first, second = sorted((state, other), key=lambda s: (-s[1], s[2]))
            return first[0] + second[0], first[1], first[2]

        def finish(self, state):
            return state[0], state[2]

    rows = spark.range(500).select(F.col("id").alias("item_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 91).cast("int")).alias("text")).repartition(6)
    got = {r.k: (r.n, r.item_id) for r in M.reduced(rows, ["k"], Widest()).collect()}
    want = {k or None: (100, min((x for x in range(k, 500, 5) if x % 91 == max(y % 91 for y in range(k, 500, 5))))) for k in range(5)}
    assert got == want
    assert [tuple(r) for r in M.reduced(rows, [], Widest()).collect()] == [(500, 90)]
    assert M.reduced(rows.where("false"), ["k"], Widest()).count() == 0


def plain_svm(x, y, c):
    """Newton's method on the squared hinge, the intercept as a last weight."""
    x, y, w = np.column_stack([x, np.ones(len(x))]), 2 * np.asarray(y) - 1, np.zeros(x.shape[1] + 1)
    loss = lambda w: 0.5 * w @ w + c * (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(100):
        on = y * (x @ w) < 1
        slope = w - 2 * c * (x[on] * (y * (1 - y * (x @ w)))[on, None]).sum(0)
        way = np.linalg.solve(np.eye(len(w)) + 2 * c * x[on].T @ x[on], slope)
        step = 1.0
        while loss(w - step * way) > loss(w) and step > 1e-12:
            step /= 2
        w = w - step * way
    return w


@pytest.mark.parametrize("n, d, c", [(120, 5, 0.1), (400, 30, 0.1), (60, 8, 10.0), (50, 1, 0.001)])
def test_weights_of_the_svm_are_those_of_a_plain_solution(spark, n, d, c):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, d)) * 2
    y = (x[:, 0] + 0.3 * r.normal(size=n) > 0.5).astype(int)
    emb = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (n, None), (n + 1, [1.0] * (d + 1)), (n + 2, [None] * d)], "item_id long, embedding array<double>").repartition(5)
    train = spark.createDataFrame([(i, int(v)) for i, v in enumerate([*y, 1, 0, 1])], "item_id long, label int")
    want = plain_svm(x, y, c)
    assert np.abs(L.fit_svm_weights(train, emb, c) - want).max() < 1e-3
    assert np.allclose(np.array(L.fit_svm(train, emb, c)) / 1000, want[:-1], atol=1e-3)


def test_the_solver_on_plain_functions():
    def rosenbrock(x):
        a, b = x[1:] - x[:-1] ** 2, 1 - x[:-1]
        g = np.zeros(len(x))
        g[:-1] += -400 * x[:-1] * a - 2 * b
        g[1:] += 200 * a
        return float((100 * a**2 + b**2).sum()), g

    x, value, slope = lbfgs(rosenbrock, np.full(6, -1.0), 500, 1e-9)
    assert np.allclose(x, 1, atol=1e-4) and value < 1e-8
    assert lbfgs(lambda x: (float(x @ x), 2 * x), np.zeros(3))[1] == 0
    steep = lbfgs(lambda x: (float(np.exp(x).sum() - x.sum()), np.exp(x) - 1), np.array([5.0, -50.0]), 500)
    assert np.allclose(steep[0], 0, atol=1e-3)


def test_pooled_vectors(spark):
    rows = [[1.0, 2.0], [3.0, None], None, [], [5.0, -4.0, 7.0], [None, None, None, None]]
    df = spark.createDataFrame([(v,) for v in rows], "embedding array<double>").repartition(4)
    assert M.pool(df).first()[0] == [3.0, -1.0, 7.0, None]
    assert M.pool(df, "max").first()[0] == [5.0, 2.0, 7.0, None]
    assert M.pool(df.where("size(embedding) = 0")).first()[0] is None is M.pool(df.limit(0)).first()[0]
    many = spark.range(0, 5000, 1, 37).select(F.array(F.col("id").cast("float"), (-F.col("id")).cast("float")).alias("embedding"))
    assert M.pool(many).first()[0] == [2499.5, -2499.5] and M.pool(many, "max").first()[0] == [4999.0, 0.0]
    assert R.query_vector(many).first()["query"] == [2499.5, -2499.5]


def test_inference_keeps_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "item_id long, embedding array<float>")
    assert sorted(map(tuple, M.infer(df, [2.0, 0.5], 1.0).collect())) == [(1, [1.0, 2.0], 4.0), (2, None, None), (3, [1.0], None)]
