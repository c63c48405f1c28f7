import hashlib
import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import validation as G


def sample(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, bool(rng.random() < s), float(s), 1.0) for i, s in enumerate(rng.random(n).round(3))], "item_id long, label boolean, score double, weight double")


def test_unit_weights_are_plain_precision_and_recall(spark):
    rows = sample(spark)
    e, p = G.estimates(rows).first(), rows.toPandas()
    hit = p.score > 0.5
    assert abs(e.precision - (hit & p.label).sum() / hit.sum()) < 1e-9 and abs(e.recall - (hit & p.label).sum() / p.label.sum()) < 1e-9
    assert e.num_labeled == len(p) and e.num_fp == (hit & ~p.label).sum()


def test_no_weight_gives_nulls(spark):
    e = G.estimates(spark.createDataFrame([(1, False, 0.1, 1.0)], "item_id long, label boolean, score double, weight double")).first()
    assert e.precision is None and e.f1 is None


def test_draws_follow_the_weights(spark):
    w = spark.createDataFrame([(i, float(i)) for i in range(5)], "item_id long, w double")
    drawn = G.weighted_draws(w, 20_000, 3)
    got = {r.item_id: r.n for r in drawn.groupBy("item_id").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 20_000 and 0 not in got
    assert all(abs(got[i] / 20_000 - i / 10) < 0.02 for i in range(1, 5))
    assert abs(drawn.where("item_id = 4").first().weight - 10 / 4 / 20_000) < 1e-9


def test_more_known_than_budget(spark):
    known = sample(spark, 20).select("item_id", "label", "score")
    got = G.draw_sample(sample(spark), known, 10, 0.5)
    assert got.count() == 20 and got.where("weight <> 1").count() == 0


def test_without_predicted_positives_the_domain_is_whole(spark):
    scores = spark.createDataFrame([(i, 0.1) for i in range(50)], "item_id long, score double")
    known = spark.createDataFrame([(1, True, 0.1)], "item_id long, label boolean, score double")
    got = G.active_validation(scores, known, 0.5)
    assert got.where("labelled").count() == 1 and got.count() > 3


def test_calibration_is_monotone_and_flat_outside(spark):
    rows = sample(spark)
    model = G.calibrate(rows)
    p = [r.p for r in G.calibrated(model, spark.createDataFrame([(i, i / 10 - 1) for i in range(31)], "item_id long, score double")).orderBy("item_id").collect()]
    assert p == sorted(p) and p[0] == p[5] and p[-1] == p[-5]
    assert G.calibrate(rows.limit(0)) is None


def test_the_loop_comes_near_the_true_f1(spark):
    rows = sample(spark, 400, 5)
    p = rows.toPandas()
    hit = p.score > 0.5
    true = 2 * (hit & p.label).sum() / (hit.sum() + p.label.sum())
    got = G.ais_loop(rows.select("item_id", "score"), rows.select("item_id", "label"), 160, 3)
    assert abs(got["f1"] - true) < 0.2 and got["num_labeled"] <= 330


def draws_by_hand(ids, weights, m, seed):
    """The same draws, one after the other: intervals in order of the id, numbers from the hash of the draw's number."""
    share = np.floor(np.array(weights) / max(weights) * 2.0**40).astype(np.int64)
    order = [i for i in np.argsort(ids) if share[i] > 0]
    ends, total = np.cumsum(share[order]), int(share.sum())
    out = []
    for k in range(m):
        at = int(int(hashlib.md5(f"{k}|{seed}".encode()).hexdigest()[:13], 16) / 2**52 * float(total))
        i = order[int(np.searchsorted(ends, at, "right"))]
        out.append((ids[i], total / (int(share[i]) * float(m))))
    return out


def test_draws_equal_those_by_hand(spark):
    """With ids out of order, zero and missing weights, and one row that is nearly all of the weight."""
    ids, weights = [5, 3, 9, 1, 7, 2, 8], [1.0, 0.0, 500.0, 2.0, 1e-15, 3.0, 0.5]
    rows = spark.createDataFrame([*zip(ids, weights), (4, None)], "item_id long, w double").repartition(3)
    want = sorted((i, round(w, 9)) for i, w in draws_by_hand(ids, weights, 3000, 11))
    for sent in (1 << 20, 10):  # places sent to tasks, or sorted among the rows
        assert sorted((r.item_id, round(r.weight, 9)) for r in G.weighted_draws(rows, 3000, 11, sent=sent).collect()) == want
        assert G.weighted_draws(rows.limit(0), 10, sent=sent).count() == 0


def test_weights_whose_sum_exceeds_a_long(spark):
    """With a unit of 2^60 four rows fill a block and nine exceed a long, as eight million rows do with the usual one."""
    ids, weights = list(range(200)), [1.0 + i % 3 for i in range(200)]
    rows = spark.createDataFrame([*zip(ids, weights)], "item_id long, w double").repartition(3)
    share = [int(math.floor(w / 3.0 * 2.0**60)) for w in weights]
    ends, total = list(itertools.accumulate(share)), sum(share)
    assert total > 1 << 63
    want = []
    for k in range(500):
        at = int(int(hashlib.md5(f"{k}|5".encode()).hexdigest()[:13], 16) / 2**52 * float(total))
        want.append(next(i for i, e in enumerate(ends) if at < e))
    for sent in (1 << 20, 10):
        got = G.weighted_draws(rows, 500, 5, unit=1 << 60, sent=sent).collect()
        assert sorted(r.item_id for r in got) == sorted(want)
        assert all(abs(r.weight * 500 * share[r.item_id] / total - 1) < 1e-9 for r in got)


def isotonic(scores, labels):
    """Pooled adjacent means by distinct score."""
    blocks = []
    for s in sorted(set(scores)):
        y = [l for t, l in zip(scores, labels) if t == s]
        blocks.append([sum(y), len(y), [s]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y, n, own = blocks.pop()
            blocks[-1][0] += y
            blocks[-1][1] += n
            blocks[-1][2] += own
    return [s for b in blocks for s in b[2]], [b[0] / b[1] for b in blocks for _ in b[2]]


def test_the_loop_equals_a_plain_one(spark):
    """Rounds, calibration, worth, draws and estimates of ``ais_loop`` in plain Python."""
    import math

    rows = sample(spark, 120, 4).select("item_id", "score", "label")
    p = rows.toPandas().sort_values("item_id")
    ids, score, label = p.item_id.tolist(), p.score.tolist(), p.label.tolist()
    budget, seed, g, found, seen = 60, 5, 0.5, [], set()
    rounds = int(math.log2(budget / 10)) + 1
    for k in range(rounds):
        size = budget if k == rounds - 1 else 10 * 2**k
        known = sorted(seen)
        drawn = [(i, 1.0) for i in known]
        if len(known) < size:
            w = [1.0] * len(ids)
            if known:
                xs, ys = isotonic([score[i] for i in known], [float(label[i]) for i in known])
                q = 0.98 * np.interp(score, xs, ys) + 0.01
                worth = np.where(np.array(score) > 0.5, np.sqrt(q * (1 - g) ** 2 + (0.5 * g) ** 2 * (1 - q)), 0.5 * np.sqrt(q * g * g))
                w = worth.tolist() if worth.sum() > 0 else w
            drawn += draws_by_hand(ids, w, size - len(known), seed + k)
        weight = {}
        for i, x in drawn:
            weight[i] = weight.get(i, 0.0) + x
        n, s0, s1, s2, s2c = len(weight), 0.0, 0.0, 0.0, 0.0
        for i, x in weight.items():
            hit, real = score[i] > 0.5, label[i]
            v = x * (0.5 * hit + 0.5 * real)
            s0, s1, s2, s2c = s0 + v, s1 + v * (hit == real), s2 + v * v, s2c + v * v * (hit == real)
        if s0:
            f = s1 / s0
            rest = (s0 / n) ** 2 * (1 - s2 / s0**2)
            std = math.sqrt(((1 - f) ** 2 * s2c + f * f * (s2 - s2c)) / n / rest) / math.sqrt(n) if rest > 0 else 0.0
            g = 0.5 * g + 0.5 * f
            found.append((f, std, s0 + 1e-4))
        seen |= set(weight)
    last = found[-4:]
    total = sum(w for *_, w in last)
    got = G.ais_loop(rows.select("item_id", "score"), rows.select("item_id", "label"), budget, seed)
    assert got["num_labeled"] == len(seen)
    assert abs(got["f1"] - sum(f * w for f, _, w in last) / total) < 1e-6
    assert abs(got["f1_std"] - math.sqrt(sum((s * w / total) ** 2 for _, s, w in last))) < 1e-6
