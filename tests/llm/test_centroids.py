"""Centroid clusters against plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import centroids


def plain(rows, k, rounds, d):
    """(id, whole numbers) of the kept rows, their clusters and the centroids."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**52 else 256 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), n) for n, c in enumerate(centres))[::-1]
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[0], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *near(v)) for i, v in kept]
    long = lambda x: x if x < 1 << 63 else None
    inertia = {c: sum(x[2] for x in found if x[1] == c) for c in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, c, long(s), long(inertia[c]), long(sum(inertia.values())), sha[c]) for i, c, s in found], key=repr)


def found(spark, rows, k, rounds, d, extra=""):
    df = spark.createDataFrame([(*r, *(["x"] if extra else [])) for r in rows], "vec_id long, embedding array<double>" + extra)
    got = centroids.centroid_clusters(df, k=k, rounds=rounds, dimensions=d)
    return sorted([tuple(r)[:6] for r in got.collect()], key=repr)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 5), st.sampled_from([3, 40, 2**20, 2**40, 2**70]), st.randoms())
def test_tournament_is_the_nearest_centroid(k, d, most, rng):
    centres = [[rng.randint(-most, most) for _ in range(d)] for _ in range(k)]
    vectors = [[rng.randint(-most, most) for _ in range(d)] for _ in range(12)] + centres
    winner, distance = centroids.Bisectors(centres).nearest(centroids._array(vectors, d))
    for v, w, s in zip(vectors, winner, distance):
        assert min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centres)) == (s, w)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.floats(width=32)), max_size=4)), max_size=8))
def test_whole_numbers(rows):
    kept, values = centroids.whole_numbers(pa.array(rows, pa.list_(pa.float32())), 3)
    good = [r is not None and len(r) == 3 and all(x is not None and math.isfinite(x) for x in r) for r in rows]
    assert kept.tolist() == good
    assert [[int(x) for x in v] for v in values] == [[256 * int(x) if abs(x) >= 2**52 else math.floor(256 * x) for x in r] for r, g in zip(rows, good) if g]


def test_as_plain_with_ties_and_bad_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-2, 2) / 256 for _ in range(3)]) for i in range(150)]
    rows += [(7, [0.0, 0.0, 0.0])] * 40 + [(None, [1.0, 2.0, 3.0]), (200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [math.nan, 1.0, 1.0]), (205, [math.inf, 1.0, 1.0])]
    for k in (1, 6, 300):
        assert found(spark, rows, k, 3, 3, ", cluster string") == plain(rows, k, 3, 3)


def test_numbers_beyond_a_long(spark):
    rows = [(i, [x, -x]) for i, x in enumerate([1e30, 2.0, 1e300, -5.0, 1e9, 7e9, 0.1])]
    assert found(spark, rows, 3, 2, 2) == plain(rows, 3, 2, 2)


def test_without_vectors(spark):
    assert found(spark, [], 4, 2, 3) == [] == found(spark, [(1, None), (2, [1.0])], 4, 2, 3)


def test_equal_vectors_in_many_tasks(spark):
    df = spark.range(0, 3000, 1, 9).selectExpr("id as vec_id", "case when id % 3 = 0 then array(1.0d, 1.0d) else array(id % 7 * 1.0d, id % 11 * 1.0d) end as embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = centroids.centroid_clusters(df, k=5, rounds=4, dimensions=2).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == plain(rows, 5, 4, 2)
    assert sum(np.unique([r.n_cluster for r in got if r.cluster == c])[0] for c in {r.cluster for r in got}) == 3000
