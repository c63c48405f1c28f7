import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.operators import clustering as C


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 25), st.integers(0, 1000))
def test_heights_do_not_fall_and_cuts_nest(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    merges = C.ward(x)
    heights = [m[2] for m in merges]
    assert len(merges) == n - 1 and heights == sorted(heights)
    scaled = [(a, b, h / heights[-1]) for a, b, h in merges]
    sizes = [len(set(C.cut(n, scaled, s))) for s in (0, 20, 50, 80, 100)]
    assert sizes[0] == n and sizes[-1] == 1 and sizes == sorted(sizes, reverse=True)


def test_two_groups():
    x = np.array([[0.0], [0.1], [5.0], [5.1]])
    merges = C.ward(x)
    assert C.cut(4, [(a, b, h / merges[-1][2]) for a, b, h in merges], 50) == [0, 0, 2, 2]


def test_pages(spark):
    one = spark.createDataFrame([(0, 0, 7, [1.0, 2.0])], "page long, rank long, item_id long, embedding array<double>")
    assert C.page_merges(one).count() == 0
    assert [tuple(r) for r in C.page_clusters(one, 50).collect()] == [(0, 7, 0, 0)]
    same = spark.createDataFrame([(0, i, i, [1.0, 2.0]) for i in range(3)], "page long, rank long, item_id long, embedding array<double>")
    assert [r.dist for r in C.page_merges(same).collect()] == [0.0, 0.0]
    assert {r.cluster for r in C.page_clusters(same, 1).collect()} == {0}
    clusters = C.page_clusters(same, 0)
    assert C.by_size(clusters).count() == 3
    assert sorted(r.item_id for r in C.inverted(clusters, clusters.where("item_id = 1")).collect()) == [0, 2]


def test_too_large_a_group_is_refused():
    import pandas as pd

    with pytest.raises(ValueError):
        C._grouped(pd.DataFrame({"rank": range(C.MOST_IN_GROUP + 1)}))


def test_weights_stand_for_equal_rows():
    r = np.random.default_rng(1)
    x, w = r.normal(size=(12, 3)), r.integers(1, 5, 12)
    whole = [m[2] for m in C.ward(np.repeat(x, w, axis=0)) if m[2] > 1e-6]
    assert np.allclose([m[2] for m in C.ward(x, w)], whole)


VECTORS = "rank long, item_id long, embedding array<double>"


def framed(spark, x, parts=5):
    return spark.createDataFrame([(i, 7 * i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], VECTORS).repartition(parts)


@pytest.mark.parametrize("strength", [0, 40, 75, 100])
def test_small_wholes_are_plain_ward(spark, strength):
    """Also with equal vectors, spread over tasks, and rows without a usable vector."""
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(size=(25, 3)), r.normal(size=(6, 3)).repeat(4, axis=0)])
    merges = naive_ward(x)
    names = C.cut(len(x), [(a, b, h / merges[-1][2]) for a, b, h in merges], strength)
    odd = [None, [], [1.0], [float("nan"), 0, 0]]
    got = {r["rank"]: (r.item_id, r.cluster) for r in C.whole_clusters(framed(spark, [*x, *odd]), strength).collect()}
    assert got == {i: (7 * i, names[i] if i < len(x) else i) for i in range(len(x) + len(odd))}
    assert C.whole_clusters(framed(spark, []), strength).count() == 0


def test_groups_of_large_wholes_are_not_parted(spark):
    """Groups far larger than the features allow, one of them equal vectors, spread over all tasks: each is one cluster."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(9, 4)) * 20
    x = np.vstack([c + 0.5 * r.normal(size=(700, 4)) for c in centres] + [np.full((3000, 4), 50.0)])
    got = C.whole_clusters(framed(spark, x, 6), 17, most=150).toPandas().sort_values("rank")
    found = got.cluster.to_numpy().reshape(-1)
    groups = [found[700 * k : 700 * k + 700] for k in range(9)] + [found[6300:]]
    assert [len(set(g)) for g in groups] == [1] * 10 and len(set(found)) == 10
    assert all(g[0] == min(np.flatnonzero(found == g[0])) for g in groups)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 120), st.integers(1, 40), st.integers(0, 99))
def test_features_hold_all_rows(n, most, seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 2)), r.integers(0, 3))
    f = C.Features(2, most)
    for part in np.array_split(x, 4):
        f.add(part, np.ones(len(part)))
    assert f.n.sum() == n and np.allclose((f.mean * f.n[:, None]).sum(0), x.sum(0)) and len(f.n) <= most
    distinct = np.unique(x, axis=0)
    if len(distinct) <= most:
        assert f.reach == 0 and (f.mean == distinct).all()
    other = C.Features(2, most)
    other.add(f.mean, f.n, f.reach)
    assert other.n.sum() == n and len(other.n) <= most


def test_vectors_that_hardly_differ(spark):
    assert C.whole_clusters(framed(spark, [[1.0 + i * 2.3e-16, 1.0] for i in range(50)]), 80, most=8).count() == 50


def naive_ward(x):
    """Merges the pair whose union adds least to the squared distances from means, looking at all pairs each time."""
    groups, heights = {i: [i] for i in range(len(x))}, []
    while len(groups) > 1:
        cost = {}
        for a in groups:
            for b in groups:
                if a < b:
                    p, q = x[groups[a]], x[groups[b]]
                    cost[a, b] = np.sqrt(2 * len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum())
        (a, b), h = min(cost.items(), key=lambda kv: kv[1])
        groups[a] += groups.pop(b)
        heights.append((a, b, h))
    return heights


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 18), st.integers(0, 1000), st.sampled_from([0, 35, 60, 80, 100]))
def test_ward_equals_the_plain_method(n, seed, strength):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    got, want = C.ward(x), naive_ward(x)
    assert np.allclose([m[2] for m in got], [m[2] for m in want])
    cut = lambda merges: C.cut(n, [(a, b, h / merges[-1][2]) for a, b, h in merges], strength)
    assert cut(got) == cut(want)


def test_pages_of_the_given_vectors(spark, data):
    """The registered clusters of each page against the plain method on its first rows, and their order by size."""
    from sightline.plans import catalog

    pages = catalog._pages(spark, data).where("rank % 5 = 0")
    rows = pages.toPandas().sort_values(["page", "rank"])
    merges = C.page_merges(pages).toPandas()
    clusters = C.page_clusters(pages, 80)
    found = clusters.toPandas()
    for page, f in rows.groupby("page"):
        x = np.stack(f.embedding.to_numpy()).astype(float)
        want = naive_ward(x)
        top = want[-1][2]
        assert np.allclose(merges[merges.page == page].sort_values("step").dist, [h / top for *_, h in want])
        names = f["rank"].to_numpy()[C.cut(len(x), [(a, b, h / top) for a, b, h in want], 80)]
        assert found[found.page == page].sort_values("rank").cluster.tolist() == names.tolist()
    sizes = [(r["size"], r.page, r.cluster) for r in C.by_size(clusters, ("page", "cluster")).collect()]
    assert sizes == sorted(sizes, key=lambda s: (-s[0], s[1], s[2])) and sum(s[0] for s in sizes) == len(rows)


def test_clusters_of_a_result_page(spark):
    from sightline.operators import ranking as R

    emb = spark.createDataFrame([(i, [float(i // 3), 0.1 * (i % 3)]) for i in range(12)], "item_id long, embedding array<double>")
    items = emb.selectExpr("item_id", "'http://h' as directory", "concat('p', item_id) as path")
    cur = spark.createDataFrame([(4, "a", "X", False), (4, "b", "Y", False)], "item_id long, category string, mode string, is_box boolean")
    cur = cur.selectExpr("*", *(f"cast(null as double) as {x}" for x in ("x1", "y1", "x2", "y2")))
    shown = R.result_page(items.selectExpr("item_id", "cast(item_id as double) as dist"), 0, ["dist"], items, cur, emb, 30, 9).collect()
    assert [(r["rank"], r.item_id, r.public_path) for r in shown] == [(i, i, f"p{i}") for i in range(9)]
    assert [r.cluster for r in shown] == [0, 0, 0, 3, 3, 3, 6, 6, 6] and [len(r.tags) for r in shown] == [0, 0, 0, 0, 2, 0, 0, 0, 0]
