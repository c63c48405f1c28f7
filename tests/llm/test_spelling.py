"""Spelling variants against a plain comparison of all words."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import queries, spelling

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_words(rows):
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            yield run


def one_edit(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    a, b = sorted((a, b), key=len)
    p = len(os.path.commonprefix([a, b]))
    return a != b and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :])


def holes(word):
    """What stays of a word if a letter goes, or any letter may stand at one place."""
    return {(word[:k] + "*" + word[k + 1 :]) for k in range(len(word))} | {(word[:k] + "*" + word[k:]) for k in range(len(word) + 1)}


def plain(rows, pairs=None):
    count = {w: n for w, n in Counter(plain_words(rows)).items() if n >= 3 and len(w) >= 5}
    by = {}
    for w in count:
        for h in holes(w):
            by.setdefault(h, set()).add(w)
    near = {w: {x for h in holes(w) for x in by[h] if one_edit(w, x)} for w in count}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], count.get(form[w]), root))
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    return sorted(tuple(r) for r in spelling.spelling_variants(df, **how).collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9999)), st.one_of(st.none(), st.text(alphabet="aBcÀé×ÿ€ſ \n1-Ā", max_size=60))), max_size=9))
def test_words_of_any_texts(rows):
    ids, texts = pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())
    assert spelling.spoilt_words(ids, texts).to_pylist() == list(plain_words(rows))


def test_long_runs():
    rows = [(i, f"{'aé' * n} {'b' * n}x") for i, n in enumerate([31, 32, 33, 64, 65, 5000, 1])] * 60
    assert spelling.spoilt_words(pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])).to_pylist() == list(plain_words(rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.text(alphabet="abé", min_size=1, max_size=7), max_size=25), max_size=4))
def test_walks_find_all_pairs_once(groups):
    words = [(g, w) for g, own in enumerate(groups) for w in sorted(own)]
    if not words:
        return
    letters, offsets = spelling.letters_of(pa.array([w for _, w in words]))
    got = [(int(x), int(y), int(z)) for a, b, c in spelling.one_edit_pairs(letters, offsets, np.array([g for g, _ in words])) for x, y, z in zip(a, b, c)]
    want = [(i, j, len(os.path.commonprefix([v, w]))) for i, (g, v) in enumerate(words) for j, (h, w) in enumerate(words) if i < j and g == h and one_edit(v, w)]
    assert sorted(got) == want


def corpus(seed, n, alphabet="abc", stem=""):
    rng = random.Random(seed)
    words = [stem + "".join(rng.choice(alphabet) for _ in range(rng.randint(3, 7))) for _ in range(n)]
    return [(i, " ".join(rng.choice(words[: rng.randint(1, n)]) for _ in range(60))) for i in range(n // 2)]


def test_as_plain(spark):
    rows = corpus(5, 300) + [(None, "hello hello hallo hallo hallo hallo hallo hallo"), (3, None), (4, ""), (4, "hello Hello"), (4, "hello Hello")]
    assert found(spark, rows) == plain(rows)


def test_large_groups_are_parted(spark):
    rows = corpus(6, 300, "ab", "commonstem")
    want = plain(rows)
    assert len(want) > 100 and found(spark, rows, most=7) == want == found(spark, rows)


def test_chains_of_forms(spark):
    words = ["aaaaa", "baaaa", "bbaaa", "bbbaa", "bbbba", "bbbbb"]
    rows = [(0, " ".join(w for k, w in enumerate(words) for _ in range(3 * 2**k)))]
    assert found(spark, rows) == plain(rows)
    assert {x[0]: x[5] for x in plain(rows)}["aaaaa"] == "bbbbb"


def test_without_words(spark):
    assert found(spark, []) == [] == found(spark, [(1, None), (2, "ab cd"), (3, "seldom words")])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(tuple(r) for r in queries.op12_spelling(spark, "/root/testdata/sf0.01").select("word", "n", "n_near", "form", "form_n", "root").collect()) == want
