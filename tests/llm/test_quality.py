"""The statistics and the score of op1 against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import quality, queries

DATA = "/root/testdata/sf0.01"
#: Characters by class, as the module's docstrings name them.
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".?", ",;:", "!", "|", "#$%&*+/<=>@\\^_`{}~", "()[]\"'-"]


def plain_statistics(text):
    """One text, character by character, word by word, line by line."""
    data = (text or "").encode()
    n = len(data)
    count = [sum(chr(b) in chars for b in data) for chars in CLASSES] + [sum(b >= 128 for b in data)]
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    sizes = [len(w) for w in words]
    seen = Counter(bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words)
    k = max(1, len(words))
    mean = sum(sizes) / k
    lines = data.split(b"\n")
    long = [x for x in lines if len(x) >= 20]
    return [
        *(c / max(1, n) for c in count), math.log1p(n), math.log1p(len(words)), mean, math.sqrt(max(0, sum(s * s for s in sizes) / k - mean**2)), len(seen) / k**0.9, max(seen.values(), default=0) / k,
        sum(s <= 3 for s in sizes) / k, sum(s >= 14 for s in sizes) / k, len(words) / len(lines), len(set(long)) / max(1, len(long)) if long else 1, math.log1p(len(long) - len(set(long))), math.log1p(n / (1 + count[4])),
    ]


LINES = ["The quick brown fox jumps over it.", "a | b | c | 12", "ÄÖ ñandú çé!!", "x" * 30, "", "#### $$ %% (a) [b]\t\"q\"'s -", "same line of some length here", "same line of some length here"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.lists(st.sampled_from(LINES), max_size=9).map("\n".join)), max_size=7))
def test_statistics_of_any_texts(texts):
    got = quality.statistics(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(quality.STATISTICS)) and np.isfinite(got).all()
    assert np.allclose(got, np.array([plain_statistics(t) for t in texts]).reshape(got.shape), atol=1e-7)


def test_scores_of_the_whole_table(spark):
    """Every document's score from plain statistics and the ensemble's rules, evaluated one by one."""
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.learn(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op1_quality(spark, DATA).collect()}
    assert len(got) == len(rows) and model.rules
    near = lambda v: any(abs(v[k] - b) <= 1e-9 * (1 + abs(b)) for rule, _ in model.rules for k, _, b in rule)
    for r in random.Random(1).sample(rows, 400):
        v = plain_statistics(r.text)
        if near(v):
            continue  # on a bound, where rounding decides
        total = model.intercept + sum(w for rule, w in model.rules if all(v[k] <= b if most else v[k] > b for k, most, b in rule))
        own = got[r.doc_id]
        assert abs(own.score - 1 / (1 + math.exp(-total))) < 1e-9
        assert own.predicted == (own.score >= 0.3) and own.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


@pytest.mark.parametrize("most", [50, 500])
def test_repeated_ids_are_learnt_once(spark, monkeypatch, most):
    """One labelled id on half of the rows counts as one document, and what is fitted stays within the bound."""
    rows = [(k, " ".join(LINES[(k + j) % len(LINES)] for j in range(k % 5 + 1))) for k in range(600)]
    hot = [(1, f"copy {k % 7} of a text") for k in range(600)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda found: seen.append(found.collect()))
    for docs in (rows + hot, rows + hot[:7][::-1]):
        quality.learn(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), labels, most=most)
    assert len(seen[0]) <= most and len({r.doc_id for r in seen[0]}) == len(seen[0])
    assert [tuple(r) for r in seen[0]] == [tuple(r) for r in seen[1]]  # texts decide, not how often they are there
