"""The field's inference against sums over all labellings, its gradient, and its predictions on documents never learnt from."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import language, queries

DATA = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=5), st.integers(1, 3), st.integers(0, 99))
def test_shares_are_those_of_all_labellings(sizes, n_langs, seed):
    rng = np.random.default_rng(seed)
    bounds = np.append(0, np.cumsum(sizes))
    logits, moves = rng.normal(0, 3, (bounds[-1], n_langs)), rng.normal(0, 2, (n_langs, n_langs))
    shares, total, pairs = np.zeros_like(logits), 0.0, np.zeros_like(moves)
    for a, b in zip(bounds[:-1], bounds[1:]):
        ways = {w: np.exp(sum(logits[a + t, y] for t, y in enumerate(w)) + sum(moves[x, y] for x, y in zip(w, w[1:]))) for w in itertools.product(range(n_langs), repeat=b - a)}
        z = sum(ways.values())
        total += np.log(z)
        for w, v in ways.items():
            for t, y in enumerate(w):
                shares[a + t, y] += v / z
            for x, y in zip(w, w[1:]):
                pairs[x, y] += v / z
    chains = language.Chains.of(bounds)
    laid = np.empty_like(logits)
    laid[chains.place] = logits
    got, log, seen = language.forward_backward(laid, chains, moves, pairs=True)
    assert np.allclose(got[chains.place], shares) and np.isclose(log, total) and np.allclose(seen, pairs)


def test_the_gradient(monkeypatch):
    monkeypatch.setattr(language, "BUCKETS", 64)
    rng = np.random.default_rng(2)
    words = ["der wald und die hütte", "the wood and a hut", "x", "le bois et une cabane"]
    rows = pa.table({"chain": [1, 1, 0, 1], "h": [3, 1, 2, 5], "y": [0, 1, 1, 2], "words": words})
    lexicon = (np.sort(language.word_hashes(*(lambda d, e: (d, e[:-1], e[1:]))(*language.bytes_of(pa.array(["der", "the"]))))), np.array([0, 1]))
    block = {k: np.frombuffer(b, np.int64) for k, b in language._training_block(rows, lexicon, 3).items()}
    x = rng.normal(0, 1, 64 * 3 + 12 + 9)
    value, slope = language._loss(block, x, 3)
    for k in rng.choice(len(x), 40, replace=False):
        y = x.copy()
        y[k] += 1e-5
        assert abs((language._loss(block, y, 3)[0] - value) / 1e-5 - slope[k]) < 1e-3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB -é—٣中1\n", max_size=12)), max_size=8))
def test_letters_and_words(texts):
    array = pa.array(texts, pa.string())
    assert language.has_letter(array).tolist() == [any(c.isalpha() for c in t or "") for t in texts]
    data, edges = language.bytes_of(array)
    starts, ends = language.words_of(data, edges)
    want = [w for t in texts for w in "".join(c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in t or "").split(" ") if w]
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == want


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.learn(docs)


def test_whole_table(spark, docs, model):
    rows = {r.doc_id: r for r in docs.collect()}
    got = queries.op13_language(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in unseen]) >= 0.98
    few = random.Random(1).sample(got, 100)  # a text alone is labelled as in its batch
    for r in few:
        langs, score = model.languages(pa.array([rows[r.doc_id].text]))
        assert langs == [r.lang_pred] and abs(score[0] - r.score) < 1e-4


def test_switched_text_is_labelled_by_word(docs, model):
    """Held-out passages of two languages spliced: nearly every word goes with its own passage."""
    rows = [r for r in docs.where("lang is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and len(r.text) > 600 and not set("#&*$%|<") & set(r.text)]
    by = {lang: next(r.text for r in rows if r.lang == lang) for lang in ("en", "de", "fr")}
    parts = [(lang, " ".join(by[lang].split()[k : k + 15])) for k in (0, 20, 40) for lang in ("en", "de", "fr")]
    text = ". ".join(p for _, p in parts)
    shares, bounds, starts = model.word_shares(pa.array([text]))
    edges = np.cumsum([len((p + ". ").encode()) for _, p in parts])
    want = [parts[int(np.searchsorted(edges, s, "right"))][0] for s in starts]
    assert np.mean([model.langs[y] == w for y, w in zip(shares.argmax(axis=1), want)]) >= 0.9
    assert np.allclose(shares.sum(axis=1), 1, atol=1e-4)


def test_moves_keep_a_language(model):
    assert model.moves.argmax(axis=1).tolist() == list(range(len(model.langs)))


def make(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")


def test_edges(spark):
    rows = [(k, f"the old stone mill by the river {k}", "en") for k in range(40)] + [(100 + k, f"die alte mühle an dem fluss {k}", "de") for k in range(40)]
    odd = [(1, None, "en"), (2, "", None), (3, " 12 -- — ", "en"), (None, "the river", "en"), (2, "die mühle an dem fluss", None), (2, "die mühle an dem fluss", None), (5, "the mill " * 9000, None), (6, "x" * 50_000 + " the mill by the river", None), (7, "中文", None)]
    got = [tuple(r) for r in language.text_languages(make(spark, rows + odd)).collect()]
    assert len(got) == len(rows) + len(odd)
    for (i, _, lang), (key, held, pred, score) in zip(rows, got):
        assert (key, pred, held) == (i, lang, zlib.crc32(str(i).encode()) % 4 == 2) and score > 0.5
    tail = got[len(rows) :]
    assert [(r[2], r[3]) for r in tail[:3]] == [("und", 0.0)] * 3 and (tail[3][:3]) == (None, False, "en") and tail[4][1:] == tail[5][1:] and tail[4][2] == "de"
    assert tail[6][2] == tail[7][2] == "en" and tail[8][2] in ("en", "de")
    assert all(0 <= r[3] <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    assert language.text_languages(make(spark, [])).count() == 0
    assert [r.lang_pred for r in language.text_languages(make(spark, [(1, "the mill", None)])).collect()] == ["und"]
    one = language.text_languages(make(spark, [(1, "the mill", "en"), (9, "le moulin", None), (8, "", "en")])).collect()
    assert [(r.lang_pred, r.score) for r in one] == [("en", 1.0), ("en", 1.0), ("und", 0.0)]


def test_the_sample_is_bounded(spark):
    """A third of all rows are copies of one text, under one id and under many; it is learnt from once, and in a bounded number of runs."""
    rows = [(k, f"the old stone mill by the river {k}", "en") for k in range(300)] + [(1000, "die alte mühle an dem fluss", "de")] * 75 + [(2000 + k, "die alte mühle an dem fluss", "de") for k in range(75)]
    segments, langs = language._segments(make(spark, rows), "doc_id", "text", "lang", 20)
    assert langs == ["de", "en"] and segments.count() <= 20 * language.SEGMENTS
    segments, _ = language._segments(make(spark, rows), "doc_id", "text", "lang", 4000)
    assert segments.where("words like 'die alte%'").count() == 1 and segments.where("words like 'the old%'").count() > 200
