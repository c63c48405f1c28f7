"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from sightline.llm import chat, decontam, embed_dedup, html_extract, jaccard_join, licenses, packing, pii, quality, queries, sharding

WORDS = "the quick brown fox jumps over a lazy dog and runs into the deep green wood near an old stone mill by the river".split()
LONG = " ".join(WORDS[(i * 7 + i // 11) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(60_000))
ITEM = "zeta alpha kilo mike november oscar papa quebec romeo sierra tango uniform victor whiskey"
TEXTS = [None, "", " \n\t", "one", "a b c d", "Write to a.b@c.org or call +1 (555) 010-9999.", "Write to a.b@c.org or call +1 (555) 010-9999.", LONG, LONG + " tail", f"Before {ITEM.upper()} after", "x" * 50_000]
#: Columns with the names that operators use inside.
CLASHES = ["key", "size", "n", "fp", "tile", "statistics", "score", "predicted", "row_no", "component", "part", "label"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHES)])


def make(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *(f"{c}{i}" for c in CLASHES)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(TEXTS))
    return make(spark, [*rows, rows[5], rows[9], (None, "a null id"), (None, None)])


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, None, "y"), (3, "", "z"), (None, "one", "w"), (4, "one", "v")], "item_id long, text string, key string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, None, 0), (None, 1, 1), (7, 1, None), (99, 0, 0)], "doc_id long, quality int, toxic int")


N = len(TEXTS) + 4


def test_sharding(docs, none):
    rows = sharding.byte_shards(docs, 3).collect()
    assert len(rows) == N and sharding.byte_shards(none, 3).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = {(r.key, r.text_crc32): r["size"] for r in rows}
    assert sizes[0, 0] == 16 and sizes[5, zlib.crc32(TEXTS[5].encode())] == len(TEXTS[5].encode()) + 16


def test_shards_are_even_and_contiguous(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int")).alias("text"))
    rows = sharding.byte_shards(docs, 7).groupBy("shard").agg(F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b")).orderBy("shard").collect()
    assert max(r["size"] for r in rows) - min(r["size"] for r in rows) <= 2 * (98 + 16)
    assert all(x.b < y.a for x, y in zip(rows, rows[1:]))


def test_pii(docs, none):
    rows = pii.pii_spans(docs).collect()
    assert len(rows) == N and pii.pii_spans(none).count() == 0
    assert [(r.n_email, r.n_phone) for r in rows if r.key == 5] == [(1, 1)] * 2 and next(r for r in rows if r.key == 0).spans == ""


def test_licenses(docs, none):
    assert licenses.license_scan(docs).count() == N and licenses.license_scan(none).count() == 0
    assert licenses.license_scan(docs).where("n_sentences > 0").count() == 0


@pytest.mark.parametrize("most", [1000, 0])
def test_decontamination(docs, none, items, most):
    found = sorted((r.key, r.item, r.n_item, r.n_shared) for r in decontam.contaminated(docs, items, broadcast_shingles=most).collect())
    assert found == [(3, 4, 1, 1), (9, 1, 10, 10)]
    assert decontam.contaminated(none, items, broadcast_shingles=most).count() == 0
    assert decontam.contaminated(docs, items.limit(0), broadcast_shingles=most).count() == 0
    clean = decontam.clean_documents(docs, items, broadcast_shingles=most)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == sorted([*(set(range(len(TEXTS))) - {3, 9}), 5])


@pytest.mark.parametrize("most", [1000, 0])
def test_decontamination_by_repeated_and_null_items(spark, most):
    a, b, c = (" ".join(f"{x}{i}" for i in range(24)) for x in "abc")  # 20 shingles each
    items = spark.createDataFrame([(1, a), (1, b), (2, c), (2, c), (None, a.replace("a", "n"))], "item_id long, text string")
    docs = make(spark, [(1, a), (2, f"{a} {b}"), (3, f"x {c} y"), (4, a.replace("a", "n")), (5, a[: a.index(" a12")]), (6, "no item at all is here")])
    found = lambda **k: sorted((r.key, r.item, r.n_item, r.n_shared) for r in decontam.contaminated(docs, items, broadcast_shingles=most, **k).collect())
    assert found() == [(2, 1, 40, 40), (3, 2, 20, 20)]
    assert [x[:2] for x in found(least=(1, 100))] == [(1, 1), (2, 1), (3, 2), (5, 1)]
    assert sorted(r.doc_id for r in decontam.clean_documents(docs, items, broadcast_shingles=most).collect()) == [5, 6]


def plain_pairs(docs, items):
    """(document, item, shingles, shared) at 75 % containment, by comparing each document with each item."""
    of = lambda words: {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    whole = {}
    for item, text in items:
        whole[item] = whole.get(item, set()) | of(text.split())
    sets = [(d, of(text.split())) for d, text in docs]
    found = [(d, i, len(x), len(x & own)) for d, own in sets for i, x in whole.items()]
    return sorted(x for x in found if 4 * x[3] >= 3 * x[2])


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_decontamination_by_an_item_of_many_texts(spark, most):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    boiler = text(12)
    items = [(1, text(60)) for _ in range(150)] + [(k, f"{text(8)} {boiler}") for k in range(2, 150)]
    large = " ".join(t for i, t in items if i == 1)
    docs = [(1, large), (2, large[: len(large) * 4 // 5]), (3, large[: len(large) // 2]), (4, boiler)]
    docs += [(k, f"{text(30)} {items[150 + k][1]} {text(30)}") for k in range(10, 60)] + [(k, text(300)) for k in range(100, 120)]
    found = decontam.contaminated(make(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_shingles=most)
    want = plain_pairs(docs, items)
    assert len(want) == 52 and sorted((r.key, r.item, r.n_item, r.n_shared) for r in found.collect()) == want


@pytest.mark.parametrize("bits", [6, 12, decontam.FILTER_BITS])
def test_filters_let_through_what_they_were_made_from(spark, bits):
    rng = np.random.default_rng(bits)
    own, other = rng.integers(-(1 << 63), 1 << 63, (2, 300))
    seen = decontam.hash_filter(spark.createDataFrame([(int(x),) for x in own], "shingle long"), bits)
    assert len(seen) == 1 << bits - 6 and decontam.may_hold(seen, own.view(np.uint64)).all()
    kept = decontam.may_hold(seen, other.view(np.uint64))
    firsts = {int(x) >> 64 - bits for x in own.view(np.uint64)}
    assert kept.tolist() == [int(x) >> 64 - bits in firsts for x in other.view(np.uint64)]
    assert not decontam.hash_filter(spark.createDataFrame([], "shingle long"), bits).any()


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    assert packing.pack(none).count() == 0
    pieces = {}
    for r in rows:
        pieces.setdefault(r.key, []).append(r)
    assert [(r.length, r.ids_crc32) for r in pieces[0]] == [(1, zlib.crc32(b"\1\0\0\0"))]
    assert len(pieces[5]) == 2 and max(r.piece for r in pieces[7]) > 5
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096


def test_jaccard(docs, none):
    rows = jaccard_join.jaccard_components(docs).collect()
    assert len(rows) == N and jaccard_join.jaccard_components(none).count() == 0
    by = {r.key: (r.n_shingles, r.component) for r in rows if r.key is not None}
    assert [by[i] for i in range(5)] == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)] and by[6][1] == 5 and by[8][1] == 7
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 7, 9, 10]


def test_representatives_go_by_text(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    # 5 names a copy of 1 and the least of its own group; 7 names two clean texts; nulls have copies of each other and of 9
    rows = [(1, a), (5, a + " more"), (5, b), (6, b), (7, c), (7, "x " + d), (None, "n " * 3), (None, "n " * 3), (9, "one two"), (None, "one two"), (7, c), (None, None), (None, "")]
    kept = jaccard_join.representatives(make(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, a), (5, b), (7, c), (7, "x " + d), (None, "n " * 3), (9, "one two"), (None, None), (None, "")], key=repr)


def test_quality(docs, none, labels):
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == N and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.quality_scores(none, labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.good_documents(docs, labels.limit(0)).collect() == docs.collect()


def test_pages(spark):
    page = "<html><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>Some text\n here.</p><p>End.</p></article><footer>foot</footer></html>"
    pages = spark.createDataFrame([(1, "u", page, "k"), (1, "u", page, "k"), (2, None, None, "k"), (None, "v", "", "k"), (3, "w", "<p>" * 20_000 + "&bogus; <", "k")], "page_id long, url string, html string, key string")
    rows = html_extract.extract_pages(pages).collect()
    assert [r.text for r in rows if r.key == 1] == ["T & U\n\nSome text here.\n\nEnd."] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in rows if r.key in (2, None)) and len(rows) == 5
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, 1, "assistant", None), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", ""), (3, 2, "user", "more"), (4, 0, None, "x"), (None, 0, "user", "y"), (5, None, "system", "z" * 100_000)]
    rows = {r.conv_id: r for r in chat.maximal_conversations(spark.createDataFrame([(*t, "k") for t in turns], "conv_id long, turn long, role string, text string, own string")).collect()}
    assert sorted(rows, key=str) == [2, 4, 5, None] and (rows[2].n_turns, rows[2].n_copies) == (3, 2)
    assert rows[2].text.startswith("<|im_start|>user\nhi<|im_end|>\n")
    assert chat.maximal_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_columns_that_clash(spark):
    names = ["own", "fp", "kept_id", "n_copies", "n_turns", "least", "turns", "hashes", "last"]
    schema = "conv_id string, turn int, role string, text string, " + ", ".join(f"{x} string" for x in names)
    rows = [("b", 0, "user", "hi"), ("b", 0, "user", "hi"), ("b", 0, "user", "ho"), ("a", 0, "user", "hi"), ("c", 1, "user", "hi"), ("c", 2, "user", "ho")]
    got = chat.maximal_conversations(spark.createDataFrame([(*r, *names) for r in rows], schema)).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in got] == [("b", 2, 2)]


def test_a_long_conversation(spark):
    rows = spark.range(60_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    part = rows.where("turn < 30000").withColumn("conv_id", F.lit(1).cast("long"))
    got = chat.maximal_conversations(rows.union(part)).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in got] == [(7, 60_000, 1)] and got[0].text.endswith("user\n59999<|im_end|>\n")


def test_conversations_that_tasks_share(spark):
    """One id holds a third of all rows; its snapshots and a fork of it are as long. All are cut over tasks, with repeated rows."""
    hot = [(None if k < 50 and k % 7 == 0 else k // 2, ("user", "assistant")[k % 2], "same beginning " * 20 + str(k)) for k in range(900)]
    rows = [(5, *t) for t in hot] + [(2, *t) for t in hot[:700]] + [(9, *t) for t in hot] + [(4, *t) for t in hot[:800]] + [(4, 999, "user", "another end"), (None, 0, "user", "alone")]
    rows += rows[::3] + [(k, 0, "user", f"short {k % 20}") for k in range(100, 200)]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    kept = {k: spark.conf.get(k) for k in settings}
    con = duckdb.connect()
    con.execute("create table conversations as select unnest($1) as conv_id, unnest($2) as turn, unnest($3) as role, unnest($4) as text", [list(x) for x in zip(*rows)])
    want = con.execute(queries.ORACLES["op3_chat"]).fetchall()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        ordered = turns.repartitionByRange("conv_id", "turn", F.substring("role", 1, chat.BEGINNING), F.substring("text", 1, chat.BEGINNING))
        assert ordered.where("conv_id = 5").select(F.spark_partition_id()).distinct().count() > 1
        got = chat.maximal_conversations(turns).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.conv_id: (r.n_turns, r.n_copies) for r in got if r.n_turns > 1} == {4: (801, 1), 5: (900, 2)}


def test_null_ids_are_conversations_of_their_own(spark):
    """A third of all rows has no id; each is a conversation of one turn, equal ones are copies, as the SQL says."""
    rows = [(k // 4, k % 4, "user", f"text {k // 8} {k % 4}") for k in range(400)] + [(None, k % 3, None if k % 5 == 0 else "user", f"text {k % 90} 0") for k in range(200)] + [(None, None, "user", "one"), (900, 0, "user", "two"), (None, 5, "user", "two")]
    con = duckdb.connect()
    con.execute("create table conversations as select unnest($1) as conv_id, unnest($2) as turn, unnest($3) as role, unnest($4) as text", [list(x) for x in zip(*rows)])
    want = con.execute(queries.ORACLES["op3_chat"]).fetchall()
    got = chat.maximal_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    alone = {r.text: (r.n_turns, r.n_copies) for r in got if r.conv_id is None}
    assert "<|im_start|>user\ntext 3 0<|im_end|>\n" not in alone and alone["<|im_start|>user\none<|im_end|>\n"] == (1, 1)
    assert [(r.conv_id, r.n_copies) for r in got if "two" in r.text] == [(900, 2)]


def test_embeddings(spark):
    v = [1.0] + [0.0] * 7
    rows = [(1, v, 0), (2, v, 0), (3, [1.0, 0.01] + [0.0] * 6, 0), (4, None, 0), (5, [0.0] * 8, 0), (6, [float("nan")] * 8, 0), (7, [None, *v[1:]], 0), (8, [1.0], 0), (9, [1.0], 0), (10, [], 0), (11, [float("inf")] + v[1:], 0), (None, v, 0), (12, [-x for x in v], 0), (12, [0.0, 1.0] + [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int")
    got = {}
    for r in embed_dedup.near_duplicates(df).collect():
        got.setdefault(r.key, []).append((r.n_links, r.component))
    assert got[1] == [(3, 1)] and got[3] == [(3, 1)] and got[None] == [(3, 1)] and got[8] == [(1, 8)] and got[9] == [(1, 8)]
    assert all(got[i] == [(0, i)] for i in (4, 5, 6, 7, 10, 11)) and got[12] == [(0, 12)] * 2
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, none, items, labels, tmp_path, empty):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    before = none if empty else docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        after.write.parquet(path := f"{tmp_path}/{name}")
        before = spark.read.parquet(path)
        assert empty == (before.count() == 0)
    assert empty or "[EMAIL]" in next(r.text for r in before.collect() if r.doc_id == 5)
    assert empty == (corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).count() == 0)
