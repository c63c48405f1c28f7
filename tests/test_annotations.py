from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sightline.functions import text as X
from sightline.operators import annotations as A
from sightline.operators import items as I

LOG = "batch_id long, kind string, item_id long, user_email string, category string, mode string, is_box boolean, x1 double, y1 double, x2 double, y2 double, created timestamp, misc_data string"


def log(spark, *rows):
    now = datetime(2024, 1, 1)
    return spark.createDataFrame([(b, k, i, "u", c, m, box, *((1.0, 2.0, 3.0, 4.0) if box else (None,) * 4), now, "{}") for b, k, i, c, m, box in rows], LOG)


def state(df):
    return sorted((r.item_id, r.category, r.mode) for r in A.current(df).collect())


def test_tombstone_with_a_value_keeps_the_value(spark):
    assert state(log(spark, (1, "replace", 1, "a", "TOMBSTONE", False), (1, "replace", 1, "a", "POSITIVE", False))) == [(1, "a", "POSITIVE")]


def test_two_modes_of_one_batch_coexist_and_replace_earlier_ones(spark):
    df = log(spark, (1, "replace", 1, "a", "UNSURE", False), (2, "replace", 1, "a", "POSITIVE", False), (2, "replace", 1, "a", "NEGATIVE", False))
    assert state(df) == [(1, "a", "NEGATIVE"), (1, "a", "POSITIVE")]


def test_boxes_survive_a_replacement(spark):
    df = log(spark, (1, "replace", 1, "a", "POSITIVE", True), (2, "replace", 1, "a", "NEGATIVE", False))
    assert state(df) == [(1, "a", "NEGATIVE"), (1, "a", "POSITIVE")]


def test_appended_rows_fall_to_a_later_replacement_only(spark):
    df = log(spark, (1, "append", 1, "a", "POSITIVE", False), (2, "replace", 1, "a", "NEGATIVE", False), (3, "append", 1, "a", "UNSURE", False))
    assert state(df) == [(1, "a", "NEGATIVE"), (1, "a", "UNSURE")]


def test_empty_log(spark):
    assert state(log(spark)) == []


def test_subset_ignores_the_split_and_items_come_once(spark):
    items = spark.createDataFrame([(1, "d", False), (2, "d", True)], "item_id long, dataset string, is_val boolean")
    cur = log(spark, (1, "replace", 2, "a", "POSITIVE", False), (1, "replace", 2, "b", "POSITIVE", False))
    found = I.filter_items(items, cur, include=[("a", "POSITIVE"), ("b", "POSITIVE")], split="train", subset=spark.createDataFrame([(2,), (1,)], "item_id long"))
    assert [r.item_id for r in found.collect()] == [2]


def test_parse_tags(spark):
    assert X.parse_tags("a:X,,b:Y,a:X") == [("a", "X"), ("b", "Y")]
    assert X.parse_tags(None) == []
    with pytest.raises(ValueError):
        X.parse_tags("active:m:NEGATIVE")
    row = spark.createDataFrame([("a:X,,b:Y,a:X",)], "s string").select(X.tags_of(F.col("s")).alias("t")).first()
    assert [tuple(t) for t in row.t] == [("a", "X"), ("b", "Y")]


def test_merge_keeps_the_last_of_a_category(spark):
    t = lambda *x: F.array(*[F.struct(F.lit(c).alias("category"), F.lit(v).alias("value")) for c, v in x])
    row = spark.range(1).select(A.merge_tags(t(("a", "X"), ("b", "Y")), t(("a", "Z")), t(("b", "Y"))).alias("m")).first()
    assert [tuple(x) for x in row.m] == [("a", "Z")]


def test_merge_lets_an_added_tag_win_that_was_there(spark):
    """An item can hold several modes of a category, the added one before another."""
    t = lambda *x: F.array(*[F.struct(F.lit(c).alias("category"), F.lit(v).alias("value")) for c, v in x])
    row = spark.range(1).select(A.merge_tags(t(("a", "X"), ("a", "Y"), ("b", "Y")), t(("a", "X")), t(("b", "Y"))).alias("m")).first()
    assert [tuple(x) for x in row.m] == [("a", "X")]


def test_tag_difference(spark):
    t = lambda *x: F.array(*[F.struct(F.lit(c).alias("category"), F.lit(v).alias("value")) for c, v in x])
    row = spark.range(1).select(A.tag_difference(t(("a", "X"), ("b", "Y")), t(("a", "Z"))).alias("d")).first().d
    assert [[tuple(t) for t in x] for x in (row.added, row.deleted, row.deleted_only)] == [[("a", "Z")], [("a", "X"), ("b", "Y")], [("b", "Y")]]


def test_batches_and_validation_rows(spark):
    items = spark.createDataFrame([(1, True), (2, False)], "item_id long, is_val boolean")
    one = A.set_tag(items, 3, "u", " cat ", "POSITIVE").orderBy("item_id").collect()
    assert [(r.item_id, r.category, r.kind, r.is_box) for r in one] == [(1, "cat", "replace", False), (2, "cat", "replace", False)]
    asked = "item_id long, category string, mode string, is_other_negative boolean"
    rows = A.validation_rows(spark.createDataFrame([(1, "c", "POSITIVE", True)], asked), items, 4, "u", "m").collect()
    assert [(r.category, r.mode, r.kind) for r in rows] == [("active:m", "NEGATIVE", "append")]
    with pytest.raises(Exception, match="val split"):
        A.validation_rows(spark.createDataFrame([(2, "c", "POSITIVE", False)], asked), items, 4, "u", "m").collect()


def test_unresolved_address_fails(spark):
    items = spark.createDataFrame([(1, "id-1", "p")], "item_id long, identifier string, path string")
    with pytest.raises(Exception, match="names no item"):
        A.resolve(spark.createDataFrame([("nope", None, None)], "identifier string, pk long, path string"), items).collect()


def test_deletions_and_renames(spark):
    items = spark.createDataFrame([(1, "d"), (2, "e")], "item_id long, dataset string")
    cur = log(spark, (1, "replace", 1, "a", "POSITIVE", False), (1, "replace", 2, "a", "POSITIVE", False))
    assert [r.item_id for r in A.delete_dataset(cur, items, "d").collect()] == [2]
    assert [r.item_id for r in A.delete_dataset(items, items, "d").collect()] == [2]
    models = spark.createDataFrame([("x",), ("y",)], "name string")
    assert sorted(r.name for r in A.rename(models, "x", "z").collect()) == ["y", "z"]
    assert [r.name for r in A.delete(models, "x").collect()] == ["y"]
    assert spark.createDataFrame([("  Blurry ",), (" ",)], "m string").select(X.custom_mode(F.col("m")).alias("m")).collect() == [("blurry",), (None,)]


def test_imports_are_split_into_log_rows_and_refusals(spark):
    items = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "b", None), (4, None, "q")], "item_id long, identifier string, path string")
    rows = [
        ("b", None, None, "x", "POSITIVE", None, None), (None, 4, None, " x ", "POSITIVE", False, None), (None, None, "q", "x", "TOMBSTONE", None, 5.0), ("a", 9, "zz", "y", "NEGATIVE", True, 1.0), ("a", None, None, "y", "NEGATIVE", True, None),
        (None, None, None, "x", "POSITIVE", None, None), (None, None, None, "x", "POSITIVE", None, None), ("c", 1, "p", "x", "POSITIVE", None, None), (None, 7, None, "x", "POSITIVE", None, None), ("a", None, None, "  ", "POSITIVE", None, None), ("a", None, None, "x", None, None, None),
    ]
    df = spark.createDataFrame([(*r[:6], r[6], 1.0, 2.0, 3.0, k) for k, r in enumerate(rows)], "identifier string, pk long, path string, category string, mode string, is_box boolean, x1 double, y1 double, x2 double, y2 double, item_id long")
    log, refused = A.import_batch(df, items, 8, "me")
    got = sorted((r.item_id, r.category, r["mode"], r.is_box, r.x1) for r in log.collect())
    assert got == [(1, "y", "NEGATIVE", True, 1.0), (2, "x", "POSITIVE", False, None), (2, "x", "TOMBSTONE", False, None), (4, "x", "POSITIVE", False, None)]
    assert {(r.batch_id, r.kind, r.user_email) for r in log.collect()} == {(8, "replace", "me")}
    assert sorted(r.error for r in refused.collect()) == ["7 names no item", "box without corners", "c names no item", "no address", "no address", "no category or mode", "no category or mode"]
    narrow = spark.createDataFrame([("p", "x", "POSITIVE"), ("no", "x", "POSITIVE")], "path string, category string, mode string")
    log, refused = A.import_batch(narrow, items, 8, "me")
    assert [(r.item_id, r.is_box) for r in log.collect()] == [(1, False)] and [(r.path, r.error) for r in refused.collect()] == [("no", "no names no item")]
    assert [x.count() for x in A.import_batch(narrow.limit(0), items, 8, "me")] == [0, 0]
