"""The annotation log, the state it stands for, and what is counted and changed in it.

A log row is (batch_id, kind, item_id, user_email, category, mode, is_box, x1, y1, x2, y2, created, misc_data). A batch of
kind ``replace`` replaces the tags of the items and categories that it names; ``append`` adds to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tag
from .indexing import checkpointed

MODES = ("POSITIVE", "NEGATIVE", "HARD_NEGATIVE", "UNSURE")
TOMBSTONE = "TOMBSTONE"
BOX = ("x1", "y1", "x2", "y2")


def current(log: DataFrame) -> DataFrame:
    """The annotations in force: boxes, and the tags since the last replacing batch of their item and category.

    All rows of that batch survive, so several modes can hold together; tombstones only delete. The latest batch of a
    key is aggregated before the join, so a key with a long history isn't gathered in one task.
    """
    key = ["item_id", "category"]
    latest = log.where(~F.col("is_box") & (F.col("kind") == "replace")).groupBy(*key).agg(F.max("batch_id").alias("latest"))
    known = log.join(latest, key, "left")
    alive = F.col("is_box") | F.col("latest").isNull() | (F.col("batch_id") >= F.col("latest"))
    return known.where(alive & (F.col("mode") != TOMBSTONE)).drop("latest")


def set_tag(items: DataFrame, batch_id: int, user: str, category: str, mode: str, single: bool = False) -> DataFrame:
    """Log rows of one replacing batch that gives every item the tag."""
    return batch(items.select("item_id").distinct().withColumns({"category": F.lit(category), "mode": F.lit(mode)}), batch_id, user, created_by="tag" if single else "tag-bulk")


def batch(rows: DataFrame, batch_id: int, user: str, kind: str = "replace", created_by: str = "tag-bulk") -> DataFrame:
    """Log rows of one batch from rows (item_id, category, mode and, where there are boxes, x1, y1, x2, y2)."""
    boxes = [F.col(x).cast("double").alias(x) if x in rows.columns else F.lit(None).cast("double").alias(x) for x in BOX]
    return rows.select(
        F.lit(batch_id).cast("long").alias("batch_id"), F.lit(kind).alias("kind"), "item_id", F.lit(user).alias("user_email"), F.trim("category").alias("category"), "mode",
        boxes[0].isNotNull().alias("is_box") if "x1" not in rows.columns else F.col("x1").isNotNull().alias("is_box"), *boxes,
        F.current_timestamp().alias("created"), F.to_json(F.struct(F.lit(created_by).alias("created_by"))).alias("misc_data"),
    )


def validation_rows(rows: DataFrame, items: DataFrame, batch_id: int, user: str, model: str) -> DataFrame:
    """Appended log rows of validation answers (item_id, category, mode, is_other_negative); items must be of the val split."""
    asked = rows.join(items.select("item_id", "is_val"), "item_id", "left")
    checked = F.when(F.col("is_val"), F.col("item_id")).otherwise(F.raise_error(F.lit("a validation item isn't in the val split")).cast("long"))
    other = F.coalesce("is_other_negative", F.lit(False))
    answers = asked.select(checked.alias("item_id"), F.when(other, F.lit(f"active:{model}")).otherwise(F.col("category")).alias("category"), F.when(other, F.lit("NEGATIVE")).otherwise(F.col("mode")).alias("mode"))
    return batch(answers, batch_id, user, kind="append", created_by="active_val")


def resolve(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Adds item_id to rows addressed by identifier, else pk, else path; an address of no item fails the query."""
    by_name = items.select(F.col("identifier"), F.col("item_id").alias("_by_name"))
    by_path = items.select(F.col("path"), F.col("item_id").alias("_by_path"))
    by_pk = items.select(F.col("item_id").alias("pk"), F.col("item_id").alias("_by_pk"))
    found = rows.join(by_name, "identifier", "left").join(by_pk, "pk", "left").join(by_path, "path", "left")
    item = F.when(F.col("identifier").isNotNull(), F.col("_by_name")).when(F.col("pk").isNotNull(), F.col("_by_pk")).otherwise(F.col("_by_path"))
    return found.withColumn("item_id", F.coalesce(item, F.raise_error(F.lit("an annotation names no item")).cast("long"))).drop("_by_name", "_by_path", "_by_pk")


#: Why an imported row is refused. Fixed values.
NO_ADDRESS, UNKNOWN, NO_TAG, NO_BOX = "no address", "names no item", "no category or mode", "box without corners"


def addressed(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows with the item that their identifier, else pk, else path names, and the error of those that can't be imported.

    A row has one address, so one join on the address finds all items; of items that share one the least id is taken. Rows
    without an address are spread over the join by hashes of their own. rows: any columns with category and mode, and
    identifier, pk, path, is_box, x1, y1, x2, y2 where they have them; adds item_id and error (null: none).
    """
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    address = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    given = F.coalesce(address("i:", has("identifier")), address("k:", has("pk")), address("p:", has("path")))
    every = F.array(address("i:", F.col("identifier")), address("k:", F.col("item_id")), address("p:", F.col("path")))
    known = items.select("item_id", F.explode(every).alias("_address")).where("_address is not null").groupBy("_address").agg(F.min("item_id").alias("_item"))
    own = rows.drop("item_id", "error").withColumn("_given", given).withColumn("_address", F.coalesce("_given", F.concat(F.lit("-:"), F.monotonically_increasing_id().cast("string"))))
    found = own.join(known, "_address", "left")
    blank = lambda c: F.coalesce(F.trim(has(c).cast("string")) == "", F.lit(True))
    corners = reduce(lambda a, b: a & b, [has(x).isNotNull() for x in BOX])
    error = (
        F.when(F.col("_given").isNull(), NO_ADDRESS).when(F.col("_item").isNull(), F.concat(F.substring("_given", 3, 1 << 30), F.lit(" " + UNKNOWN)))
        .when(blank("category") | blank("mode"), NO_TAG).when(F.coalesce(has("is_box").cast("boolean"), F.lit(False)) & ~corners, NO_BOX)
    )
    return found.withColumn("error", error).withColumn("item_id", F.when(F.col("error").isNull(), F.col("_item"))).drop("_address", "_given", "_item")


def import_batch(rows: DataFrame, items: DataFrame, batch_id: int, user: str, created_by: str = "tag-bulk") -> tuple[DataFrame, DataFrame]:
    """(log rows, refused rows) of one import: what can be resolved as one replacing batch, the rest as it came with its ``error``.

    Rows are resolved once and checkpointed; both results read that. Tombstones are log rows too: they take an item's tags of the category away.
    """
    done = checkpointed(addressed(rows, items))
    good = done.where("error is null")
    if "is_box" in rows.columns:  # corners of what isn't a box don't make it one
        good = good.withColumns({x: F.when(F.col("is_box"), F.col(x)) for x in BOX if x in rows.columns})
    return batch(good, batch_id, user, created_by=created_by), done.where("error is not null").drop("item_id")


def tagged(annotations: DataFrame, tags: list[Tag]) -> DataFrame:
    """The annotations, boxes too, that are one of the tags."""
    return annotations.where(any_tag(tags))


def any_tag(tags: list[Tag]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col("category") == c) & (F.col("mode") == v) for c, v in tags], F.lit(False))


def retrieve(annotations: DataFrame, item_ids: DataFrame | None = None, categories: list[str] = (), modes: list[str] = ()) -> DataFrame:
    """Annotations of the given items, categories and modes; what isn't given doesn't restrict."""
    found = annotations
    if item_ids is not None:
        found = found.join(item_ids.select("item_id").where("item_id is not null").distinct(), "item_id", "left_semi")
    if categories:
        found = found.where(F.col("category").isin(*categories))
    return found.where(F.col("mode").isin(*modes)) if modes else found


def category_counts(annotations: DataFrame, items: DataFrame) -> DataFrame:
    return annotations.join(items.select("item_id", "dataset"), "item_id").groupBy("dataset", "category", "mode").agg(F.count("*").alias("n"))


def tag_table(counts: DataFrame) -> DataFrame:
    """A row per category, a column per built-in mode, all custom modes under OTHER; absent ones are 0."""
    columns = [*MODES, "OTHER"]
    mode = F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise("OTHER")
    return counts.withColumn("mode", mode).groupBy("category").pivot("mode", columns).agg(F.sum("n")).na.fill(0, columns)


def custom_modes(counts: DataFrame) -> DataFrame:
    return counts.where(~F.col("mode").isin(*MODES)).groupBy("category").agg(F.array_sort(F.collect_set("mode")).alias("modes"))


def merge_counts(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh counts override; known categories and modes without one stay, with 0."""
    both = known.select("category", "mode").distinct().join(fresh.select("category", "mode", "n"), ["category", "mode"], "full_outer")
    return both.select("category", "mode", F.coalesce("n", F.lit(0)).alias("n"))


def per_item(annotations: DataFrame) -> DataFrame:
    """Each annotated item's sorted tags and sorted boxes; one of the two may be empty."""
    tag = F.struct("category", F.col("mode").alias("value"))
    box = F.struct("category", F.col("mode").alias("value"), *BOX)
    return annotations.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_box"), tag))).alias("tags"), F.array_sort(F.collect_list(F.when(F.col("is_box"), box))).alias("boxes")
    )


def per_path(annotations: DataFrame, items: DataFrame) -> DataFrame:
    """Items' tags by path, as (category, mode)."""
    found = per_item(annotations).join(items.select("item_id", "path"), "item_id")
    return found.select("path", F.transform("tags", lambda t: F.struct(t["category"].alias("category"), t["value"].alias("mode"))).alias("annotations"))


def common_tags(annotations: DataFrame, selection: DataFrame, group: str = "group_id") -> DataFrame:
    """Tags that every item of a selection (group, item_id) has."""
    sizes = selection.groupBy(group).agg(F.countDistinct("item_id").alias("size"))
    tags = annotations.where(~F.col("is_box")).select("item_id", "category", F.col("mode").alias("value")).distinct()
    seen = selection.select(group, "item_id").distinct().join(tags, "item_id").groupBy(group, "category", "value").agg(F.count("*").alias("n"))
    return seen.join(sizes, group).where("n = size").select(group, "category", "value")


def tag_difference(before: Column, after: Column) -> Column:
    """(added, deleted, deleted whose category has no added tag) of two tag arrays."""
    added, deleted = F.array_except(after, before), F.array_except(before, after)
    return F.struct(added.alias("added"), deleted.alias("deleted"), F.filter(deleted, lambda d: ~F.exists(added, lambda a: a["category"] == d["category"])).alias("deleted_only"))


def merge_tags(tags: Column, added: Column, deleted: Column) -> Column:
    """Without the deleted, with the added as the last ones, wherever they stood before; of several tags of a category the last stays."""
    merged = F.array_union(F.array_except(tags, F.array_union(deleted, added)), added)
    at = F.transform(merged, lambda t, i: F.struct(t.alias("tag"), i.alias("i")))
    kept = F.filter(at, lambda x: ~F.exists(at, lambda y: (y["tag"]["category"] == x["tag"]["category"]) & (y["i"] > x["i"])))
    return F.transform(kept, lambda x: x["tag"])


def rename_category(annotations: DataFrame, old: str, new: str) -> DataFrame:
    return annotations.withColumn("category", F.when(F.col("category") == old, new).otherwise(F.col("category")))


def delete_category(annotations: DataFrame, category: str) -> DataFrame:
    return annotations.where(~F.col("category").eqNullSafe(category))


def delete_dataset(table: DataFrame, items: DataFrame, dataset: str) -> DataFrame:
    """Any table without the rows of the dataset, which it names itself or through its items."""
    if "dataset" in table.columns:
        return table.where(~F.col("dataset").eqNullSafe(dataset))
    return table.join(items.where(F.col("dataset") == dataset).select("item_id"), "item_id", "left_anti")


def rename(table: DataFrame, old: str, new: str, column: str = "name") -> DataFrame:
    return table.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def delete(table: DataFrame, name: str, column: str = "name") -> DataFrame:
    return table.where(~F.col(column).eqNullSafe(name))
