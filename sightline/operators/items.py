"""Items, datasets, models: filters and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tag
from .annotations import any_tag, tagged

THRESHOLD = 0.5


def filter_items(
    items: DataFrame, annotations: DataFrame, include: list[Tag] = (), exclude: list[Tag] = (), split: str = "train", dataset: str | None = None,
    subset: DataFrame | None = None, exclude_ids: DataFrame | None = None, offset: int = 0, num: int = -1,
) -> DataFrame:
    """Items of a dataset's split or, instead of both, of a subset; with any included tag, without every excluded one.

    An item appears once, however many of its annotations match. The slice is taken in order of item_id.
    """
    if subset is not None:
        found = items.join(subset.select("item_id").distinct(), "item_id", "left_semi")
    else:
        found = items.where(F.col("is_val") == (split == "val"))
        found = found if dataset is None else found.where(F.col("dataset") == dataset)
    if exclude_ids is not None:
        found = found.join(exclude_ids.select("item_id"), "item_id", "left_anti")
    if include:
        found = found.join(tagged(annotations, include).select("item_id"), "item_id", "left_semi")
    if exclude:
        found = found.join(tagged(annotations, exclude).select("item_id"), "item_id", "left_anti")
    if offset or num >= 0:
        found = found.orderBy("item_id").offset(offset)
        found = found.limit(num) if num >= 0 else found
    return found


def in_range(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Inclusive; nulls and NaN never pass."""
    return ~F.isnan(value) & value.between(low, high)


def named(items: DataFrame) -> DataFrame:
    """Without blank identifiers."""
    return items.where(F.length("identifier") > 0)


def predicted(score: Column) -> Column:
    return score > THRESHOLD


def dataset_info(items: DataFrame) -> DataFrame:
    return items.groupBy("dataset").agg(F.count_if(~F.col("is_val")).alias("num_train"), F.count_if(F.col("is_val")).alias("num_val"))


def visible_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.where(~F.col("hidden")).orderBy("name")


def output_capabilities(outputs: DataFrame) -> DataFrame:
    has = {f"has_{x}": F.coalesce(F.col(f"{x}_path") != "", F.lit(False)) for x in ("embeddings", "scores")}
    return outputs.withColumns(has)


def latest_models(models: DataFrame) -> DataFrame:
    """By name, the model last updated that has a checkpoint, and the last of those that has an output; ties by model_id."""
    order = F.struct("last_updated", "model_id")
    has_output = F.col("output_directory").isNotNull()
    return models.where("checkpoint_path is not null").groupBy("name").agg(
        F.max_by("model_id", order).alias("latest"), F.max_by(F.when(has_output, F.col("model_id")), F.when(has_output, order)).alias("with_output")
    )


def model_summary(models: DataFrame) -> DataFrame:
    """What a model list shows; ``category_spec`` is a struct of tag arrays and the flag augment_negs."""
    spec = F.col("category_spec")
    empty = F.array().cast("array<string>")
    return models.select(
        "name", "model_id", F.col("checkpoint_path").isNotNull().alias("has_checkpoint"), F.col("output_directory").isNotNull().alias("has_output"),
        F.coalesce(spec["pos_tags"], empty).alias("pos_tags"),
        F.array_sort(F.array_union(F.coalesce(spec["neg_tags"], empty), F.coalesce(spec["augment_negs_include"], empty))).alias("neg_tags"),
        F.coalesce(spec["augment_negs"], F.lit(False)).alias("augment_negs"),
    )


def usable_models(models: DataFrame) -> DataFrame:
    """Of a model summary, those with an output and a positive tag."""
    return models.where(F.col("has_output") & (F.size("pos_tags") > 0))


def epochs(models: DataFrame) -> DataFrame:
    """Adds the last epoch trained: those asked for, after those of the model resumed."""
    before = models.select(F.col("model_id").alias("resume_model_id"), F.col("epoch").alias("_before"))
    found = models.drop("epoch").join(before, "resume_model_id", "left")
    return found.withColumn("epoch", F.col("epochs_to_run") - 1 + F.when(F.col("resume_training"), F.coalesce(F.col("_before") + 1, F.lit(0))).otherwise(0)).drop("_before")


def by_name(table: DataFrame, column: str = "name", descending: bool = False) -> DataFrame:
    """In case-insensitive order of a text column."""
    key = F.lower(column)
    return table.orderBy(key.desc() if descending else key.asc(), column)


def with_any_tag(annotations: DataFrame, tags: list[Tag], name: str) -> DataFrame:
    """(item_id, name): whether the item has any of the tags, for annotated items."""
    return annotations.groupBy("item_id").agg(F.bool_or(any_tag(tags)).alias(name))
