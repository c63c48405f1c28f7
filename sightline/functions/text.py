"""Column expressions over names, tags and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Tag = tuple[str, str]

PUBLIC_HOST = "https://storage.googleapis.com"


def parse_tags(tags: str | list[str] | None) -> list[Tag]:
    """``'category:value,category:value'`` or a list of such, blanks left out, each once; other shapes raise ValueError."""
    parts = tags.split(",") if isinstance(tags, str) else tags or []
    found = []
    for part in filter(None, parts):
        category, value = part.split(":")
        found.append((category, value))
    return list(dict.fromkeys(found))


def tags_of(column: Column) -> Column:
    """The column form of ``parse_tags``: an array of (category, value)."""
    parts = F.filter(F.split(column, ","), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("category"), F.split_part(x, F.lit(":"), F.lit(2)).alias("value"))))


def tag_text(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(t["category"], F.lit(":"), t["value"])), ",")


def public_path(directory: Column, path: Column) -> Column:
    """Where a browser finds an item: its bucket's public address, its own address, or the file server."""
    return (
        F.when(directory.startswith("gs://"), F.concat(F.lit(f"{PUBLIC_HOST}/"), F.split_part(directory, F.lit("/"), F.lit(3)), F.lit("/"), path))
        .when(directory.startswith("http"), path)
        .when(path.startswith("/"), F.concat(F.lit("/files"), path))
        .otherwise(F.concat(F.lit("/files"), F.rtrim(directory, F.lit("/")), F.lit("/"), path))
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def result_id(path: Column) -> Column:
    """The file name up to its last full stop, as result pages name items."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def stack_id(path: Column) -> Column:
    """The file name up to its first full stop, as the validation stack names items."""
    return F.substring_index(file_name(path), ".", 1)


def export_path(split: Column, path: Column) -> Column:
    return F.concat(F.when(split == "train", F.lit("train_images/")).otherwise(F.lit("val_images/")), file_name(path))


def custom_mode(mode: Column) -> Column:
    """Trimmed and in lower case; blank modes are null."""
    return F.nullif(F.lower(F.trim(mode)), F.lit(""))
