"""Short benchmark items inside long documents: MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.indexing import checkpointed, counted, few_tasks, running_totals

from .common import sent_if_small, ship
from .shingles import shingle_sets, small_batches

CONTAINMENT = (75, 100)
#: Shingles of all items that are sent to every executor at most (16 bytes each); beyond, the search is a join.
BROADCAST_SHINGLES = 2_000_000
#: Items that may hold a shingle before it is taken into sketches only where an item has too few others.
COMMON = 64
#: Highest bits of a hash that the filters of the join tell apart, 8 MB a filter.
FILTER_BITS = 26


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def hash_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each value of the highest ``bits`` bits: whether a row of ``shingle`` begins so. Its size is fixed, however many rows."""
    place = hashes.select(F.shiftrightunsigned("shingle", 64 - bits).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("seen")).toArrow()
    out = np.zeros(max(1, 1 << bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("seen").to_numpy().view(np.uint64)
    return out


def may_hold(seen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) a filter lets through: all that it was made from, and few others."""
    bits = len(seen).bit_length() + 5
    place = hashes >> np.uint64(64 - bits)
    return (seen[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _rows(key: str, seen=None):
    """Rows (key, shingle); with a broadcast filter, of shingles that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = shingle_sets(batch.column("text"))
            if seen is not None:
                sets = [x[may_hold(seen.value, x)] for x in sets]
            sizes = np.array([len(x) for x in sets], np.int64)
            at = np.repeat(np.arange(len(sets)), sizes)
            yield pa.RecordBatch.from_pydict({
                key: batch.column(key).take(pa.array(at)),
                "shingle": _signed(np.concatenate([*sets, np.empty(0, np.uint64)])),
            })

    return run


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", least: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """Rows (item, n, shingle, in_sketch): an item's smallest hashes are its MinHash sketch. Rows that repeat an id are one item.

    Shingles that more than ``COMMON`` items hold come last, so that boilerplate of many items makes few candidates; as
    any so many of an item's shingles can't all be missing from a document that contains it, none is lost. Null ids are
    ignored.
    """
    narrow = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("item is not null")
    kind = narrow.schema["item"].dataType.simpleString()
    rows, seen = counted(narrow.mapInArrow(_rows("item"), f"item {kind}, shingle long").dropDuplicates(["item", "shingle"]))
    rows = few_tasks(rows, seen.n)
    common, many = counted(rows.groupBy("shingle").agg(F.count("*").alias("items")).where(F.col("items") > COMMON).select("shingle", F.lit(True).alias("common")))
    late = rows.join(sent_if_small(common, many.n), "shingle", "left").select("item", "shingle", F.col("common").isNotNull().alias("late"), (F.col("shingle") < 0).alias("high"))
    # in one order of all rows, as unsigned numbers: an item of any size is sorted by as many tasks as it needs
    placed = checkpointed(running_totals(late, ["item", "late", "high", "shingle"], index="at"))
    sizes, number = counted(placed.groupBy("item").agg(F.count("*").alias("n"), F.min("at").alias("first")))
    need = F.greatest(F.lit(1), F.expr(f"({least[0]} * n + {least[1] - 1}) div {least[1]}"))
    sized = placed.join(sent_if_small(sizes, number.n), "item")
    return checkpointed(sized.select("item", "n", "shingle", (F.col("at") - F.col("first") <= F.col("n") - need).alias("in_sketch")))


def distinct_texts(items: DataFrame, text_col: str = "text") -> DataFrame:
    """(item, text): each text once under a number of its own, whatever id it has."""
    texts = items.select(F.col(text_col).alias("text")).where("text is not null").distinct()
    return checkpointed(texts.withColumn("item", F.monotonically_increasing_id()))


class SketchIndex:
    """The items by size class: within a class (sizes up to a power of two) all sketch hashes lie below one ceiling."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, in_sketch: np.ndarray):
        shingles = shingles.view(np.uint64)
        order = np.lexsort((shingles, items))
        items, sizes, shingles, in_sketch = items[order], sizes[order], shingles[order], in_sketch[order]
        self.items, self.first = np.unique(items, return_index=True)
        self.last = np.append(self.first[1:], len(items))
        self.shingles = shingles
        no = np.repeat(np.arange(len(self.items)), self.last - self.first)
        self.classes = []
        size_class = np.ceil(np.log2(np.maximum(sizes, 1)))
        for c in np.unique(size_class):
            mine = (size_class == c) & in_sketch
            by_hash = np.argsort(shingles[mine], kind="stable")
            keys, owners = shingles[mine][by_hash], no[mine][by_hash]
            seen = np.zeros(1 << 16, bool)  # of the hashes' highest bits: most shingles of a document stop here
            seen[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.classes.append((keys, owners, keys.max(initial=0), seen))

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        found = []
        for keys, owners, ceiling, seen in self.classes:
            below = doc[: np.searchsorted(doc, ceiling, "right")]
            below = below[seen[(below >> np.uint64(48)).astype(np.int64)]]
            a, b = np.searchsorted(keys, below), np.searchsorted(keys, below, "right")
            found += [owners[x:y] for x, y in zip(a[b > a], b[b > a], strict=True)]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def search(self, texts: pa.Array, least: tuple[int, int]) -> list[tuple[int, object, int, int]]:
        """(place in the batch, item, its shingles, shared ones) of all pairs with enough shared."""
        found = []
        for i, doc in enumerate(shingle_sets(texts)):
            for no in self.candidates(doc):
                n, k = self.shared(no, doc)
                if least[1] * k >= least[0] * n:
                    found.append((i, self.items[no], n, k))
        return found

    def shared(self, no: int, doc: np.ndarray) -> tuple[int, int]:
        own = self.shingles[self.first[no] : self.last[no]]
        at = np.minimum(np.searchsorted(doc, own), len(doc) - 1)
        return len(own), int((doc[at] == own).sum())


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    least: tuple[int, int] = CONTAINMENT, broadcast_shingles: int = BROADCAST_SHINGLES,
) -> DataFrame:
    """Pairs of a document and an item of whose distinct five-word shingles the document holds ``least`` (75 %) or more.

    Items are parted into size classes. An item's sketch is its smallest shingle hashes (MinHash without repeats), as
    many as can't all be missing from a document that contains enough of the item, so candidates lose nothing however
    long the document; a document's shingles above the ceiling of a class aren't looked up in it. Each candidate is
    verified by the exact number of shared shingles.

    Items whose shingles number at most ``broadcast_shingles`` are sent to the executors and documents are read once
    without a shuffle; more items are joined on sketch hashes instead, then verified by a second join, both behind
    filters of fixed size that keep back shingles that no item has.

    Null and empty texts match nothing. An item of under five words is one shingle and matches only a document that is
    the same few words. Repeated rows of an id are one document with the largest overlap of them. Rows that repeat an item
    id are one item with the shingles of all of them. Rows with a null item id are ignored, null document ids are reported. Further columns are ignored.

    Returns: key (the document's id), item, n_item, n_shared.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kinds = f"key {narrow.schema['key'].dataType.simpleString()}, item {items.schema[item_col].dataType.simpleString()}, n_item long, n_shared long"
    rows = item_shingles(items, item_col, least=least)
    index = sent_index(rows, broadcast_shingles)
    if index is not None:

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                hits = index.value.search(batch.column("text"), least)
                if hits:
                    at, item, size, shared = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_pydict({"key": batch.column("key").take(pa.array(at, pa.int64())), "item": pa.array(item), "n_item": pa.array(size, pa.int64()), "n_shared": pa.array(shared, pa.int64())})

        pairs = narrow.mapInArrow(search, kinds)
    else:
        own = narrow.withColumn("row", F.monotonically_increasing_id())
        pairs = joined_pairs(own, rows, least).join(own.select("row", "key"), "row")
    return pairs.groupBy("key", "item").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))


def sent_index(rows: DataFrame, most: int):
    """A broadcast index of the items' shingles; None where there are more than ``most``."""
    head = rows.limit(most + 1).toPandas()
    if len(head) > most:
        return None
    return rows.sparkSession.sparkContext.broadcast(SketchIndex(head["item"].to_numpy(), head["n"].to_numpy(), head["shingle"].to_numpy(), head["in_sketch"].to_numpy()))


def joined_pairs(own: DataFrame, rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(row, item, n_item, n_shared) of rows (row, text) by joins: on sketch hashes, then on all shingles of candidates.

    Tasks that read texts pass on only shingles that filters of the items' hashes let through, so what is shuffled is
    about what can be met, not all that the documents hold.
    """
    texts, send = own.select("row", "text"), rows.sparkSession.sparkContext.broadcast
    sketch = rows.where("in_sketch").select("item", "shingle")
    held = texts.mapInArrow(_rows("row", send(hash_filter(sketch))), "row long, shingle long")
    candidates, seen = counted(held.join(sketch, "shingle").select("row", "item").distinct())
    candidates = few_tasks(candidates, seen.n)
    asked, documents = counted(candidates.select("row").distinct())
    again = texts.join(sent_if_small(few_tasks(asked, documents.n), documents.n), "row", "left_semi").mapInArrow(_rows("row", send(hash_filter(rows))), "row long, shingle long")
    # by candidate, not by shingle: what many documents hold isn't met by all of them
    whole = candidates.join(rows.select("item", F.col("n").alias("n_item"), "shingle"), "item")
    shared = whole.join(again, ["row", "shingle"]).groupBy("row", "item").agg(F.first("n_item").alias("n_item"), F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") * least[1] >= F.col("n_item") * least[0])


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", least: tuple[int, int] = CONTAINMENT, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """The documents, all columns kept, without the rows that hold an item.

    Every distinct text is an item of its own, whatever its id, also where that is null or repeated; ``item_col`` isn't needed.
    """
    ship(docs.sparkSession)
    rows = item_shingles(distinct_texts(items), "item", least=least)
    index = sent_index(rows, broadcast_shingles)
    if index is not None:

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, text_col):
                clean = np.ones(batch.num_rows, bool)
                clean[[hit[0] for hit in index.value.search(batch.column(text_col), least)]] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(keep, docs.schema)
    row = f"row_{uuid.uuid4().hex}"  # no column of the documents has this name
    own = docs.withColumn(row, F.monotonically_increasing_id())
    held = joined_pairs(own.select(F.col(row).alias("row"), F.col(text_col).alias("text")), rows, least).select(F.col("row").alias(row)).distinct()
    return own.join(held, row, "left_anti").select(docs.columns)
