"""Documents whose sets of word shingles overlap: banded tiles, bitmap bounds, exact intersections."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.indexing import checkpointed, counted, few_tasks

from .common import sent_if_small, ship
from .graph import parents
from .shingles import mixed, shingle_sets, small_batches

JACCARD = (75, 100)
#: Tiles of a document: a pair at the threshold shares none of them with probability (1 - 0.75^3)^40 < 4e-10.
TILES, ROWS = 40, 3
LEAST_BITS = 256
#: Distinct texts with their signatures that are worth a task of their own.
TEXTS_PER_TASK = 1 << 12

_FACTORS = (mixed(np.arange(1, TILES * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def tile_keys(shingles: np.ndarray) -> np.ndarray:
    """``TILES`` keys; two sets have one in common with probability J^ROWS for each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), np.uint32(0xFFFFFFFF))
    for a in range(0, len(x), 512):
        products = x[None, a : a + 512] * _FACTORS[:, None]
        products ^= products >> np.uint32(15)
        np.minimum(least, products.min(axis=1), out=least)
    key = np.arange(1, TILES + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS])
    return key.view(np.int64)


def bit_count(n: int) -> int:
    """Bits of the bitmap of a set of ``n``: a power of two, at least ``n``, so that it stays sparse enough to bound."""
    return max(LEAST_BITS, 1 << int(n - 1).bit_length()) if n else LEAST_BITS


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity bitmap: each element flips the bit that its hash names."""
    bits = bit_count(len(shingles))
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def overlap_bound(n1: int, bits1: bytes, n2: int, bits2: bytes) -> int:
    """At most so many elements are shared: bits in which parity bitmaps differ are elements of one set only.

    A wider bitmap is folded onto the narrower one's width, which keeps it a parity bitmap.
    """
    x, y = np.frombuffer(bits1, np.uint8), np.frombuffer(bits2, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return (n1 + n2 - int(np.bitwise_count(x ^ y).sum())) // 2


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_pydict({
            "key": batch.column("key"), "fp": batch.column("fp"), "n": pa.array([len(x) for x in sets], pa.int64()),
            "tiles": pa.array([tile_keys(x) if len(x) else [] for x in sets], pa.list_(pa.int64())), "bits": pa.array([bitmap(x) for x in sets], pa.binary()),
        })


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        yield pa.RecordBatch.from_pydict({"no": batch.column("no"), "shingles": pa.array([x.tobytes() for x in shingle_sets(batch.column("text"))], pa.binary())})


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n1, n2 = batch.column("n1").to_pylist(), batch.column("n2").to_pylist()
        bound = [overlap_bound(a, x.as_buffer(), b, y.as_buffer()) for a, x, b, y in zip(n1, batch.column("bits1"), n2, batch.column("bits2"), strict=True)]
        keep = pa.array([linked(a, b, k) for a, b, k in zip(n1, n2, bound, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(keep)


def _do_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "shingles1", 1 << 22):
        keep = []
        for x, y in zip(batch.column("shingles1"), batch.column("shingles2"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
            keep.append(bool(len(x) and len(y)) and linked(len(x), len(y), int((y[at] == x).sum())))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))


def linked(n1: int, n2: int, shared: int) -> bool:
    return shared > 0 and JACCARD[1] * shared >= JACCARD[0] * (n1 + n2 - shared)


def sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * JACCARD[1] >= F.greatest(a, b) * JACCARD[0]


def size_band(n: Column) -> Column:
    """Sets in one band have sizes that allow the least similarity."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(JACCARD[1] / JACCARD[0]))).cast("int")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "shingles"):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
        at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        yield pa.RecordBatch.from_pydict({"no": batch.column("no").take(at), "shingle": pa.array(np.concatenate([*sets, np.empty(0, np.int64)]))})


def prefix_pairs(sets: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (no, shingles) in different components that may link; none that do is left out.

    ``of``: (no, n, component) of the sets. Shingles are ordered by the number of sets that hold them, the rarest first. Sets
    that link share one of the first ``n - ceil(0.75 n) + 1`` of either. The places of the first that they share bound
    their overlap: what comes before it is not shared. So a copy with many changes of its own, though it shares long runs
    with thousands of others, meets none of them, as its first shingles are its own.
    """
    rows = sets.mapInArrow(_exploded, "no long, shingle long")
    held = checkpointed(rows.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"))
    common = rows.join(held, "shingle")  # what only one set holds comes first in its order, and meets nothing
    own = Window.partitionBy("no")
    # shingles after this one; a set's own rows, and no more than those, meet in one task
    placed = common.withColumn("rest", F.count("*").over(own) - F.row_number().over(own.orderBy("held", "shingle"))).select("no", "shingle", "rest")
    needed = F.ceil(F.col("n") * JACCARD[0] / JACCARD[1])
    prefixes = placed.join(of, "no").where(F.col("rest") + 1 >= needed).select("shingle", "no", "component", "n", "rest")
    prefixes, seen = counted(prefixes)
    prefixes = few_tasks(prefixes, seen.n)
    parts = few_tasks(prefixes.groupBy("shingle", "component").agg(F.count("*").alias("size")), seen.n)
    main = parts.groupBy("shingle").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("shingle", "main")
    main = checkpointed(few_tasks(main, seen.n))
    every = few_tasks(checkpointed(few_tasks(prefixes.join(main, "shingle"), seen.n)), seen.n)
    few = every.where("component <> main").select("shingle", F.col("no").alias("a"), F.col("component").alias("c"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
    bound = (1 + F.least("rest", "rest_a")) * (JACCARD[0] + JACCARD[1]) >= (F.col("n") + F.col("n_a")) * JACCARD[0]
    once = (F.col("component") == F.col("main")) | (F.col("a") < F.col("no"))
    met = few.join(every, "shingle").where((F.col("component") != F.col("c")) & sizes_fit(F.col("n"), F.col("n_a")) & bound & once)
    return met.select(F.least("a", "no").alias("a"), F.greatest("a", "no").alias("b")).distinct()


def verified(pairs: DataFrame, bits: DataFrame, arrays: DataFrame, texts: int) -> DataFrame:
    """The pairs (a, b) that link: by size and bitmap first, which are small, then by the sorted arrays of those left.

    ``texts``: the number of rows of ``bits`` and ``arrays``.
    """

    def with_both(pairs: DataFrame, n: int, df: DataFrame, per_task: int) -> DataFrame:
        ids, wanted = counted(pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct())
        df = df.join(sent_if_small(few_tasks(ids, wanted.n), wanted.n), "no", "left_semi")  # what no pair needs isn't shuffled
        for side, end in (("a", "1"), ("b", "2")):
            own = df.select(F.col("no").alias(side), *(F.col(x).alias(x + end) for x in df.columns if x != "no"))
            pairs = few_tasks(pairs.join(own, side), max(n, texts), per_task)
        return pairs

    pairs, seen = counted(pairs)
    bounded = with_both(few_tasks(pairs, seen.n), seen.n, bits, TEXTS_PER_TASK)
    bounded, seen = counted(bounded.select("a", "b", "n1", "bits1", "n2", "bits2").mapInArrow(_may_link, "a long, b long"))
    exact = with_both(few_tasks(bounded, seen.n), seen.n, arrays, TEXTS_PER_TASK // 4)
    return checkpointed(exact.select("a", "b", "shingles1", "shingles2").mapInArrow(_do_link, "a long, b long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connects documents whose five-word shingle sets have a Jaccard similarity of 75 % or more.

    1. Equal texts are one class: a row per text with its set's size, parity bitmap and tile keys.
    2. A tile holds the classes with one key. Only those in a tile with another are looked at further.
    3. In each tile and size band, the class that meets most others is the centre. Every class is compared with the centre
       that most of its tiles name: a star, not all pairs. The links found merge most groups of copies.
    4. Classes in tiles that still hold several components are compared across components by a prefix filter over their
       shingles, rarest first, so that no link that could merge two components is left out.
    A comparison bounds the overlap by the bitmaps' differing bits first, then intersects the sorted arrays. Pairs inside a
    component aren't compared, as they can't change it.

    Null ids are kept; null texts and texts without words link with nothing. Equal texts always link, whatever their
    length. Repeated rows are documents of their own. Further columns are ignored.

    Returns: key (the id), n_shingles, component (the least id of the component, itself included).
    """
    joined = linked_texts(docs, id_col, text_col)
    least = checkpointed(joined.groupBy("root").agg(F.min("least").alias("component")))
    by_class = checkpointed(joined.join(least, "root").select("fp", "n", "component"))
    keys = docs.select(F.col(id_col).alias("key"), fingerprint(text_col).alias("fp"))
    return keys.join(by_class, "fp", "left").select("key", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component", "key").alias("component"))


def fingerprint(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def linked_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, n, no, least, copies, root) of each distinct text with words: its set's size, number, least id, copies and component."""
    ship(docs.sparkSession)
    named = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), fingerprint(text_col).alias("fp"), F.col(text_col).alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    signed = named.mapInArrow(_signed, f"key {kind}, fp string, n long, tiles array<long>, bits binary").where("n > 0")
    classes = signed.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("copies"), *(F.first(x).alias(x) for x in ("n", "tiles", "bits")))
    classes, texts = counted(classes.withColumn("no", F.monotonically_increasing_id()))
    classes = few_tasks(classes, texts.n, TEXTS_PER_TASK)

    entries = classes.select(F.explode("tiles").alias("tile"), "no", size_band(F.col("n")).alias("band"))
    shared, seen = counted(few_tasks(entries.groupBy("tile").agg(F.count("*").alias("size")).where("size > 1"), TILES * texts.n))
    tiles = few_tasks(entries.join(sent_if_small(few_tasks(shared, seen.n), seen.n), "tile"), TILES * texts.n)
    met = tiles.groupBy("no").agg(F.sum("size").alias("met"), F.collect_list(F.struct("tile", "band")).alias("at"))  # no more than TILES
    met, members = counted(few_tasks(met, texts.n, TEXTS_PER_TASK))
    met = few_tasks(met, members.n, TEXTS_PER_TASK)
    sent = sent_if_small(met.select("no"), members.n)
    known, _ = counted(few_tasks(classes.select("no", "fp", "n", "bits").join(sent, "no", "left_semi"), texts.n, TEXTS_PER_TASK))
    whole = named.join(sent_if_small(known.select("fp"), members.n), "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text"))
    arrays = few_tasks(whole.join(known.select("fp", "no"), "fp"), members.n, TEXTS_PER_TASK // 4)
    arrays = checkpointed(arrays.select("no", "text").mapInArrow(_arrays, "no long, shingles binary"))
    bits = known.select("no", "n", "bits")

    placed = met.select("no", "met", F.explode("at").alias("at")).select("no", "met", "at.tile", "at.band")
    centres = checkpointed(few_tasks(placed.groupBy("tile", "band").agg(F.max_by("no", F.struct("met", "no")).alias("a")), TILES * members.n))
    stars = few_tasks(placed.join(centres, ["tile", "band"]).where("a <> no"), TILES * members.n).groupBy("no").agg(F.mode("a", True).alias("a"))
    links = verified(stars.select(F.least("a", "no").alias("a"), F.greatest("a", "no").alias("b")), bits, arrays, members.n)

    first = parents(links).select(F.col("node").alias("no"), "component")
    placed, _ = counted(few_tasks(met.select("no", "at.tile").join(first, "no", "left").select("no", "tile", F.coalesce("component", "no").alias("component")), members.n, TEXTS_PER_TASK))
    placed = placed.select("no", "component", F.explode("tile").alias("tile"))
    open_ = placed.groupBy("tile").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("tile")
    open_, seen = counted(few_tasks(open_, TILES * members.n))
    inside = placed.join(sent_if_small(open_, seen.n), "tile", "left_semi").select("no", "component")
    inside, seen = counted(few_tasks(inside, TILES * members.n).distinct())
    inside = few_tasks(inside, seen.n)
    sets = few_tasks(arrays.join(sent_if_small(inside.select("no"), seen.n), "no", "left_semi"), members.n, TEXTS_PER_TASK // 4)
    more = verified(prefix_pairs(sets, inside.join(bits.select("no", "n"), "no")), bits, arrays, members.n)
    final = parents(links.union(more)).select(F.col("node").alias("no"), F.col("component").alias("root"))

    found = classes.select("fp", "n", "no", "least", "copies").join(final, "no", "left")
    return checkpointed(found.withColumn("root", F.coalesce("root", "no")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one document, that with the least id; all columns kept.

    Texts decide, not ids: of a component the text that holds the least id stays (null ids come last), and of its copies
    the one with that id. So an id that names several texts is judged for each of them, and of rows that repeat id and text
    one stays. Documents without words stay.
    """
    joined = linked_texts(docs, id_col, text_col)
    order = F.struct(F.col("least").isNull().alias("last"), "least", "fp")
    best = checkpointed(joined.groupBy("root").agg(F.min(order)["fp"].alias("best")))
    placed = joined.join(best, "root")
    fp, last = f"fp_{uuid.uuid4().hex}", f"least_{uuid.uuid4().hex}"  # no columns of the documents have these names
    gone, dropped = counted(placed.where("fp <> best").select(F.col("fp").alias(fp)))
    copied, several = counted(placed.where("fp = best and copies > 1").select(F.col("fp").alias(fp), F.col("least").alias(last)))
    docs_ = docs.withColumn(fp, fingerprint(text_col))
    kept = docs_.join(sent_if_small(gone, dropped.n), fp, "left_anti")
    if not several.n:
        return kept.select(docs.columns)
    same = F.col(id_col).eqNullSafe(F.col(last))
    flag = f"copied_{uuid.uuid4().hex}"
    copied = sent_if_small(copied.withColumn(flag, F.lit(True)), several.n)
    # one more reading of the documents: rows of texts without copies, and of others those with the least id
    left = kept.join(copied, fp, "left").where(F.col(flag).isNull() | same)
    named = docs_.select(fp, id_col).join(copied, fp).where(same)
    repeated, twice = counted(named.groupBy(fp).count().where("count > 1").select(fp))
    if not twice.n:
        return left.select(docs.columns)
    repeated = sent_if_small(repeated, twice.n)
    one = left.join(repeated, fp, "left_semi").dropDuplicates([fp])
    return left.join(repeated, fp, "left_anti").select(docs.columns).unionByName(one.select(docs.columns))
