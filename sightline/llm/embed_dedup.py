"""Near-duplicate vectors by product quantisation: inverted lists, table-lookup distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.indexing import checkpointed, counted, few_tasks

from .common import sent_if_small, ship
from .graph import parents, spanning

COSINE = 0.95
#: Distinct vectors that the coarse cells and the codebooks are fitted on at most: those with the least fingerprints.
SAMPLE = 131_072
#: Numbers that the sample holds at most, 256 MB; long vectors are fewer.
SAMPLE_NUMBERS = 1 << 25
#: A length with no more distinct vectors and numbers than these is indexed and searched in one task.
SMALL, SMALL_NUMBERS = 1_024, 1 << 23
#: Cells at most, vectors of the sample that a cell is fitted on at least, and distinct vectors that it should hold.
MOST_CELLS, FITTED_ON, CELL_SIZE = 16_384, 8, 512
PARTS, CODES = 8, 256
#: A vector is searched in every cell whose border lies within this share of the search radius. Of two vectors no farther
#: apart than the radius, in different cells, one lies within half of it from the border between the two: the line
#: between them crosses that border. So at 0.5 each link is found from one side at least; no link is lost.
REACH = 0.5
#: Vectors of a cell that one task compares with as many others.
BLOCK = 2_048
#: Searches that are looked up at once; small enough that the tables of distances stay in a core's cache.
SEARCHES = 256
#: Numbers of candidates that are multiplied at once, 32 MB of them.
PRODUCTS = 1 << 22
VECTORS_PER_TASK = 1 << 13


def radius(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def usable(column: pa.Array) -> list[np.ndarray | None]:
    found: list[np.ndarray | None] = []
    for x in column:
        v = None if not x.is_valid or x.values.null_count or not len(x.values) else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        found.append(None if v is None or not np.isfinite(v).all() or not v.any() else v + 0.0)  # -0.0 is 0.0
    return found


def packed(v: np.ndarray) -> bytes:
    """As single-precision numbers where these are the same."""
    with np.errstate(over="ignore"):
        half = v.astype(np.float32)
    return half.tobytes() if (half == v).all() else v.tobytes()


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = usable(batch.column("vector"))
        yield pa.RecordBatch.from_pydict({
            "key": batch.column("key"), "fp": pa.array([None if x is None else xxhash.xxh3_128_hexdigest(x.tobytes()) for x in vectors], pa.string()),
            "size": pa.array([0 if x is None else len(x) for x in vectors], pa.int32()), "raw": pa.array([None if x is None else packed(x) for x in vectors], pa.binary()),
        })


def matrix(column: pa.Array | list[bytes], size: int) -> np.ndarray:
    """Packed vectors of one length, scaled to length 1, as rows of doubles."""
    rows = [x.as_buffer() for x in column] if isinstance(column, pa.Array) else column
    x = np.empty((len(rows), size))
    for kind in (np.float32, np.float64):
        mine = [i for i, row in enumerate(rows) if len(row) == size * kind().itemsize]
        if mine:
            x[mine] = np.frombuffer(b"".join(rows[i] for i in mine), kind).reshape(len(mine), size)
    if len(rows):
        x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means over a sample."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nested_means(x: np.ndarray, k: int) -> np.ndarray:
    """About ``k`` centres; many of them are fitted in groups, so that time doesn't grow with rows times centres."""
    if k <= 512:
        return means(x, k)
    groups = means(x, int(np.sqrt(k)))
    own = nearest(x, groups)
    return np.concatenate([means(x[own == g], max(1, round(k * n / len(x)))) for g, n in enumerate(np.bincount(own, minlength=len(groups))) if n])


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T)


def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true in a matrix in which little is."""
    return np.divmod(np.flatnonzero(x), x.shape[1])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[a : a + 1024], centres).argmin(1) for a in range(0, len(x), 1024)]) if len(x) else np.empty(0, int)


class Quantiser:
    """Coarse cells, and codebooks of the residuals in each of ``PARTS`` subspaces."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cells = nested_means(sample, cells)
        self.cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        few = sample[: 64 * CODES]
        rest = few - self.cells[nearest(few, self.cells)]
        self.books = [means(rest[:, a:b], CODES) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.tables = [(np.float32(-2) * b.astype(np.float32), (b**2).sum(1).astype(np.float32)[:, None]) for b in self.books]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def codes(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector is from what its codes say."""
        rest = self.parts(x - self.cells[cell])
        codes = np.column_stack([nearest(r, b) for r, b in zip(rest, self.books, strict=True)]).astype(np.uint8)
        error = np.sqrt(sum(((r - b[c]) ** 2).sum(1) for r, b, c in zip(rest, self.books, codes.T, strict=True)))
        return codes, error

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared, a row per coded vector: queries are exact, vectors as coded; a table of part distances per query, then lookups."""
        rest = queries - self.cells[cell]
        total = np.repeat((rest**2).sum(1).astype(np.float32)[None], len(codes), axis=0)
        found = np.empty_like(total)
        for r, (book, norms), c in zip(self.parts(rest.astype(np.float32)), self.tables, codes.T, strict=True):
            total += np.take(book @ r.T + norms, c, axis=0, out=found, mode="clip")  # codes are in range; this mode needs no buffer
        return total

    def borders(self, x: np.ndarray, home: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How far each vector lies from the border between its home cell and another; at home 0."""
        own, other = self.cells[home], self.cells[cell]
        far = ((x - other) ** 2).sum(1) - ((x - own) ** 2).sum(1)
        return far / (2 * np.maximum(np.sqrt(((own - other) ** 2).sum(1)), 1e-12))

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells, and (row, cell) of every cell whose border with the home cell is at most ``reach`` away."""
        far = squares(x, self.cells)
        home = far.argmin(1)
        # nothing that is farther off than this can be within reach, as no two cells are farther apart than their distances to x
        least = far[np.arange(len(x)), home]
        row, cell = places(far <= (np.sqrt(least) + 2 * reach)[:, None] ** 2 + 1e-9)
        inside = self.borders(x[row], home[row], cell) <= reach
        return home, row[inside], cell[inside]


def compare(index: Quantiser, cell: int, queries: np.ndarray, vectors: np.ndarray, codes: np.ndarray, error: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of one cell with the least cosine or more: candidates by lookup, decided exactly."""
    most = ((radius(cosine) + error) ** 2 + 1e-5).astype(np.float32)  # single precision costs less than that
    near = places(index.distances(queries, cell, codes) <= most[:, None])
    step = max(1, PRODUCTS // vectors.shape[1])
    keep = [np.einsum("ij,ij->i", vectors[near[0][a : a + step]], queries[near[1][a : a + step]]) >= cosine for a in range(0, len(near[0]), step)]
    keep = np.concatenate([*keep, np.empty(0, bool)])
    return near[1][keep], near[0][keep]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, reach: float = REACH, cell_size: int = CELL_SIZE, small: int = SMALL) -> DataFrame:
    """Links of vectors with a cosine of at least ``cosine``, found through a product-quantised inverted index.

    1. Equal vectors are one class with a number of copies.
    2. Vectors link with those of their own length. For each length, cells and codebooks are fitted on at most ``SAMPLE``
       classes (one cell, and so no loss, where there are few; a task then fits, codes and searches the length). Every class is put into its nearest cell as codes of
       its residual, with the distance that coding costs it.
    3. Every class is searched in its own cell and in those whose border is within reach. Looked-up distances are bounded
       by what coding cost, so within a probed cell no link is lost; candidates are decided by the exact cosine in doubles.
       A link found from one side only, as the other's reach ends before, is counted for both.
    4. A cell's vectors and searches are dealt in blocks of about ``BLOCK``, so a cell that holds a third of all vectors is
       shared by many tasks. A block pair returns link counts and a spanning forest of its links, never all pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Null ids are kept; rows that
    repeat an id are vectors of their own. Further columns are ignored.

    Returns: key (the id), n_links (other vectors linked directly), component (least id of the component).
    """
    spark = vectors.sparkSession
    ship(spark)
    narrow = vectors.select(F.col(id_col).alias("key"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = narrow.schema["key"].dataType.simpleString()
    rows, all_rows = counted(narrow.mapInArrow(_prepared, f"key {kind}, fp string, size int, raw binary"))
    classes = rows.where("fp is not null").groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("raw").alias("raw"))
    classes = few_tasks(checkpointed(classes.withColumn("no", F.monotonically_increasing_id())), all_rows.n, VECTORS_PER_TASK)
    lengths = checkpointed(classes.groupBy("size").agg(F.count("*").alias("classes")).where("classes > 1"))
    alone = (F.col("classes") <= small) & (F.col("classes") * F.col("size") <= SMALL_NUMBERS)
    # any number of lengths with few vectors in one job, a task for each; the others' lengths are a row each
    few, seen = counted(lengths.where(alone).select("size"))
    links = checkpointed(_small_links(classes.join(sent_if_small(few, seen.n), "size", "left_semi"), cosine)) if seen.n else None
    for r in lengths.where(~alone).orderBy("size").collect():
        alike = classes.where(F.col("size") == r["size"])
        most = max(CODES, min(SAMPLE, SAMPLE_NUMBERS // r["size"]))
        sample = matrix([bytes(x["raw"]) for x in alike.orderBy("fp").limit(most).select("raw").collect()], r["size"])
        index = spark.sparkContext.broadcast(Quantiser(sample, max(1, min(MOST_CELLS, len(sample) // FITTED_ON, r["classes"] // cell_size))))
        found = checkpointed(_links(alike, index, cosine, reach))
        links = found if links is None else links.union(found)

    numbered = classes.select("fp", "no", "least", "copies")
    if links is not None:
        edges = links.where("other is not null").select(F.col("no").alias("a"), F.col("other").alias("b"))
        counts = links.groupBy("no").agg(F.sum("n").alias("n"))
        roots = parents(edges).select(F.col("node").alias("no"), F.col("component").alias("root"))
        numbered = few_tasks(numbered.join(counts, "no", "left").join(roots, "no", "left"), all_rows.n)
    else:
        numbered = numbered.withColumns({"n": F.lit(0).cast("long"), "root": F.lit(None).cast("long")})
    numbered = checkpointed(numbered.withColumns({"root": F.coalesce("root", "no"), "n_links": F.coalesce("n", F.lit(0)) + F.col("copies") - 1}))
    least = checkpointed(few_tasks(numbered.groupBy("root").agg(F.min("least").alias("component")), all_rows.n))
    by_class = checkpointed(few_tasks(numbered.join(least, "root"), all_rows.n).select("fp", "n_links", "component"))
    found = few_tasks(rows.select("key", "fp"), all_rows.n).join(by_class, "fp", "left")
    return found.select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "key").alias("component"))


def _small_links(alike: DataFrame, cosine: float) -> DataFrame:
    """Rows (no, n, other) as ``_links`` gives them, of lengths with few classes: one cell each, all in one task."""

    def search(rows: pa.Table) -> pa.Table:
        x = matrix(rows["raw"].to_pylist(), rows["size"][0].as_py())
        no, copies = rows["no"].to_numpy(), rows["copies"].to_numpy()
        q = Quantiser(x, 1)
        codes, error = q.codes(x, np.zeros(len(x), np.int64))
        links, forest = np.zeros(len(x), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for a in range(0, len(x), SEARCHES):
            i, j = compare(q, 0, x[a : a + SEARCHES], x, codes, error, cosine)
            i, j = i[i + a != j] + a, j[i + a != j]
            links += np.bincount(i, copies[j], len(x)).astype(np.int64)
            forest.append(spanning(no[i], no[j]))
        u, v = spanning(*(np.concatenate(ends) for ends in zip(*forest, strict=True)))
        i = np.flatnonzero(links)
        none = np.zeros(len(i), np.int64)
        return pa.table({"no": np.concatenate([no[i], u]), "n": np.concatenate([links[i], np.zeros(len(u), np.int64)]), "other": pa.array(np.concatenate([none, v]), mask=np.arange(len(i) + len(v)) < len(i))})

    return alike.select("size", "no", "copies", "raw").groupBy("size").applyInArrow(search, "no long, n long, other long")


def _links(alike: DataFrame, index, cosine: float, reach: float) -> DataFrame:
    """Rows (no, n, other): links of a class found in one block pair, weighted by copies; forest edges to ``other``."""
    within = reach * radius(cosine) + 1e-9
    width = index.value.cells.shape[1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = index.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = matrix(part.column("raw"), width)
                home, row, cell = q.probes(x, within)
                codes, error = q.codes(x, home)
                at = pa.array(np.concatenate([np.arange(len(x)), row]))
                stored = np.concatenate([np.ones(len(x), bool), np.zeros(len(row), bool)])
                pad = [None] * len(row)
                yield pa.RecordBatch.from_pydict({
                    "cell": pa.array(np.concatenate([home, cell]), pa.int32()), "home": pa.array(np.concatenate([home, home[row]]), pa.int32()), "stored": pa.array(stored), "no": part.column("no").take(at), "copies": part.column("copies").take(at),
                    "raw": part.column("raw").take(at), "codes": pa.array([*map(bytes, codes), *pad], pa.binary()), "error": pa.array([*error, *pad], pa.float64()),
                })

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = index.value
        total = np.zeros((2, len(q.cells)), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                home, _, cell = q.probes(matrix(batch.column("raw").slice(a, 512), width), within)
                total += [np.bincount(x, minlength=len(q.cells)) for x in (home, cell)]
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "stores": total[0, at], "searches": total[1, at]})

    entries = alike.select("no", "copies", "raw").mapInArrow(coded, "cell int, home int, stored boolean, no long, copies long, raw binary, codes binary, error double")
    # a row per cell, and so at most MOST_CELLS
    counts = alike.select("raw").mapInArrow(tallied, "cell int, stores long, searches long").groupBy("cell").agg(F.sum("stores").alias("stores"), F.sum("searches").alias("searches"))
    blocks = counts.where("stores > 0").select("cell", *(F.ceil(F.col(x) / BLOCK).cast("int").alias(x) for x in ("stores", "searches")))
    dealt = entries.join(F.broadcast(blocks), "cell")
    own = F.pmod(F.xxhash64("no"), F.when(F.col("stored"), F.col("stores")).otherwise(F.col("searches"))).cast("int")
    met = F.sequence(F.lit(0), F.when(F.col("stored"), F.col("searches")).otherwise(F.col("stores")) - 1)
    dealt = dealt.withColumn("own", own).withColumn("met", F.explode(met))
    dealt = dealt.withColumn("store", F.when(F.col("stored"), F.col("own")).otherwise(F.col("met"))).withColumn("search", F.when(F.col("stored"), F.col("met")).otherwise(F.col("own")))
    dealt = dealt.drop("stores", "searches", "own", "met")

    def pairs(block: pa.Table) -> pa.Table:
        held, asked = block.filter(block["stored"]).combine_chunks(), block.filter(pc.invert(block["stored"])).combine_chunks()
        empty = pa.table({"no": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if not held.num_rows or not asked.num_rows:
            return empty
        q, cell = index.value, block["cell"][0].as_py()
        codes = np.frombuffer(b"".join(held["codes"].to_pylist()), np.uint8).reshape(held.num_rows, -1)
        x, y = matrix(asked["raw"].to_pylist(), width), matrix(held["raw"].to_pylist(), width)
        asked_no, held_no, error = asked["no"].to_numpy(), held["no"].to_numpy(), held["error"].to_numpy()
        asked_copies, held_copies, home = asked["copies"].to_numpy(), held["copies"].to_numpy(), asked["home"].to_numpy()
        links, linked, forest = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        unseen: dict[int, np.ndarray] = {}  # by another cell, which of the vectors held here don't look into it
        for a in range(0, len(x), SEARCHES):
            i, j = compare(q, cell, x[a : a + SEARCHES], y, codes, error, cosine)
            i += a
            i, j = i[asked_no[i] != held_no[j]], j[asked_no[i] != held_no[j]]
            links += np.bincount(i, held_copies[j], len(x)).astype(np.int64)
            of = home[i]
            for h in np.unique(of[of != cell]).tolist():
                if h not in unseen:
                    unseen[h] = q.borders(y, np.full(len(y), cell), np.full(len(y), h)) > within
                own = np.flatnonzero(of == h)
                own = own[unseen[h][j[own]]]
                linked += np.bincount(j[own], asked_copies[i[own]], len(y)).astype(np.int64)
            forest.append(spanning(asked_no[i], held_no[j]))
        u, v = spanning(*(np.concatenate(ends) for ends in zip(*forest, strict=True)))
        i, j = np.flatnonzero(links), np.flatnonzero(linked)
        none = np.zeros(len(i) + len(j), np.int64)
        return pa.table({"no": np.concatenate([asked_no[i], held_no[j], u]), "n": np.concatenate([links[i], linked[j], np.zeros(len(u), np.int64)]), "other": pa.array(np.concatenate([none, v]), mask=np.arange(len(none) + len(v)) < len(none))})

    return dealt.groupBy("cell", "store", "search").applyInArrow(pairs, "no long, n long, other long")
