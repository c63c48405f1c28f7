"""Languages of texts, word by word: a linear-chain conditional random field over affixes, n-grams and lexicons."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.indexing import checkpointed, counted
from sightline.operators.partials import summed
from sightline.operators.solvers import lbfgs

from .common import ship
from .shingles import bytes_of, mixed, small_batches, word_hashes

FOLDS, HELD_OUT = 4, 2
#: Documents that the model is learnt from at most, as evenly over the languages as there are documents; languages at most.
MOST_LABELLED = 4000
MOST_LANGUAGES = 100
#: Of each of these documents so many runs of 4 to 28 words at most, spread over the whole text.
SEGMENTS = 12
SEGMENT_WORDS = (4, 28)
#: Words of more bytes aren't learnt from.
LONG_WORD = 100
#: Runs of words that training text in several languages is spliced from, and the blocks that hold it.
CHAIN = 10
BLOCKS = 16
#: Tasks that train; with more parameters than so many, their gradients are added up before they come to the driver.
TASKS, SENT_NUMBERS = 8, 1 << 18
BUCKETS = 1 << 14
GRAMS = (2, 3, 4)
LEXICON = 5000
PENALTY = 1e-5
ITERATIONS = 15
UNKNOWN = "und"

_BYTES = np.arange(256)
_IN_WORD = (((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)) | (_BYTES >= 128)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_ASCII = _IN_WORD & (_BYTES < 128)
_BEGIN, _END = 1, 2  # stand before and behind a word, so grams with them are its prefixes and suffixes


def words_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: runs of ASCII letters and of bytes beyond ASCII; edges: where texts begin or end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    starts = inside[1:-1] & (~inside[:-2] | cut[:-1])
    ends = inside[1:-1] & (~inside[2:] | cut[1:])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


@dataclass
class Words:
    """The distinct words of some texts: their grams as buckets, words one after the other, and what the lexicon says."""

    grams: np.ndarray
    bounds: np.ndarray  # where a word's grams begin, and the end
    listed: np.ndarray  # number of the language whose lexicon has the word, or the number of languages


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], n_langs: int) -> Words:
    sizes = ends - starts
    edges = np.append(0, np.cumsum(sizes + 2))
    stream = np.full(edges[-1], _BEGIN, np.uint64)
    inner = np.repeat(edges[:-1] + 1 - np.append(0, np.cumsum(sizes))[:-1], sizes) + np.arange(sizes.sum())
    stream[inner] = _LOWER[data[np.repeat(starts - np.append(0, np.cumsum(sizes))[:-1], sizes) + np.arange(sizes.sum())]]
    stream[edges[1:] - 1] = _END
    counts = [np.maximum(sizes + 3 - n, 0) for n in GRAMS]
    bounds = np.append(0, np.cumsum(np.sum(counts, axis=0)))
    grams = np.empty(bounds[-1], np.int32)
    before = bounds[:-1].copy()
    for n, own in zip(GRAMS, counts, strict=True):
        at = np.repeat(edges[:-1] - np.append(0, np.cumsum(own))[:-1], own) + np.arange(own.sum())
        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = (key << np.uint64(8)) | stream[at + k]
        grams[np.repeat(before - np.append(0, np.cumsum(own))[:-1], own) + np.arange(own.sum())] = mixed(key) % np.uint64(BUCKETS)
        before += own
    known, langs = lexicon
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        listed = np.where(known[at] == hashes, langs[at], n_langs)
    else:
        listed = np.full(len(hashes), n_langs)
    return Words(grams, bounds, listed)


@dataclass
class Chains:
    """Sequences of different lengths laid out by time: the first elements of all, longest sequence first, then the second ones."""

    rank: np.ndarray  # of each sequence, the longest 0
    place: np.ndarray  # of each element
    first: list[int]  # where a time's elements begin, and the end

    @staticmethod
    def of(bounds: np.ndarray) -> Chains:
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        at = np.bincount(sizes, minlength=2)  # sequences of each size
        running = len(sizes) - np.cumsum(at)[:-1]  # sequences with more than t elements
        first = np.append(0, np.cumsum(running))
        time = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
        return Chains(rank, first[time] + np.repeat(rank, sizes), first.tolist())


def forward_backward(logits: np.ndarray, chains: Chains, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, float, np.ndarray | None]:
    """(share of each label for each element, log of the sum over all labellings, expected moves), elements as ``chains`` lays them out."""
    top = logits.max(axis=1, keepdims=True)
    e = np.exp(logits - top)
    a = np.exp(moves).astype(e.dtype)
    forward, scale, first = np.empty_like(e), np.empty((len(e), 1), e.dtype), chains.first
    for t in range(len(first) - 1):
        now = slice(first[t], first[t + 1])
        own = e[now] if t == 0 else (forward[first[t - 1] : first[t - 1] + first[t + 1] - first[t]] @ a) * e[now]
        z = own.sum(axis=1, keepdims=True)
        scale[now] = z
        np.divide(own, z, out=forward[now])
    e /= scale
    backward = np.ones_like(e)
    seen = np.zeros(moves.shape) if pairs else None
    for t in range(len(first) - 2, 0, -1):
        now = e[first[t] : first[t + 1]] * backward[first[t] : first[t + 1]]
        then = slice(first[t - 1], first[t - 1] + len(now))
        backward[then] = now @ a.T
        if pairs:
            seen += forward[then].T @ now
    if pairs:
        seen *= a
    total = float(np.log(scale, dtype=np.float64).sum() + top.sum(dtype=np.float64))
    forward *= backward
    return forward / forward.sum(axis=1, keepdims=True), total, seen


@dataclass
class Model:
    """Languages, weights of grams and of lexicon entries (the last: in no lexicon), moves from one word's language to the next one's."""

    langs: list[str]
    weights: np.ndarray
    listed: np.ndarray
    moves: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray]

    def logits(self, words: Words) -> np.ndarray:
        """What each word by itself says for each language."""
        counts = np.diff(words.bounds)
        sums = np.add.reduceat(self.weights[words.grams], words.bounds[:-1], axis=0)  # every word has grams
        return sums / np.sqrt(counts, dtype=np.float32)[:, None] + self.listed[words.listed]

    def word_shares(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shares, bounds, starts): for each word of each text the share of each language, where a text's words begin, and their first bytes."""
        data, edges = bytes_of(texts)
        starts, ends = words_of(data, edges)
        bounds = np.searchsorted(starts, edges)
        if not len(starts):
            return np.empty((0, len(self.langs)), np.float32), bounds, starts
        hashes, first, word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        own = self.logits(features(data, starts[first], ends[first], hashes, self.lexicon, len(self.langs)))
        chains = Chains.of(bounds)
        laid = np.empty(len(word), np.int64)
        laid[chains.place] = word
        shares, _, _ = forward_backward(own[laid], chains, self.moves)
        return shares[chains.place], bounds, starts

    def languages(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Each text's language, that with the largest share of its words (ties: the first), and that share."""
        shares, bounds, _ = self.word_shares(texts)
        counts = np.diff(bounds)
        sums = np.zeros((len(texts), len(self.langs)))
        some = counts > 0
        if some.any():
            sums[some] = np.add.reduceat(shares, bounds[:-1][some], axis=0, dtype=np.float64)
        lettered = some & has_letter(texts)
        best = sums.argmax(axis=1)
        score = np.where(lettered, np.clip(sums[np.arange(len(best)), best] / np.maximum(counts, 1), 0, 1), 0.0)
        return [self.langs[b] if x else UNKNOWN for b, x in zip(best, lettered, strict=True)], score


def has_letter(texts: pa.Array) -> np.ndarray:
    data, edges = bytes_of(texts)
    sums = np.append(0, np.cumsum(_ASCII[data]))
    found = sums[edges[1:]] > sums[edges[:-1]]
    for i in np.flatnonzero(~found & (np.diff(edges) > 0)):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return found


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo the number of folds, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def segments_of(texts: pa.Array, draw: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(text, number, words): of each text runs of words at even distances, so that they are from all of it."""
    data, edges = bytes_of(texts)
    starts, ends = words_of(data, edges)
    short = ends - starts <= LONG_WORD
    starts, ends = starts[short], ends[short]
    bounds = np.searchsorted(starts, edges)
    least, most = SEGMENT_WORDS
    for i in range(len(texts)):
        a, n = int(bounds[i]), int(bounds[i + 1] - bounds[i])
        runs = min(SEGMENTS, -(-n // most))
        for k in range(runs):
            size = least + int(mixed(np.array([int(draw[i]) & (1 << 63) - 1], np.uint64) + np.uint64(k))[0] % np.uint64(most - least + 1))
            at = a + (k * max(0, n - size)) // max(1, runs - 1)
            yield i, k, " ".join(data[s:e].tobytes().decode() for s, e in zip(starts[at : min(a + n, at + size)], ends[at : min(a + n, at + size)], strict=True))


def _segments(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> tuple[DataFrame | None, list[str]]:
    """(h, y, words): bounded training text from at most ``most`` different texts, and the languages that y numbers."""
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = known.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None, []
    langs = sorted(r["lang"] for r in counts)
    quota = max(1, most // len(langs))
    number = F.create_map(*(F.lit(x) for y, lang in enumerate(langs) for x in (lang, y)))
    # a row's place among its language's rows, 1 at the quota; twice the quota is kept and cut afterwards
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], r["count"] / quota)))
    rows = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).where(F.col("text").isNotNull())
    rows = rows.withColumn("u", (F.col("h").bitwiseAND((1 << 52) - 1) / float(1 << 52)) * share[F.col("lang")]).where("u < 2").select("u", "h", number[F.col("lang")].alias("y"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = list(segments_of(batch.column("text"), batch.column("h").to_numpy()))
            at = pa.array([i for i, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "u": batch.column("u").take(at), "h": batch.column("h").take(at), "y": batch.column("y").take(at),
                "k": pa.array([k for _, k, _ in found], pa.int32()), "words": pa.array([w for _, _, w in found], pa.string()),
            })

    found = rows.mapInArrow(cut, "u double, h long, y int, k int, words string")
    # documents by u, copies of a text once, however many rows they are; a few hundred bytes a row
    found = found.dropDuplicates(["y", "h", "k"]).orderBy("u", "h", "k", "y").limit(most * SEGMENTS)
    return found.select(F.xxhash64("h", "k", "y").alias("h"), "y", "words"), langs


def _lexicon(segments: DataFrame, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words that are nearly always of one language, sorted, and that language's number; a bounded number for each."""
    words = segments.select("y", F.explode(F.split(F.translate("words", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), " ")).alias("word"))
    by = words.groupBy("word", "y").count().groupBy("word").agg(F.sum("count").alias("n"), F.max(F.struct("count", "y")).alias("best"))
    by = by.where((F.col("n") >= 3) & (F.col("best.count") >= 0.9 * F.col("n"))).select("word", "n", F.col("best.y").alias("y"))
    first = Window.partitionBy("y").orderBy(F.desc("n"), "word")
    rows = by.withColumn("k", F.row_number().over(first)).where(F.col("k") <= LEXICON).select("word", "y").collect()
    data, edges = bytes_of(pa.array([r["word"] for r in rows], pa.string()))
    hashes = word_hashes(data, edges[:-1], edges[1:]) if rows else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["y"] for r in rows], np.int64)[order]


def _training_block(rows: pa.Table, lexicon: tuple[np.ndarray, np.ndarray], n_langs: int) -> dict[str, bytes]:
    """What training needs of a block of chains of segments, as arrays of numbers."""
    rows = rows.sort_by([("chain", "ascending"), ("h", "ascending"), ("words", "ascending")])
    data, edges = bytes_of(rows.column("words").combine_chunks())
    starts, ends = words_of(data, edges)
    bounds = np.searchsorted(starts, edges)
    label = np.repeat(rows.column("y").to_numpy(), np.diff(bounds))
    chain = np.repeat(rows.column("chain").to_numpy(), np.diff(bounds))
    cuts = np.append(np.flatnonzero(np.append(True, chain[1:] != chain[:-1])[: len(chain)]), len(chain))
    hashes, first, word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    own = features(data, starts[first], ends[first], hashes, lexicon, n_langs)
    arrays = {"grams": own.grams, "bounds": own.bounds, "listed": own.listed, "word": word, "label": label, "cuts": cuts}
    return {k: np.ascontiguousarray(v, np.int64).tobytes() for k, v in arrays.items()}


def _loss(block: dict[str, np.ndarray], x: np.ndarray, n_langs: int) -> tuple[float, np.ndarray]:
    """The negative log likelihood of a block's labels and its gradient."""
    model = _unpacked(x, [""] * n_langs, (np.empty(0, np.uint64), np.empty(0, np.int64)))
    words = Words(block["grams"], block["bounds"], block["listed"])
    label, word = block["label"], block["word"]
    chains = Chains.of(block["cuts"])
    own = model.logits(words)
    laid = np.empty((len(word), n_langs))
    laid[chains.place] = own[word]
    shares, total, seen = forward_backward(laid, chains, model.moves, pairs=True)
    shares = shares[chains.place]
    inner = np.ones(len(word), bool)
    inner[block["cuts"][:-1]] = False
    then = np.flatnonzero(inner)
    gold = own[word, label].sum() + model.moves[label[then - 1], label[then]].sum()
    np.subtract.at(seen, (label[then - 1], label[then]), 1)
    shares[np.arange(len(label)), label] -= 1
    each = np.stack([np.bincount(word, shares[:, y], len(own)) for y in range(n_langs)], axis=1)
    counts = np.diff(words.bounds)
    scaled = np.repeat(each / np.sqrt(counts)[:, None], counts, axis=0)
    grams = np.stack([np.bincount(words.grams, scaled[:, y], BUCKETS) for y in range(n_langs)], axis=1)
    listed = np.stack([np.bincount(words.listed, each[:, y], n_langs + 1) for y in range(n_langs)], axis=1)
    return float(total - gold), np.concatenate([grams.ravel(), listed.ravel(), seen.ravel()])


def _unpacked(x: np.ndarray, langs: list[str], lexicon: tuple[np.ndarray, np.ndarray]) -> Model:
    n = len(langs)
    a, b = BUCKETS * n, BUCKETS * n + (n + 1) * n
    return Model(langs, x[:a].reshape(BUCKETS, n), x[a:b].reshape(n + 1, n), x[b:].reshape(n, n), lexicon)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_LABELLED, iterations: int = ITERATIONS) -> Model | None:
    """Fits the field to at most ``most`` labelled documents outside the held-out fold; None where there are none.

    Every word of a document is taken to be of the document's language. Runs of words of different documents are spliced
    to chains, so that moves between languages are learnt as well. The likelihood and its gradient are summed over blocks
    of chains by tasks; the driver holds the parameters.
    """
    ship(docs.sparkSession)
    segments, langs = _segments(docs, id_col, text_col, lang_col, most)
    if segments is None:
        return None
    segments, seen = counted(segments)
    if not seen.n:
        return None
    n_langs, lexicon = len(langs), _lexicon(segments, len(langs))
    if n_langs == 1:
        return Model(langs, np.zeros((BUCKETS, 1), np.float32), np.zeros((2, 1), np.float32), np.zeros((1, 1), np.float32), lexicon)

    def block(rows: pa.Table) -> pa.Table:
        return pa.table({k: pa.array([v], pa.binary()) for k, v in _training_block(rows, lexicon, n_langs).items()})

    names = ("grams", "bounds", "listed", "word", "label", "cuts")
    chained = segments.withColumn("chain", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(max(1, seen.n // CHAIN)).cast("long")))
    chained = chained.withColumn("block", F.col("chain") % BLOCKS)
    blocks = chained.groupBy("block").applyInArrow(block, ", ".join(f"{x} binary" for x in names))
    blocks = checkpointed(blocks.repartition(TASKS))
    tokens = blocks.agg(F.sum(F.length("label")) / 8).first()[0]

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        def part(batch: pa.RecordBatch) -> tuple[float, np.ndarray]:
            value, slope = 0.0, np.zeros(len(x))
            for row in batch.to_pylist():
                v, g = _loss({k: np.frombuffer(b, np.int64) for k, b in row.items()}, x, n_langs)
                value, slope = value + v, slope + g
            return value, slope

        few = len(x) <= SENT_NUMBERS
        value, slope = summed(blocks, part, len(x), TASKS if few else 1, TASKS)
        return value / tokens + PENALTY / 2 * float(x @ x), slope / tokens + PENALTY * x

    size = BUCKETS * n_langs + (n_langs + 1) * n_langs + n_langs * n_langs
    x, _, _ = lbfgs(objective, np.zeros(size), iterations=iterations, tolerance=1e-3)
    return _unpacked(x.astype(np.float32), langs, lexicon)


def text_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_LABELLED) -> DataFrame:
    """A row per document: the language of most of its words, learnt from the labelled documents outside the held-out fold.

    Words of whole texts are labelled by forward-backward over the chain of a text's words: what a word's prefixes,
    suffixes, inner n-grams and its place in a lexicon say, and how likely languages follow each other, so a short or
    unknown word goes with its neighbours and a passage in another language stands out. A text's score is the share of
    its words that are of the language, by their probabilities.

    Null texts and texts without any letter are ``und`` with score 0, as all are where nothing can be learnt. Rows with a
    null id are neither learnt from nor held out; repeated rows are labelled each; further columns are ignored. Documents
    aren't shuffled; what is broadcast are the model's weights (16,384 numbers a language). Of more than
    ``MOST_LANGUAGES`` languages the commonest are learnt.

    Returns: key, held_out, lang_pred, score.
    """
    model = learn(docs, id_col, text_col, lang_col, most)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 22):
            langs, score = model.languages(batch.column("text")) if model else ([UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(langs, pa.string()), pa.array(score)], ["key", "lang_pred", "score"])

    schema = T.StructType([rows.schema["key"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select("key", held_out(F.col("key")).alias("held_out"), "lang_pred", "score")
