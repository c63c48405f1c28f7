"""Spelling variants: words of a corpus one edit apart, found along sorted vocabularies, and the commoner form of each."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.indexing import checkpointed, counted, few_tasks

from .common import sent_if_small, ship
from .shingles import bytes_of, small_batches

LEAST_LETTERS = 5
LEAST_COUNT = 3
#: One run in so many loses a letter.
SPOILT = 97
#: Words that one task compares at once; a group of more is parted.
MOST_WORDS = 1 << 15
#: Distinct words that a task holds before it sends their counts.
HELD_WORDS = 1 << 19

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)
_LEAD = 0xC3  # with one byte more it writes U+00C0 to U+00FF
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)  # of one byte, from a state of 0


def letter_runs(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal runs of A-Z, a-z and U+00C0 to U+00FF begin and end in UTF-8 bytes; edges: where texts begin or end."""
    inside = np.zeros(len(data) + 2, bool)
    own = inside[1:-1]
    lead = data == _LEAD
    own[:] = _LETTER[data] | lead
    own[1:] |= lead[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    starts = own & (~inside[:-2] | cut[:-1])
    ends = own & (~inside[2:] | cut[1:])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def crc_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each run, continued from the crc32 of what stands before it; all runs a byte at a time."""
    order = np.argsort(starts - ends, kind="stable")  # longest first
    first, sizes, state = starts[order], (ends - starts)[order], before[order] ^ np.uint32(0xFFFFFFFF)
    for k in range(min(int(sizes[0]), 64) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k))  # of more than k bytes
        own = state[:n]
        state[:n] = _CRC[(own ^ data[first[:n] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for x in range(int(np.searchsorted(-sizes, -64))):
        state[x] = zlib.crc32(data[first[x] + 64 : first[x] + sizes[x]].tobytes(), int(state[x]))
    done = np.empty_like(state)
    done[order] = state
    return done


def spoilt_words(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """The lower-cased runs of all texts; where 97 divides the crc32 of ``<id>:<run>``, without the letter that it names."""
    data, edges = bytes_of(texts)
    if not len(data):
        return pa.array([], pa.large_string())
    data = _LOWER[data]
    starts, ends = letter_runs(data, edges)
    doc = np.searchsorted(edges, starts, "right") - 1
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    before = np.array([zlib.crc32(f"{x}:".encode()) for x in ids.to_pylist()], np.uint32)
    hashes = crc_of_runs(data, starts, ends, before[doc])
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    keep = np.cumsum(keep[:-1], dtype=np.int8).view(bool)
    sizes = ends - starts
    for x in np.flatnonzero((hashes % SPOILT == 0) & known[doc]):
        points = np.flatnonzero(data[starts[x] : ends[x]] & 0xC0 != 0x80)  # first bytes of code points
        at = starts[x] + points[int(hashes[x]) % len(points)]
        gone = 2 if data[at] == _LEAD else 1
        keep[at : at + gone] = False
        sizes[x] -= gone
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes()))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least five letters and their occurrences, at least ``least``, over whole texts."""
    ship(docs.sparkSession)

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in small_batches(batches, "text", 1 << 22):
            words = spoilt_words(batch.column("id"), batch.column("text"))
            found = words.filter(pc.greater_equal(pc.utf8_length(words), LEAST_LETTERS)).value_counts()
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            if sum(x.num_rows for x in held) > HELD_WORDS:
                held = [summed(held)]
                if held[0].num_rows > HELD_WORDS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()

    partial = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, one byte each (they end at U+00FF), and the offsets at which words begin."""
    data, edges = bytes_of(words)
    lead = data == _LEAD
    high = np.append(False, lead[:-1])
    kept = np.append(0, np.cumsum(~lead))
    return (data + np.where(high, 0x40, 0).astype(np.uint8))[~lead], kept[edges]


def _shared(letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each word the length of the prefix that it shares with the word before."""
    sizes = np.diff(offsets)
    shared = np.zeros(len(sizes), np.int64)
    open_ = np.arange(1, len(sizes))
    k = 0
    while len(open_):
        open_ = open_[(sizes[open_] > k) & (sizes[open_ - 1] > k)]
        open_ = open_[letters[offsets[open_] + k] == letters[offsets[open_ - 1] + k]]
        k += 1
        shared[open_] = k
    return shared


def _moves() -> np.ndarray:
    """The next row of the edit matrix for each row and each pattern of equal letters.

    A row is cut to the three cells about the diagonal and each cell to 2, "more than one edit": 27 rows. Bit k of a
    pattern says that the candidate's letter equals the word's letter at the k-th of the new row's cells.
    """
    table = np.empty((27, 8), np.uint8)
    for row in range(27):
        a, b, c = row // 9, row // 3 % 3, row % 3
        for equal in range(8):
            x = min(a + (not equal & 1), b + 1, 2)
            y = min(b + (not equal & 2), c + 1, x + 1, 2)
            z = min(c + (not equal & 4), y + 1, 2)
            table[row, equal] = 9 * x + 3 * y + z
    return table.ravel()


_MOVE = _moves()
_FIRST = 9 * 2 + 3 * 0 + 1  # before any letter: no edit on the diagonal, one beside it
_DEAD = 26


def one_edit_pairs(letters: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (a, b, shared prefix): the pairs of distinct sorted words of one group that are one edit apart.

    Each word walks along the words behind it in its group. It keeps a stack with a row of the edit matrix for each letter of the
    word that it stands at; the next word takes over the rows of the prefix that it shares with this one. Where a row has
    no cell left within one edit, all words with that prefix are skipped at once. All walks take a step at a time together.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    shared = _shared(letters, offsets)
    shared[np.flatnonzero(np.append(True, group[1:] != group[:-1]))] = -1
    shared = np.append(shared, -1)
    after = np.arange(1, n + 2)  # the next word that shares less than this one does with the word before it
    after[n] = n
    while True:
        deeper = (shared[after] >= shared) & (after < n)
        deeper &= shared > -1
        if not deeper.any():
            break
        after[deeper] = after[after[deeper]]
    room = np.append(0, np.cumsum(sizes + 3))
    stack = np.empty(room[-1], np.uint8)
    depth_of = np.arange(room[-1]) - np.repeat(room[:-1], sizes + 3)
    stack[:] = np.where(depth_of == 0, _FIRST, 9 * 1 + 3 * 0 + 1)  # a word's own prefixes
    padded = np.zeros(len(letters) + 3 * n + 3, np.uint8)  # each word between a 0 before and two after
    place = offsets[:-1] + 3 * np.arange(n) + 1
    padded[np.repeat(place - offsets[:-1], sizes) + np.arange(len(letters))] = letters
    word = np.arange(n)
    at = word + 1
    depth = shared[at]
    common = depth.copy()
    going = depth >= 0
    word, at, depth, common = word[going], at[going], depth[going], common[going]
    while len(word):
        letter = letters[offsets[at] + depth]
        own = place[word] + depth
        equal = (padded[own - 1] == letter) * np.uint8(1) + (padded[own] == letter) * np.uint8(2) + (padded[own + 1] == letter) * np.uint8(4)
        row = _MOVE[stack[room[word] + depth] * np.int64(8) + equal]
        depth = depth + 1
        dead = row == _DEAD
        stack[room[word] + np.minimum(depth, sizes[word] + 2)] = row
        ended = depth == sizes[at]
        cell = sizes[word] - sizes[at] + 1
        hit = np.flatnonzero(ended & ~dead & (cell >= 0) & (cell <= 2))
        if len(hit):
            value = row[hit] // np.array([9, 3, 1])[cell[hit]] % 3
            hit = hit[value == 1]
            if len(hit):
                yield word[hit], at[hit], common[hit]
        onward = np.flatnonzero(dead | ended)
        if len(onward):
            most = np.where(dead, depth - 1, depth)[onward]  # what the next word may share with this one
            to = at[onward] + 1
            while len(far := np.flatnonzero(shared[to] > most)):
                to[far] = after[to[far]]
            at[onward] = to
            depth[onward] = shared[to]
            common[onward] = np.minimum(common[onward], shared[to])
            if (depth < 0).any():
                going = depth >= 0
                word, at, depth, common = word[going], at[going], depth[going], common[going]


def _keyed(words: DataFrame) -> DataFrame:
    """The rows with the key of what all words of a group share: the length, the part before the edit and the part behind it."""
    return words.withColumn("key", F.xxhash64("m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.col("size") - F.col("m") + F.col("hi") + 1, F.col("m"))))


def _groups(words: DataFrame) -> DataFrame:
    """Rows (word, n, size, m, lo, hi, key): each word in every group in which it can meet a word one edit away.

    Of two such words let the shorter have m letters and the common prefix p. A group holds the words of m and m + 1
    letters that agree in their first ``lo`` letters and in the last m - ``hi``; it stands for pairs with p from ``lo``
    to below ``hi``. At first p is parted in the middle of the word.
    """
    rows = words.select("word", "n", F.length("word").alias("size"))
    rows = rows.withColumn("m", F.explode(F.when(F.col("size") > LEAST_LETTERS, F.array(F.col("size") - 1, F.col("size"))).otherwise(F.array("size"))))
    middle = F.floor(F.col("m") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), (F.col("m") + 1).alias("hi")))
    return _keyed(rows.withColumn("part", F.explode(halves)).select("word", "n", "size", "m", "part.lo", "part.hi"))


def _parted(rows: DataFrame) -> DataFrame:
    """The rows of groups that are too large, in the groups of both halves of their places of the edit."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return _keyed(rows.withColumn("part", F.explode(halves)).select("word", "n", "size", "m", "part.lo", "part.hi"))


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """Partial rows (word, n_near, best_n, best): of each word and group, how many words are one edit away and the commonest.

    Every pair is found in exactly one group: that of the shorter word's length and of the place of the edit. Groups of
    more than ``most`` words (a prefix that a large share of all words have) are parted by the place of the edit until
    they aren't too large; words that agree in all but one place are a hundred or so at most.
    """
    groups, done = _groups(words), []
    while True:
        hot, seen = counted(groups.groupBy("key").count().where((F.col("count") > most)).select("key"))
        if not seen.n:
            done.append(groups)
            break
        # a group of one place isn't parted further
        large = groups.join(sent_if_small(hot, seen.n), "key", "left_semi").where("hi - lo > 1")
        done.append(groups.join(sent_if_small(hot, seen.n), "key", "left_anti"))
        done.append(groups.join(sent_if_small(hot, seen.n), "key", "left_semi").where("hi - lo <= 1"))
        groups = checkpointed(_parted(large))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        ids = np.column_stack([rows.column(c).to_numpy() for c in ("key", "m", "lo", "hi")])
        group = np.append(0, np.cumsum((ids[1:] != ids[:-1]).any(axis=1)))
        words = rows.column("word").combine_chunks()
        letters, offsets = letters_of(words)
        sizes, counts = np.diff(offsets), rows.column("n").to_numpy()
        m, lo, hi = ids[:, 1], ids[:, 2], ids[:, 3]
        near, best = np.zeros(len(sizes), np.int64), np.full(len(sizes), -1)
        for a, b, common in one_edit_pairs(letters, offsets, group):
            own = (np.minimum(sizes[a], sizes[b]) == m[a]) & (common >= lo[a]) & (common < hi[a])
            x, y = np.concatenate([a[own], b[own]]), np.concatenate([b[own], a[own]])
            np.add.at(near, x, 1)
            # the commonest of these, and of equal ones the first in sorted order
            order = np.lexsort((y, -counts[y], x))
            x, y = x[order], y[order]
            lead = np.append(True, x[1:] != x[:-1])[: len(x)]
            x, y = x[lead], y[lead]
            old = best[x]
            better = (old < 0) | (counts[y] > counts[old]) | ((counts[y] == counts[old]) & (y < old))
            best[x[better]] = y[better]
        some = np.flatnonzero(near)
        if not len(some):
            return None
        return pa.RecordBatch.from_pydict({"word": words.take(pa.array(some)).cast(pa.string()), "n_near": near[some], "best_n": counts[best[some]], "best": words.take(pa.array(best[some])).cast(pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            held.append(batch)
            # whole keys only: what has the last key waits for the next batch
            if sum(x.num_rows for x in held) > MOST_WORDS and (keys[0] != keys[-1] or last is not None and last != keys[0]):
                rows = pa.Table.from_batches(held)
                cut = rows.num_rows - int((keys == keys[-1]).sum())
                if (found := compare(rows.slice(0, cut))) is not None:
                    yield found
                held = rows.slice(cut).combine_chunks().to_batches()
            last = keys[-1]
        if held and (found := compare(pa.Table.from_batches(held))) is not None:
            yield found

    dealt = every.repartition("key").sortWithinPartitions("key", "m", "lo", "hi", "word")
    return dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``form`` ends for each row (word, form); no word may lead back to itself.

    Each round every word's pointer becomes that of the word it points at, so rounds grow with the logarithm of the
    longest chain.
    """
    chains, seen = counted(forms.select("word", F.col("form").alias("to")))
    while seen.n:
        chains = few_tasks(chains, seen.n)
        onward = sent_if_small(chains.select(F.col("word").alias("to"), F.col("to").alias("further")), seen.n)
        stepped, seen = counted(chains.join(onward, "to", "left").select("word", F.coalesce("further", "to").alias("to"), "further"), open=F.count("further"))
        chains = stepped.drop("further")
        if not seen.open:
            break
    return chains.withColumnRenamed("to", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """A row per word of the corpus: its commoner form one edit away, and the root to which such forms lead.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased; a run whose ``<id>:<run>``
    has a crc32 that 97 divides loses the code point at crc32 % length. Those of at least five code points that occur
    three times are compared: near are words that differ by one code point inserted, deleted or replaced. A word's form
    is its commonest near word (ties: the smallest) if that is at least twice as common, so chains of forms end.

    Texts are counted in tasks, words meet in groups by a shared half (see ``near_words``), in which a walk along the
    sorted words finds the near ones; partial results have a row per word and group, pairs aren't shuffled. Null and
    empty texts have no words, rows with a null id lose no letters, repeated rows count each, further columns are ignored.

    Returns: word, n, n_near, form, form_n, root.
    """
    words, _ = counted(vocabulary(docs, id_col, text_col))
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    every = near_words(words, most).select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("best"))
    every = every.unionByName(words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(every.schema["best"].dataType).alias("best")))
    every = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    better = -F.col("best.less") >= 2 * F.col("n")
    found, seen = counted(every.select("word", "n", "n_near", F.when(better, F.col("best.word")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n")), led=F.count("form"))
    ends = roots(few_tasks(found.where("form is not null").select("word", "form"), seen.led or 0))
    return found.join(sent_if_small(ends, seen.led or 0), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
