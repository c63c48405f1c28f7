"""Token sequences of one length from documents of many, with as little padding as can be."""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.indexing import checkpointed, running_totals

from .common import ship
from .shingles import bytes_of, small_batches, word_bounds, word_hashes

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096
#: Words whose ids a Python worker keeps (about 40 bytes each); at that number it starts anew.
KEPT_WORDS = 600_000

_B = np.arange(256)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
_SIGN = (_B >= 33) & (_B <= 126) & ~_LETTER & (_B != 39)  # digits too; not the apostrophe, which contractions take along
_LATIN = (_B >= 0x80) & (_B <= 0xBF) & (_B != 0x97) & (_B != 0xB7)  # after 0xC3


def cuts(data: np.ndarray) -> np.ndarray:
    """Before which bytes a letter meets a sign or digit, or the other way round: pre-tokens never span such a place."""
    letter, sign = _LETTER[data], _SIGN[data]
    ends_letter = letter.copy()
    ends_letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
    out = np.zeros(len(data), bool)
    out[1:] = (ends_letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    return out


#: Words that normalisation and pre-tokenisation leave whole, but for lower case.
PLAIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
#: Ranks of single bytes, of a byte that ends a word, then of the vocabulary's merges in order.
LAST_BYTE, FIRST_MERGE = 256, 512


def byte_of_symbol() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, the rest from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in printable]
    return {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(rest)}


def comes_whole(text: str, end: str, pairs: dict[tuple[str, str], int]) -> bool:
    """Whether merging the characters, pair of least rank first, leaves one symbol."""
    parts = [*text[:-1], text[-1] + end]
    while len(parts) > 1:
        ranks = [pairs.get(x, len(pairs)) for x in zip(parts, parts[1:])]
        k = ranks.index(min(ranks))
        if ranks[k] == len(pairs):
            return False
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return True


def merge_ranks(encoder):
    """The same vocabulary by rank of merge, which encodes a plain word many times faster, with NUL for the end of a word.

    Merging by the rank of the result equals merging by the rank of the pair wherever each result, encoded alone, comes
    out whole; a merge of which that isn't so is never made in any word and is left out.
    """
    import tiktoken

    byte, model = byte_of_symbol(), json.loads(encoder.to_str())["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    ranks = {bytes([x]): x for x in range(256)} | {bytes([x, 0]): LAST_BYTE + x for x in range(1, 256)}
    symbol = {bytes([x]): s for s, x in byte.items()}
    ids = np.zeros(FIRST_MERGE + len(model["merges"]), np.uint32)
    last = np.zeros(len(ids), bool)
    for x in range(1, 256):
        ids[x], ids[LAST_BYTE + x] = vocab[symbol[bytes([x])]], vocab[symbol[bytes([x])] + end]
        last[LAST_BYTE + x] = True
    pairs = {tuple(x.split(" ") if isinstance(x, str) else x): k for k, x in enumerate(model["merges"])}
    for pair, k in pairs.items():
        whole = "".join(pair)
        text = whole.removesuffix(end)
        ended = text != whole
        data = bytes(byte[x] for x in text) + b"\0" * ended
        if 0 in data[:-1] or not ended and 0 in data:
            continue
        if not comes_whole(text, end if ended else "", pairs):
            continue
        ranks.setdefault(data, FIRST_MERGE + k)
        ids[FIRST_MERGE + k], last[FIRST_MERGE + k] = vocab[whole], ended
    return tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={}), ids, last


class WordTokenizer:
    """Ids of whole texts from ids of their words.

    The vocabulary's normalisation doesn't reach over white space or an ASCII sign, and its pre-tokens end between a
    letter and a sign, so a text's ids are those of its parts one after the other. Parts are looked up by the hash of
    their bytes with A-Z lower-cased (the vocabulary has lower case only); each new one is encoded once.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.encoder.encode_special_tokens = True
        self.merges, self.id_of, self.is_last = merge_ranks(self.encoder)
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # hashes in order, and the number of each
        self.number = np.empty(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.flat = np.empty(0, np.uint32)  # ids of word 0, 1, ...

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, hashes)
        safe = np.minimum(at, max(0, len(self.known) - 1))
        return at, (self.known[safe] == hashes) if len(self.known) else np.zeros(len(hashes), bool)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds words; their hashes are in order and none is known."""
        plain = np.array([bool(PLAIN.fullmatch(x)) for x in words])
        tokens = self.merges.encode_to_numpy("".join(x.lower() + "\0" for x, p in zip(words, plain, strict=True) if p), disallowed_special=())
        others = [x.ids for x in self.encoder.encode_batch_fast([x for x, p in zip(words, plain, strict=True) if not p], add_special_tokens=False)]
        sizes = np.concatenate([np.diff(np.append(-1, np.flatnonzero(self.is_last[tokens]))), [len(x) for x in others]]).astype(np.int64)
        hashes = np.concatenate([hashes[plain], hashes[~plain]])
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, at, hashes[order])
        self.number = np.insert(self.number, at, order + len(self.first) - 1)
        self.first = np.append(self.first, self.first[-1] + np.cumsum(sizes))
        self.flat = np.concatenate([self.flat, self.id_of[tokens], *(np.array(x, np.uint32) for x in others)])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        data, edges = bytes_of(texts)
        starts, ends = word_bounds(data, edges, cuts(data))
        unique, where, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KEPT_WORDS:
            self.forget()
        _, known = self.look_up(unique)
        if not known.all():
            new = where[~known]
            self.learn(unique[~known], [data[a:b].tobytes().decode() for a, b in zip(starts[new], ends[new], strict=True)])
        at, _ = self.look_up(unique)
        no = self.number[at][back]
        sizes = self.first[no + 1] - self.first[no]
        out = []
        for a in range(0, len(no), 1 << 16):
            part, n = self.first[no[a : a + (1 << 16)]], sizes[a : a + (1 << 16)]
            stop = np.cumsum(n)
            out.append(self.flat[np.repeat(part - (stop - n), n) + np.arange(stop[-1])])
        ids = np.concatenate([*out, np.empty(0, np.uint32)])
        bounds = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def tokenizer(name: str) -> WordTokenizer:
    """One for each Python worker, kept between its tasks."""
    kept = sys.modules[__name__].__dict__.setdefault("_tokenizers", {})
    if name not in kept:
        kept[name] = WordTokenizer(name)
    return kept[name]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = TOKENIZER) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity``: key, piece, start, length, ids_crc32."""
    narrow = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode
        for batch in small_batches(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    at.append(i), piece.append(k), start.append(a), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            if at:
                yield pa.RecordBatch.from_pydict({"key": batch.column("key").take(pa.array(at)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return narrow.mapInArrow(cut, f"key {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Which lengths share a sequence, and how many such sequences: [(lengths, number)].

    From the longest length down, the gap that it leaves is looked up among single lengths, then sums of two, then of
    three, of lengths that are still there; a hit is used as often as its lengths allow. What no combination completes
    exactly is packed best-fit, longest first, into the fullest sequence that has room.

    Works on the number of pieces of each length, so its cost is bounded by the capacity, not the corpus.
    """
    have = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        have[n] = k
    made: list[tuple[tuple[int, ...], int]] = []
    rest: dict[int, int] = {}

    def times(lengths: tuple[int, ...]) -> int:
        return min(int(have[n]) // lengths.count(n) for n in set(lengths))

    def pair(total: int) -> tuple[int, int] | None:
        """The most unequal two lengths with this sum."""
        if total < 2:
            return None
        a = np.arange((total + 1) // 2, min(total, capacity + 1))
        hits = a[(have[a] > 0) & (have[total - a] > 0)]
        for x in hits[::-1]:
            if times((int(x), total - int(x))):
                return int(x), total - int(x)
        return None

    sums: np.ndarray | None = None

    def two_sums() -> np.ndarray:
        """Which sums two lengths have; kept until a length runs out. It may name more than there are, never fewer."""
        nonlocal sums
        if sums is None:
            here = (have > 0).astype(float)
            size = 1 << (2 * capacity + 1).bit_length()
            sums = np.fft.irfft(np.fft.rfft(here, size) ** 2, size)[: capacity + 1] > 0.5
        return sums

    def complement(n: int) -> tuple[int, ...] | None:
        gap = capacity - n
        if gap == 0:
            return ()
        have[n] -= 1
        try:
            if have[gap] > 0:
                return (gap,)
            if two_sums()[gap] and (two := pair(gap)):
                return two
            a = np.arange(gap - 1, 1, -1)
            for x in a[(have[a] > 0) & two_sums()[gap - a]]:
                have[x] -= 1
                two = pair(gap - int(x))
                have[x] += 1
                if two:
                    return (int(x), *two)
        finally:
            have[n] += 1
        return None

    for n in range(capacity, 0, -1):
        while have[n]:
            more = complement(n)
            if more is None:
                rest[n], have[n] = int(have[n]), 0
                sums = None
                break
            lengths = (n, *more)
            k = times(lengths)
            for x in lengths:
                have[x] -= k
            if any(have[x] == 0 for x in lengths):
                sums = None
            made.append((lengths, k))
    return made + best_fit(rest, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over numbers of equal lengths."""
    room: dict[int, list[list]] = defaultdict(list)  # by room left: [lengths, number]
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            fits = min((r for r in room if r >= n and room[r]), default=None)
            if fits is None:
                each = capacity // n
                for k, number in ((each, left // each), (left % each, 1)):
                    if k and number:
                        room[capacity - k * n].append([(n,) * k, number])
                break
            lengths, number = room[fits].pop()
            if not room[fits]:
                del room[fits]
            k = min(number, left)
            if number > k:
                room[fits].append([lengths, number - k])
            room[fits - n].append([(*lengths, n), k])
            left -= k
    return [(tuple(x), k) for same in room.values() for x, k in same]


def placement(patterns: list[tuple[tuple[int, ...], int]], counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of pieces, ordered by length: where each run starts, the sequence of its first piece, the offset there."""
    at, total = {}, 0
    for n in sorted(counts):
        at[n] = total
        total += counts[n]
    runs, sequence = [], 0
    for lengths, k in patterns:
        offset = 0
        for n in lengths:
            runs.append((at[n], sequence, offset))
            at[n] += k
            offset += n
        sequence += k
    starts, sequences, offsets = np.array(sorted(runs), np.int64).reshape(-1, 3).T
    return starts, sequences, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = TOKENIZER) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens; only longer documents are cut.

    Tasks tokenise whole texts and keep each piece's length and checksum. The number of pieces of each length, a row
    per length and so at most ``capacity`` rows, is all that the driver sees; ``plan`` turns it into patterns. Pieces
    get their position in the order of lengths by global prefix sums, and a position falls into a run of the plan,
    which gives its sequence and offset. Equal lengths, whatever their share, are dealt over many tasks.

    A null text is an empty one, whose only token is the end id. Repeated rows are packed each. No rows: no rows.
    Further columns are ignored.

    Returns: key (the id), piece, start, length, ids_crc32, sequence_id, offset.
    """
    ship(docs.sparkSession)
    found = checkpointed(pieces(docs, id_col, text_col, capacity, vocabulary))
    counts = {int(r["length"]): r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    starts, sequences, offsets = placement(plan(counts, capacity), counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row_no").to_numpy()
            run = np.searchsorted(starts, row, "right") - 1
            columns = {x: batch.column(x) for x in ("key", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequences[run] + row - starts[run]), "offset": pa.array(offsets[run])})

    ordered = running_totals(found, ["length", "key", "piece"])
    kind = found.schema["key"].dataType.simpleString()
    return ordered.mapInArrow(place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
