"""Hashed word shingles of whole texts, computed for a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5
LONG_WORD = 4096
STEP = 1 << 16

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_VALUE = mixed((_LOWER + 1).astype(U) * U(0x9E3779B97F4A7C15))
_IS_WORD = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
_BASE = 0xD6E8FEB86659FD93
_POWERS = np.cumprod(np.full(STEP + LONG_WORD, _BASE, U))
_INVERSE = np.cumprod(np.full(STEP + LONG_WORD, pow(_BASE, -1, 1 << 64), U))
_PLACE = mixed(np.arange(1, WORDS + 1, dtype=U)) | U(1)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other (null: none), and the offsets at which texts begin or end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, buffer = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.empty(0, np.uint8), offsets - offsets[0]


def word_bounds(data: np.ndarray, edges: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; edges: where texts begin or end; cuts: bytes before which a word is parted."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    inner = edges[(edges > 0) & (edges < len(data))]
    starts[inner] |= inside[1:-1][inner]
    ends[inner - 1] |= inside[1:-1][inner - 1]
    if cuts is not None:
        starts |= cuts
        ends[:-1] |= cuts[1:]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U)
    sizes = ends - starts
    a = 0
    while a < len(starts):
        if sizes[a] > LONG_WORD:
            out[a] = xxhash.xxh64_intdigest(_LOWER[data[starts[a] : ends[a]]].astype(np.uint8).tobytes())
            a += 1
            continue
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + STEP)))
        if (long := np.flatnonzero(sizes[a:b] > LONG_WORD)).size:
            b = a + int(long[0])
        part = data[starts[a] : ends[b - 1]]
        sums = np.zeros(len(part) + 1, U)  # of the values so far, each times the power of its place
        np.cumsum(_VALUE[part] * _POWERS[: len(part)], out=sums[1:])
        first, last = starts[a:b] - starts[a], ends[a:b] - starts[a]
        out[a:b] = mixed((sums[last] - sums[first]) * _INVERSE[first] + sizes[a:b].astype(U))
        a = b
    return out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of five words.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. With fewer words the whole sequence is one
    shingle; null texts and texts without words have none. Text offsets, not copies, part the texts of a batch.
    """
    if not len(texts):
        return []
    data, edges = bytes_of(texts)
    starts, ends = word_bounds(data, edges)
    words = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, edges)
    n = len(words)
    runs = np.zeros(max(0, n - WORDS + 1), U)
    for k in range(WORDS if len(runs) else 0):
        runs += words[k : k + len(runs)] * _PLACE[k]
    runs = mixed(runs)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            x = np.sort(runs[a : b - WORDS + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            out.append(mixed(np.sum(words[a:b] * _PLACE[: b - a], keepdims=True, dtype=U) + U((int(b - a) * 0xA24BAED4963EE407) % 2**64)))
        else:
            out.append(np.empty(0, U))
    return out


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, or of one longer text, so that the arrays made from them stay small."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths + 16, dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
            yield batch.slice(a, b - a)
            a = b
