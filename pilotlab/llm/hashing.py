"""Word and n-gram hashes of whole Arrow batches of texts, without a Python object per word.

Words are ``[^\\x20\\x09-\\x0D]+``. The separators are single bytes that never occur inside a longer
UTF-8 sequence, so words are cut in the encoded bytes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

# Bytes hashed at once; bounds the working arrays of a task (about 60 bytes for each).
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@functools.cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x2545F4914F6CDD1D, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.cache
def _is_space() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[32, 9, 10, 11, 12, 13]] = True
    return out


@functools.cache
def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: empty) and the ``n + 1`` offsets between them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole texts with about ``CHUNK_BYTES`` bytes; a longer text is a run of its own."""
    n, out, first = len(offsets) - 1, [], 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        last = min(n, max(first + 1, last))
        out.append((first, last))
        first = last
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word in order, for each text the number of words before it (``n + 1`` values), and the
    words' lengths in bytes."""
    n = len(offsets) - 1
    none = np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    if not len(data):
        return none
    inside = ~_is_space()[data]
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    # A word never runs on into the next text.
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    starts_here[cuts] = inside[cuts]
    starts = np.flatnonzero(starts_here)
    if not len(starts):
        return none
    places = np.flatnonzero(inside)
    first = np.searchsorted(places, starts)
    lengths = np.diff(np.append(first, len(places)))
    within = np.arange(len(places)) - np.repeat(first, lengths)
    values = _byte_values()[_lower()[data[places]] if lower else data[places]]
    longest = 1 << int(lengths.max()).bit_length()
    sums = np.add.reduceat(values * _powers(longest)[within], first)
    hashes = mix(sums ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return hashes, np.searchsorted(starts, offsets), lengths


def windows(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``size`` words inside a text, and the ``n + 1`` bounds between texts."""
    bounds = np.concatenate([[0], np.cumsum(np.maximum(np.diff(counts) - size + 1, 0))])
    return np.repeat(counts[:-1] - bounds[:-1], np.diff(bounds)) + np.arange(bounds[-1]), bounds


def gram_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside a text, and the ``n + 1`` bounds between texts."""
    first, bounds = windows(counts, size)
    if len(words) < size:
        return np.zeros(0, np.uint64), bounds
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total += mix(words[k : k + len(total)] + np.uint64(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
    return mix(total[first] + np.uint64(size)), bounds
