"""Byte-level byte-pair encoding by merge ranks, on padded numpy matrices.

Texts are cut by the tokenizer's pattern. The distinct pieces of a batch lie as rows of a matrix for
their length bucket. In each round every row merges its leftmost pair of least rank; rows without a
pair leave the matrix. Pairs are looked up in an open-addressing hash table.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Cache
from .memory import releasing

RANKS = "byte_bpe_multi_50k.tiktoken"
NONE = np.int32(2**31 - 1)
# Longer pieces are merged with a heap: a matrix row would take quadratic time.
MATRIX_BYTES = 512
BLOCK_CHARS = 1 << 20
MATRIX_CELLS = 1 << 20
ROWS_AT_ONCE = 512
CACHED_PIECES = 400_000


@functools.cache
def token_bytes(ranks_path: str) -> dict[int, bytes]:
    """Bytes of each token id."""
    with open(ranks_path, "rb") as lines:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}


class PairTable:
    """Rank of the merged token for a pair of token ids."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        self.bits = max(4, (4 * max(1, len(pairs))).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.ranks = np.full(size, NONE, dtype=np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        ranks = np.array(list(pairs.values()), dtype=np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            _, first = np.unique(np.where(free, slots, -1), return_index=True)
            placed = np.zeros(len(keys), dtype=bool)
            placed[first] = True
            placed &= free
            self.keys[slots[placed]], self.ranks[slots[placed]] = keys[placed], ranks[placed]
            keys, ranks, slots = keys[~placed], ranks[~placed], (slots[~placed] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        hashed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (hashed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank for each pair, ``NONE`` where it cannot merge; a negative id stands for padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NONE, dtype=np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys, flat = keys.ravel()[at], out.ravel()
        slots = self._slots(keys)
        while len(at):
            held = self.keys[slots]
            hit = held == keys
            flat[at[hit]] = self.ranks[slots[hit]]
            going = ~hit & (held != -1)
            at, keys, slots = at[going], keys[going], (slots[going] + 1) & (len(self.keys) - 1)
        return out


class ByteBPE:
    """Encoder and decoder for a rank file (base64 token and rank on each line)."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        self.ranks = {token: rank for rank, token in token_bytes(ranks_path).items()}
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs = {
            (self.ranks[token[:k]], self.ranks[token[k:]]): rank
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        }
        self.table = PairTable(self.pairs)
        self.cache = Cache(self._new_pieces, CACHED_PIECES)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        block: list[list[str]] = []
        size = 0
        for text in texts:
            block.append(self.pattern.findall(text))
            size += len(text)
            if size > BLOCK_CHARS:
                out += self.cache.join(block)
                block, size = [], 0
        return out + self.cache.join(block)

    def _new_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(r) for r in raw])
        out: list[bytes] = [b""] * len(raw)
        bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for k in np.unique(bucket):
            rows = np.flatnonzero(bucket == k)
            if 1 << k > MATRIX_BYTES:
                for i in rows:
                    out[i] = self._by_heap(raw[i])
                continue
            width = 1 << int(k)
            for first in range(0, len(rows), max(1, MATRIX_CELLS // width)):
                part = rows[first : first + max(1, MATRIX_CELLS // width)]
                for i, ids in zip(part, self._matrix([raw[i] for i in part], width)):
                    out[i] = ids
        return out

    def _matrix(self, raw: list[bytes], width: int) -> list[bytes]:
        lengths = np.array([len(r) for r in raw])
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((len(raw), width), -1, dtype=np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        done: list[bytes] = [b""] * len(raw)
        row = np.arange(len(raw))
        ranks = self.table.find(ids[:, :-1], ids[:, 1:])
        while len(row):
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(row)), at]
            else:
                at, best = np.zeros(len(row), int), np.full(len(row), NONE)
            ended = best == NONE
            if ended.any():
                counts = (ids[ended] >= 0).sum(axis=1)
                for i, n, values in zip(row[ended], counts, ids[ended]):
                    done[i] = values[:n].astype("<u4").tobytes()
                row, ids, ranks, at, best = (x[~ended] for x in (row, ids, ranks, at, best))
                if not len(row):
                    break
            lines = np.arange(len(row))
            ids[lines, at] = best
            after = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids = ids[:, :-1]
            ranks = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            for side in (at - 1, at):
                ok = (side >= 0) & (side < ranks.shape[1])
                ranks[lines[ok], side[ok]] = self.table.find(ids[lines[ok], side[ok]], ids[lines[ok], side[ok] + 1])
        return done

    def _by_heap(self, raw: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.pairs.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()


@functools.cache
def coder(ranks_path: str, pattern: str) -> ByteBPE:
    """One per worker process."""
    return ByteBPE(ranks_path, pattern)


def encode(
    docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key``, ``ids`` (little-endian unsigned 32-bit) of every whole text; a null text counts as empty.

    One row for each input row, repeated rows and null keys included. Other columns are left out.
    """
    ranks_path = ranks_path or public_tokenizers.path(RANKS)
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            for first in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                ids = bpe.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(releasing(run), f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode(
    encoded: DataFrame, ranks_path: str | None = None,
    key: str = "doc_id", ids: str = "ids",
) -> DataFrame:
    """``key``, ``ids`` and ``decoded``, the bytes of the text, of each row of ``encode``."""
    ranks_path = ranks_path or public_tokenizers.path(RANKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = token_bytes(ranks_path).__getitem__
        for batch in batches:
            for first in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                raw = [np.frombuffer(x or b"", dtype="<u4") for x in part.column(1).to_pylist()]
                decoded = [b"".join(map(token, ids.tolist())) for ids in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(decoded, pa.binary())], ["key", "ids", "decoded"]
                )

    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(releasing(run), f"key {kind}, ids binary, decoded binary").withColumnRenamed("key", key)
