"""Packing of documents into training sequences along a space-filling curve.

Each document becomes a hashed vector of its token counts, projected to few dimensions. The Hilbert
key of the scaled projection is the sort key, so documents that are near on the curve, and mostly
alike, share sequences.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from . import tokens
from .hashing import mix
from .memory import releasing

BUCKETS = 256
DIMENSIONS = 4
BITS = 15  # for each dimension of the key
SEQUENCE = 2048
ROWS_AT_ONCE = 2048

PIECE_SCHEMA = (
    "key long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of unsigned coordinates below ``2 ** bits``.

    The usual transpose form: the coordinates' bits are turned level by level from the highest down,
    then Gray-decoded across the dimensions and interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where((x[n - 1] & level) != 0, flip ^ (level - 1), flip)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _directions() -> np.ndarray:
    """Fixed signs, one column for each dimension."""
    cells = np.arange(1, BUCKETS * DIMENSIONS + 1, dtype=np.uint64)
    return np.where(mix(cells) >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, DIMENSIONS)


@functools.cache
def _buckets() -> np.ndarray:
    return (mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(56)).astype(np.int64)


def project(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of hashed id counts, projected; one row for each run of ids."""
    n = len(counts)
    cells = np.repeat(np.arange(n) * BUCKETS, counts) + _buckets()[ids & 0xFFFF]
    vectors = np.sqrt(np.bincount(cells, minlength=n * BUCKETS)).reshape(n, BUCKETS)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors @ _directions() / np.maximum(lengths, 1e-9)


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int, key: str, text: str) -> DataFrame:
    """``key``, ``n``, ``ids`` and the projection of every document. Stored once."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.tokenizer(tokenizer_path)
        for batch in batches:
            for first in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                ids, counts = tokens.with_end(*words.encode(part.column(1)), end_id)
                places = project(ids, counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), tokens.binary_rows(ids, counts)]
                    + [pa.array(places[:, d]) for d in range(DIMENSIONS)],
                    ["key", "n", "ids"] + [f"p{d}" for d in range(DIMENSIONS)],
                )

    schema = "key long, n long, ids binary" + "".join(f", p{d} double" for d in range(DIMENSIONS))
    return cut_lineage(rows.mapInArrow(releasing(run), schema), "zstd")


def curve_order(rows: DataFrame) -> DataFrame:
    """``rows`` range-partitioned and sorted by their Hilbert key, copies of a document by their key.

    The projections are scaled by their mean and deviation over all rows. ``key`` breaks ties in the
    range bounds, so that many equal documents spread over partitions.
    """
    sums = rows.agg(*[f(f"p{d}") for d in range(DIMENSIONS) for f in (F.mean, F.stddev_pop)]).first()
    mean = np.array([sums[2 * d] or 0.0 for d in range(DIMENSIONS)])
    width = np.array([sums[2 * d + 1] or 1.0 for d in range(DIMENSIONS)])

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        scaled = (np.column_stack(columns) - mean) / width
        cells = np.clip((scaled + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return pd.Series(hilbert_keys(cells))

    keyed = rows.withColumn("curve", place(*[f"p{d}" for d in range(DIMENSIONS)]))
    return keyed.repartitionByRange("curve", "key").sortWithinPartitions("curve", "key")


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, length: int = SEQUENCE,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row for each piece of a document: ``key``, ``start``, ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and the piece's ``ids`` (little-endian unsigned 32-bit).

    Sequences of ``length`` ids are filled in curve order and documents are cut where one is full.
    What is left at the end of a partition is cut into sequences whose lengths are powers of two, so
    nothing is padded when ``length`` is one. A null text counts as empty: it has its end id. Repeated
    rows are packed each. No rows give no pieces; other columns are left out.
    """
    path = tokenizer_path or tokens.default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence, filled = TaskContext.get().partitionId() << 40, 0, 0
        open_pieces: list[tuple[int, int, int, int, bytes]] = []  # of the sequence that is not full

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
            columns = list(zip(*pieces)) if pieces else [()] * len(names)
            kinds = [pa.binary() if "binary" in f else pa.int64() for f in PIECE_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def placed(pieces: list[tuple[int, int, int, int, bytes]], number: int) -> list[tuple]:
            out, offset = [], 0
            for k, start, size, total, ids in pieces:
                out.append((k, start, size, total, part + number, offset, ids))
                offset += size
            return out

        for batch in batches:
            full: list[tuple] = []
            for k, n, raw in zip(*[c.to_pylist() for c in batch.columns]):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                start = 0
                while start < n:
                    size = min(n - start, length - filled)
                    open_pieces.append((k, start, size, n, ids[4 * start : 4 * (start + size)]))
                    start, filled = start + size, filled + size
                    if filled == length:
                        full += placed(open_pieces, sequence)
                        open_pieces, sequence, filled = [], sequence + 1, 0
            yield rows(full)
        rest = []
        for bit in range(filled.bit_length() - 1, -1, -1):
            room, taken = filled & 1 << bit, []
            while room:
                k, start, size, total, ids = open_pieces.pop(0)
                take = min(size, room)
                taken.append((k, start, take, total, ids[: 4 * take]))
                if take < size:
                    open_pieces.insert(0, (k, start + take, size - take, total, ids[4 * take :]))
                room -= take
            if taken:
                rest += placed(taken, sequence)
                sequence += 1
        yield rows(rest)

    ordered = curve_order(token_rows(docs, path, end_id, key, text))
    pieces = ordered.select("key", "n", "ids").mapInArrow(releasing(run), PIECE_SCHEMA)
    return pieces.withColumnRenamed("key", key)
