"""Token ids in files, coded by a static range asymmetric numeral system.

A store has two Parquet tables: ``table`` (id, frequency), one shared frequency table for all blocks,
and ``blocks``, one row for each block of whole documents. A block's payload interleaves up to
``LANES`` coder states; blocks need nothing from each other, and within a block the states kept at
checkpoints let its segments be decoded apart. Every segment has a checksum of its ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from . import tokens
from .memory import releasing

LANES = 1024
SEGMENT_STEPS = 256  # a checkpoint after so many ids of each lane
BLOCK_IDS = 2 * LANES * SEGMENT_STEPS
SCALE_BITS = 20  # frequencies add up to 2 ** SCALE_BITS
ROWS_AT_ONCE = 2048
LOW = np.uint64(1 << 31)  # states stay in [2 ** 31, 2 ** 63)
WORD = np.uint64(32)

BLOCK_SCHEMA = (
    "part long, first_row long, first_id long, n_ids long, lanes int, doc_ids binary, doc_null binary,"
    " doc_counts binary, states binary, word_counts binary, checksums binary, payload binary"
)


class FrequencyTable:
    """Frequencies of ids, each at least 1, with a sum of ``2 ** SCALE_BITS``."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.int64), counts[order].astype(np.int64)
        self.bits = max(SCALE_BITS, int(2 * len(ids)).bit_length())
        spare = (1 << self.bits) - len(ids)
        share = counts.astype(object) * spare // max(1, int(counts.sum()))
        self.frequencies = 1 + share.astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        if len(ids):
            self.frequencies[np.argmax(self.frequencies)] += (1 << self.bits) - self.frequencies.sum()
        self._prepare()

    @classmethod
    def stored(cls, ids: np.ndarray, frequencies: np.ndarray) -> FrequencyTable:
        out = cls.__new__(cls)
        order = np.argsort(ids)
        out.ids, out.frequencies = ids[order].astype(np.int64), frequencies[order].astype(np.int64)
        out.bits = int(out.frequencies.sum()).bit_length() - 1 if len(ids) else SCALE_BITS
        out._prepare()
        return out

    def _prepare(self) -> None:
        self.starts = (np.cumsum(self.frequencies) - self.frequencies).astype(np.uint64)
        self.sizes = self.frequencies.astype(np.uint64)
        self.symbol = np.zeros(int(self.ids.max(initial=-1)) + 1, dtype=np.int64)
        self.symbol[self.ids] = np.arange(len(self.ids))

    def at_slot(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.frequencies)


def encode_block(table: FrequencyTable, ids: np.ndarray) -> dict[str, object]:
    """Lanes take the ids in turn. Steps run from last to first; a state that would pass 2 ** 63 sheds
    its low 32 bits. The states before each segment are its checkpoint."""
    n = len(ids)
    lanes = int(max(1, min(LANES, 1 << max(0, n // 64).bit_length())))
    steps = -(-n // lanes)
    symbols = table.symbol[ids]
    total, mask_shift = np.uint64(1 << table.bits), np.uint64(63 - table.bits)
    states = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    checkpoints: list[np.ndarray] = []
    counts: list[int] = []
    in_segment = 0
    limits, rests = table.sizes << mask_shift, total - table.sizes
    for step in range(steps - 1, -1, -1):
        s = symbols[step * lanes : (step + 1) * lanes]
        x = states[: len(s)]
        full = np.flatnonzero(x >= limits[s])
        shed = x[full]
        words.append(shed.astype("<u4"))  # the low 32 bits
        in_segment += len(shed)
        x[full] = shed >> WORD
        # (quotient << bits) + remainder + start
        x += x // table.sizes[s] * rests[s]
        x += table.starts[s]
        if step % SEGMENT_STEPS == 0:
            checkpoints.append(states.copy())
            counts.append(in_segment)
            in_segment = 0
    raw = ids.astype("<u4")
    width = lanes * SEGMENT_STEPS
    sums = [zlib.crc32(raw[i : i + width].tobytes()) for i in range(0, n, width)]
    return {
        "n_ids": n, "lanes": lanes,
        "states": np.concatenate(checkpoints[::-1]).astype("<u8").tobytes() if checkpoints else b"",
        "word_counts": np.array(counts[::-1], dtype="<i8").tobytes(),
        "checksums": np.array(sums, dtype="<i8").tobytes(),
        "payload": b"".join(w.tobytes() for w in reversed(words)),
    }


def decode_block(
    table: FrequencyTable, slots: np.ndarray, block: dict[str, object], segments: range | None = None
) -> np.ndarray:
    """Ids of a block, or of some of its segments, which start at their checkpoints."""
    n, lanes = int(block["n_ids"]), int(block["lanes"])
    word_counts = np.frombuffer(block["word_counts"], "<i8")
    checksums = np.frombuffer(block["checksums"], "<i8")
    states_of = np.frombuffer(block["states"], "<u8").reshape(len(word_counts), lanes)
    words = np.frombuffer(block["payload"], "<u4").astype(np.uint64)
    begins = np.concatenate([[0], np.cumsum(word_counts)])
    width, bits = lanes * SEGMENT_STEPS, np.uint64(table.bits)
    low = np.uint64((1 << table.bits) - 1)
    out = []
    for k in segments if segments is not None else range(len(word_counts)):
        x = states_of[k].copy()
        at, left = int(begins[k]), min(width, n - k * width)
        ids = np.empty(left, dtype=np.int64)
        for first in range(0, left, lanes):
            live = x[: min(lanes, left - first)]
            slot = live & low
            s = ids[first : first + len(live)]
            s[:] = slots.take(slot.view(np.int64))
            live >>= bits
            live *= table.sizes.take(s)
            slot -= table.starts.take(s)
            live += slot
            empty = np.flatnonzero(live < LOW)
            live[empty] = live.take(empty) << WORD | words[at : at + len(empty)]
            at += len(empty)
        ids = table.ids[ids]
        if zlib.crc32(ids.astype("<u4").tobytes()) != checksums[k] or at != begins[k + 1]:
            raise ValueError(f"checksum of segment {k} does not hold")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def token_rows(
    docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Ids of every whole text (null: empty) with ``end_id``, in ascending order of ``key`` (null first).

    Range partitions in sorted order are numbered by ``part``; ``row`` and ``before`` count the rows
    and ids before a row in its part. Repeated keys are ordered by a hash of the text. Stored once.
    """
    path = tokenizer_path or tokens.default_tokenizer()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.tokenizer(path)
        part, row, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for first in range(0, len(batch), ROWS_AT_ONCE):
                some = batch.slice(first, ROWS_AT_ONCE)
                ids, counts = tokens.with_end(*words.encode(some.column(1)), end_id)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(some), part)), pa.array(row + np.arange(len(some))),
                     pa.array(before + ends - counts), pa.array(counts), tokens.binary_rows(ids, counts)],
                    ["key", "part", "row", "before", "n", "ids"],
                )
                row, before = row + len(some), before + len(ids)

    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    schema = "key long, part long, row long, before long, n long, ids binary"
    return cut_lineage(ordered.mapInArrow(releasing(run), schema), "zstd")


def _count_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        # The ids of a batch are counted together: a count needs as long an array as there are different ids.
        n, raw = pc.sum(batch.column(0)).as_py() or 0, b"".join(batch.column(1).to_pylist())
        counts = np.bincount(np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4"), minlength=len(total))
        counts[: len(total)] += total
        total = counts
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "count"])


def write(rows: DataFrame, path: str) -> None:
    """Writes the rows of ``token_rows`` as a store at ``path``.

    The counts of all ids and of the ids of each part are added up first; both are bounded, by the
    vocabulary and by the number of partitions.
    """
    spark = rows.sparkSession
    counted = rows.select("n", "ids").mapInArrow(releasing(_count_ids), "id long, count long")
    counts = counted.groupBy("id").agg(F.sum("count").alias("count")).collect()
    table = FrequencyTable(np.array([r["id"] for r in counts], np.int64), np.array([r["count"] for r in counts], np.int64))
    pairs = list(zip(table.ids.tolist(), table.frequencies.tolist()))
    spark.createDataFrame(pairs, "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")

    totals = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).orderBy("part").collect()
    starts = dict(zip([r["part"] for r in totals], np.cumsum([0, *[r["n"] for r in totals]]).tolist()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for item in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (item[1] != held[0][1] or item[2] != held[-1][2] + 1 or size + item[4] > BLOCK_IDS):
                    yield _block(table, held, starts)
                    held, size = [], 0
                held.append(item)
                size += item[4]
        if held:
            yield _block(table, held, starts)

    blocks = rows.select("key", "part", "row", "before", "n", "ids").mapInArrow(releasing(run), BLOCK_SCHEMA)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def _block(table: FrequencyTable, held: list[tuple], starts: dict[int, int]) -> pa.RecordBatch:
    keys, parts, rows, before, counts, raw = zip(*held)
    joined = b"".join(raw)
    ids = np.frombuffer(joined, dtype="<u2" if len(joined) == 2 * sum(counts) else "<u4")
    values = {
        "part": parts[0], "first_row": rows[0], "first_id": starts[parts[0]] + before[0],
        "doc_ids": np.array([k or 0 for k in keys], "<i8").tobytes(),
        "doc_null": bytes(k is None for k in keys),
        "doc_counts": np.array(counts, "<i8").tobytes(),
    } | encode_block(table, ids)
    names = [field.split()[0] for field in BLOCK_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrays = [pa.array([values[f.split()[0]]], kinds[f.split()[1]]) for f in BLOCK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(arrays, names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) of every stored document."""
    stored = spark.read.schema("id long, frequency long").parquet(f"{path}/table").collect()  # one row for each id
    ids = np.array([r["id"] for r in stored], np.int64)
    frequencies = np.array([r["frequency"] for r in stored], np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable.stored(ids, frequencies)
        slots = table.at_slot()
        for batch in batches:
            for block in batch.to_pylist():
                coded = decode_block(table, slots, block).astype("<u4")
                counts = np.frombuffer(block["doc_counts"], "<i8")
                ends = np.cumsum(counts)
                keys = pa.array(
                    np.frombuffer(block["doc_ids"], "<i8"), mask=np.frombuffer(block["doc_null"], np.uint8).astype(bool)
                )
                pieces = [coded[e - c : e].tobytes() for c, e in zip(counts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(block["first_id"] + ends - counts), pa.array(counts), pa.array(pieces, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    return blocks.mapInArrow(releasing(run), "doc_id long, start long, n_tokens long, ids binary")
