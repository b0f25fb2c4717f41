"""Corpus totals of hashed keys, looked up from packed blocks.

A block is one row that stands for many documents and holds arrays of 64-bit keys. Every block sends
its distinct keys with their counts to hash ranges, each range adds them up, and the totals travel
back to the blocks that asked. A key costs a block one entry however often it occurs there, so a key
in a third of all documents makes no large group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .memory import releasing, releasing_group

KEYS_PER_RANGE = 1 << 20
LEAST_RANGES = 64

Keys = Callable[[dict], tuple[np.ndarray, np.ndarray]]


def ranges(n_keys: int) -> int:
    """Number of hash ranges, a power of two that grows with the keys."""
    return max(LEAST_RANGES, 1 << max(0, -(-n_keys // KEYS_PER_RANGE) - 1).bit_length())


def narrow(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, after one byte that says how many."""
    largest = int(values.max(initial=0))
    size = next(n for n in (1, 2, 4, 8) if largest < 1 << (8 * n))
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def widened(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def totals(blocks: DataFrame, keys_of: Keys, n_ranges: int) -> DataFrame:
    """``block``, ``range``, ``totals``: for each block and hash range, the sums over all blocks of the counts
    of that block's keys, in ascending order of the keys, packed by ``narrow``. A block sent twice counts twice;
    without keys there are no rows.

    ``keys_of`` gives a block's distinct keys (unsigned 64-bit, ascending) and their counts.
    """
    shift = np.uint64(64 - (n_ranges.bit_length() - 1))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, counts = keys_of(row)
                if not len(keys):
                    continue
                owner = (keys >> shift).astype(np.int64)
                used, first = np.unique(owner, return_index=True)
                cuts = np.append(first, len(keys))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used),
                        pa.array(np.full(len(used), row["block"], np.int64)),
                        pa.array([keys[a:b].astype("<u8").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([narrow(counts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    ["range", "block", "keys", "counts"],
                )

    def add_up(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, "<u8") for x in table["keys"].to_pylist()]
        sizes = [len(k) for k in keys]
        counts = [widened(x) for x in table["counts"].to_pylist()]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)[place]
        cuts = np.cumsum([0, *sizes])
        return pa.table({
            "block": table["block"], "range": table["range"],
            "totals": pa.array([narrow(sums[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
        })

    sent = blocks.mapInArrow(releasing(send), "range long, block long, keys binary, counts binary")
    return sent.groupBy("range").applyInArrow(releasing_group(add_up), "block long, range long, totals binary")


def joined(replies: pa.Table) -> np.ndarray:
    """One block's totals in the order of its keys."""
    order = np.argsort(replies["range"].to_numpy())
    parts = replies["totals"].to_pylist()
    return np.concatenate([widened(parts[i]) for i in order]) if len(order) else np.zeros(0, np.int64)
