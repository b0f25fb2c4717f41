"""Memory of Python workers. A worker stays alive between tasks; what it has freed goes back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

Batches = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Returns free pages of Arrow's pool and, where the C library can, of its heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Batches) -> Batches:
    """``run`` for ``mapInArrow``, with free memory given back after each batch that it makes."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            give_back()

    return wrapped


def releasing_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a group."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return wrapped


def releasing_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for two groups with one key."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return wrapped
