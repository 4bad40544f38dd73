"""Helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARS = 1 << 20
#: Texts are handed to Python in batches of about so many bytes; Spark's own limit, 64 MB, has every task hold that much several times over.
BATCH_BYTES = 4 << 20
#: Unused memory is given back each time that a task has gone through so many bytes.
GIVEN_BACK_AFTER = 8 << 20
# Only glibc has it; other allocators give memory back by themselves.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hand memory that this process has freed back to the system.

    A worker serves tasks of every step, one after another. What its allocators keep of one task, over 100 MB after some,
    would be missing in the executor for all later ones.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows that hold about ``limit`` bytes of the column ``text``.

    Python objects made from a run are then bounded, whatever the length of the texts; a longer text is a run
    of its own. Memory that the process no longer uses is given back before the first run, now and then, and after the last.
    """
    give_back()
    passed = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = total = 0
        for row, size in enumerate(sizes):
            if row > start and total + size > limit:
                yield batch.slice(start, row - start)
                passed += total
                if passed >= GIVEN_BACK_AFTER:
                    give_back()
                    passed = 0
                start, total = row, 0
            total += size
        yield batch.slice(start)
        passed += total
    give_back()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
