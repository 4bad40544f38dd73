"""Taking a few rows out of a large table by id, without shuffling the table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.session import written

#: A filter has so many bits for each id, up to 16 MB; past that it lets ever more rows through.
BITS_PER_ID, LEAST_BITS, MOST_BITS, HASHES = 16, 16, 27, 3


def _places(ids: np.ndarray, width: int) -> np.ndarray:
    """The bits that stand for each id, one row for each hash."""
    x = ids.astype(np.int64).view(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for i in range(HASHES):
            h = (x + np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out.append((h >> np.uint64(64 - width)).astype(np.int64))
    return np.array(out)


@dataclass(frozen=True)
class Filter:
    """A Bloom filter of ids on every executor, of bounded size; close it when the jobs that use it have ended."""

    bits: Broadcast
    width: int

    @classmethod
    def of(cls, ids: DataFrame) -> Filter:
        """From ``ids(doc_id)``; the tasks that build it send their bits, not their ids."""
        width = min(max((BITS_PER_ID * ids.count()).bit_length(), LEAST_BITS), MOST_BITS)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << (width - 6), np.uint64)
            for batch in batches:
                places = _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), width).ravel()
                np.bitwise_or.at(bits, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
            words = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(bits[words].view(np.int64))], ["word", "bits"])

        words = ids.select("doc_id").mapInArrow(build, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(1 << (width - 6), np.int64)
        table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        return cls(ids.sparkSession.sparkContext.broadcast(table), width)

    def passing(self, batch: pa.RecordBatch, ids: pa.Array, passing: bool = True) -> pa.RecordBatch:
        """The rows whose id passes, or those whose id does not; rows without id do neither."""
        bits = self.bits.value.view(np.uint64)
        places = _places(ids.fill_null(0).to_numpy(zero_copy_only=False), self.width)
        hit = ((bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=0)
        return batch.filter(pa.array(ids.is_valid().to_numpy(zero_copy_only=False) & (hit == passing)))

    def close(self) -> None:
        self.bits.destroy()


def passing(rows: DataFrame, *filters: tuple[Filter, bool]) -> DataFrame:
    """Rows of ``rows(doc_id, ...)`` that pass, or do not pass, each of the filters; one Python process for all."""
    at = rows.columns.index("doc_id")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, wanted in filters:
                batch = one.passing(batch, batch.column(at), wanted)
            if batch.num_rows:
                yield batch

    return rows.mapInArrow(keep, rows.schema)


def exactly_among(rows: DataFrame, ids: DataFrame, scratch: str) -> DataFrame:
    """Rows of ``rows(doc_id, ...)`` whose id is in ``ids(doc_id)``, no others, with few rows moved; written below ``scratch``.

    The ids which pass a filter and should not are found without the rows' other columns and make a second filter. Rows
    that pass the first one only are members, those that pass both are joined: few while the filters have their bits
    for each id, more the further the ids outgrow the filters' size.
    """
    first = Filter.of(ids)
    wrong = passing(rows.select("doc_id"), (first, True)).join(ids.select("doc_id"), "doc_id", "left_anti").distinct()
    wrong = written(wrong, f"{scratch}/wrong-ids")
    second = Filter.of(wrong)
    unsure = passing(rows, (first, True), (second, True)).join(ids.select("doc_id"), "doc_id", "left_semi").select(*rows.columns)
    found = written(passing(rows, (first, True), (second, False)).unionByName(unsure), f"{scratch}/members")
    for one in (first, second):
        one.close()
    return found
