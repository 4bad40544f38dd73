"""SimHash fingerprints, and search for all fingerprints within a Hamming radius.

A term is a pair of neighbouring words (a single word where there is no pair), weighted by how often it occurs. The
64-bit hash of every term votes with its weight for or against each bit of the fingerprint.

For the search the 64 bits are cut into blocks. Two fingerprints within ``radius`` bits agree in at least
``blocks - radius`` blocks, so there is one table for each choice of so many blocks, with those blocks permuted to the
front as its key: fingerprints that are near meet in at least one table, whatever bits differ.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.batches import column, slices
from stowage.session import scratch_dir, written

BITS = 64
RADIUS, BLOCKS = 3, 5
CACHED_WORDS = 300_000
CHUNK = 1 << 14

_WORDS: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; those of a task's frequent words are computed once."""
    if len(_WORDS) > CACHED_WORDS:
        _WORDS.clear()
    for word in set(words).difference(_WORDS):
        _WORDS[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all its bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text; 0 for a text without words."""
    words = (text or "").split()
    if not words:
        return 0
    hashes = _word_hashes(words)
    with np.errstate(over="ignore"):
        pairs = hashes if len(words) == 1 else hashes[:-1] * np.uint64(3) + (hashes[1:] ^ np.uint64(0x9E3779B97F4A7C15))
        terms, weights = np.unique(_mixed(pairs), return_counts=True)
    votes = np.zeros(BITS)
    for i in range(0, len(terms), CHUNK):
        signs = np.unpackbits(terms[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
        weight = weights[i : i + CHUNK].astype(np.float32)
        votes += 2.0 * (weight @ signs) - weight.sum()
    return int(np.packbits(votes > 0).view(">u8")[0])


def fingerprints(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint)`` for each row. Null, empty and blank texts have the fingerprint 0 (as a hex string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [f"{fingerprint(t):016x}" for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("fingerprint", "string"))


def likeness(left: Column, right: Column) -> Column:
    """The share of bits in which two hexadecimal fingerprints agree."""
    return 1 - F.bit_count(number(left).bitwiseXOR(number(right))) / F.lit(float(BITS))


def number(fingerprint: Column) -> Column:
    """A hexadecimal fingerprint as a (signed) number."""
    high = F.conv(F.substring(fingerprint, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(fingerprint, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The bits that each table's key is made of, one mask for each choice of ``blocks - radius`` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    single = [(1 << high) - (1 << low) for low, high in itertools.pairwise(edges)]
    return [sum(choice) for choice in itertools.combinations(single, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def search(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(query, fingerprint, distance)``: all pairs of different or equal fingerprints within ``radius`` bits.

    Both inputs have a column ``fingerprint`` (hexadecimal) and are reduced to its distinct, non-null values, so copies
    cost nothing. A pair that meets in several tables is formed in the first of them only. Take more ``blocks`` for more
    fingerprints: keys get longer (``64 * (blocks - radius) / blocks`` bits) and tables more.
    """
    masks = [_signed(m) for m in block_masks(radius, blocks)]
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.select("fingerprint").dropna().distinct().select(F.col("fingerprint").alias(name), number(F.col("fingerprint")).alias(f"{name}_bits"))
        return distinct.select(name, f"{name}_bits", F.explode(tables).alias("t")).select(
            name, f"{name}_bits", "t.table", F.col(f"{name}_bits").bitwiseAND(F.col("t.mask")).alias("key")
        )

    left, right = keyed(queries, "query").alias("l"), keyed(fingerprints, "found").alias("r")
    differing = F.col("query_bits").bitwiseXOR(F.col("found_bits"))
    first = F.coalesce(*[F.when(differing.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    near = (F.bit_count(differing) <= radius) & (first == F.col("l.table"))
    on = (F.col("l.table") == F.col("r.table")) & (F.col("l.key") == F.col("r.key")) & near
    return left.join(right, on).select("query", F.col("found").alias("fingerprint"), F.bit_count(differing).alias("distance"))


def half_replaced(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many characters from the start of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Stream:
    """Goes through one partition of documents in order and edits each with the one that follows it.

    Rows are ``(kind, part, doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint, text)``.
    The first document is also put out as a *head* and the last one only as a *tail*, both with their texts, as the
    last one's follower is the head of another partition.
    """

    KINDS = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
    NAMES = ("kind", "part", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "text")
    SCHEMA = (
        "kind string, part int, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, next_fingerprint string, text string"
    )

    @classmethod
    def batch(cls, rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in cls.NAMES]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, cls.KINDS, strict=True)], list(cls.NAMES))

    @staticmethod
    def done(part: int, doc_id: int | None, text: str, own: str, following: str, next_own: str) -> tuple:
        changed = half_replaced(text, following)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return "done", part, doc_id, len(text), digest, own, f"{fingerprint(changed):016x}", next_own, None

    @classmethod
    def run(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                own = f"{fingerprint(text):016x}"
                if before is None:
                    rows.append(("head", part, doc_id, len(text), None, own, None, None, text))
                else:
                    rows.append(cls.done(part, *before, text, own))
                before = doc_id, text, own
            yield cls.batch(rows)
        if before is not None:
            doc_id, text, own = before
            yield cls.batch([("tail", part, doc_id, len(text), None, own, None, None, text)])

    @classmethod
    def finish(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names = ("part", "doc_id", "text", "fingerprint", "next_text", "next_own")
            yield cls.batch([cls.done(*row) for row in zip(*(column(batch, n) for n in names), strict=True)])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint)``, one row for each row.

    The edited text is :func:`half_replaced` with the next document in descending ``doc_id``; the first one follows the
    last. The documents are range-sorted by id once, and every task streams through its own range; only the last row of
    each range is finished in a second, small job. Nulls count as empty texts, a null id comes last, rows with equal
    ids are ordered by text. A single row follows itself. Other columns are ignored; an empty input gives no rows.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    streamed = texts.repartitionByRange(*order[:1]).sortWithinPartitions(*order).mapInArrow(_Stream.run, _Stream.SCHEMA)
    streamed = written(streamed, f"{scratch_dir(docs.sparkSession, 'simhash')}/streamed")

    heads = streamed.where("kind = 'head'")
    ranges = heads.select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part")
    )
    followers = heads.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_own"))
    tails = streamed.where("kind = 'tail'").join(ranges, "part").join(followers, "next_part")
    tails = tails.select("part", "doc_id", "text", "fingerprint", "next_text", "next_own").mapInArrow(_Stream.finish, _Stream.SCHEMA)
    return streamed.where("kind = 'done'").unionByName(tails).drop("kind", "part", "text")
