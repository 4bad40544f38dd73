"""Hard negatives by a secondary sort of packed pair scores.

Every anchor is scored against all rows. A pair goes as one key of bytes that sorts by anchor, descending score, positives
before negatives, and id; ``repartitionAndSortWithinPartitions`` brings an anchor's keys to one task in that order. A streaming
iterator opens a window of scores at each of the first positives and gives the negatives it then meets to the windows they
lie in, so nothing of an anchor is held but its few windows.

What an anchor cannot use is left out before the shuffle, which changes no result. Rows are dealt to blocks of anchors and
stream past them through a matrix product; a stretch of rows keeps an anchor's best positives in a first pass and, when
the windows are known, the best negatives of each window in a second. What is sorted is bounded by anchors and stretches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.cross_polytope import by_width
from stowage.session import scratch_dir, written

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
ANCHORS, PIECE = 2048, 256
KEY = struct.Struct(">QQBQ")
SIGN, LARGEST = 1 << 63, (1 << 63) - 1
POSITIVE, NEGATIVE = 0, 1


def pack(anchor: int, score: int, kind: int, other: int) -> bytes:
    """A key that sorts by anchor, descending score, kind and id."""
    return KEY.pack(anchor + SIGN, LARGEST - score, kind, other + SIGN)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, other = KEY.unpack(key)
    return anchor - SIGN, LARGEST - score, kind, other - SIGN


ROWS = "vec_id bigint, label bigint, width int, vector binary"


def scaled(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, width, vector)`` of the rows that take part; a component x becomes floor(scale * x), 32 bits each.

    A finite component too large for 32 bits after scaling is an error, as scores of such vectors fit no 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in by_width(batch.column(2)):
                good = np.isfinite(values).all(axis=1)
                at, values = at[good], np.floor(values[good] * float(scale))
                if len(at) and np.abs(values).max() >= 1 << 31:
                    raise ValueError("a component is too large for 64-bit scores")
                data = [v.tobytes() for v in values.astype(np.int32)]
                ids, labels = (batch.column(i).take(pa.array(at)) for i in (0, 1))
                widths = pa.array(np.full(len(at), values.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([ids, labels, widths, pa.array(data, pa.binary())], ["vec_id", "label", "width", "vector"])

    known = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    return known.select("vec_id", "label", "vector").mapInArrow(run, ROWS)


def _values(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.int32).reshape(len(vectors), -1).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers: by doubles where these hold every sum, else by whole numbers."""
    largest = max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0))) * a.shape[1]
    if largest < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if largest < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("scores do not fit 64 bits")


class Best:
    """The first ``k`` of the (score, id) given to each slot, higher scores and then smaller ids first, each pair once."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.slot, self.score, self.id = k, *(np.zeros(0, np.int64),) * 3
        self.floor = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        slot, score, ids = slot[new], score[new], ids[new]
        starts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(starts, append=len(slot)))
        keep = place < self.k
        self.floor[slot[place == self.k - 1]] = score[place == self.k - 1]
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


class Block:
    """A block of anchors past which rows stream."""

    def __init__(self, anchors: pa.Table, kind: int, k: int) -> None:
        self.kind, self.values = kind, _values(anchors.column("vector"))
        self.ids, self.labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        if kind == POSITIVE:
            self.owner = np.arange(len(self.ids))
            self.low, self.high = np.full(len(self.ids), -LARGEST), np.full(len(self.ids), LARGEST)
        else:
            windows = [np.frombuffer(w, np.int64).reshape(-1, 2) for w in anchors.column("windows").to_pylist()]
            self.owner = np.repeat(np.arange(len(windows)), list(map(len, windows)))
            self.low, self.high = (np.concatenate([np.zeros(0, np.int64), *(w[:, i] for w in windows)]) for i in (0, 1))
        self.best = Best(len(self.owner), k)

    def stream(self, rows: pa.RecordBatch) -> None:
        values = _values(rows.column("vector"))
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        for start in range(0, len(self.ids), PIECE):
            piece = slice(start, start + PIECE)
            scores = products(self.values[piece], values)
            same = self.labels[piece][:, None] == labels[None, :]
            fits = (same & (self.ids[piece][:, None] != ids[None, :])) if self.kind == POSITIVE else ~same
            slots = np.flatnonzero((self.owner >= start) & (self.owner < start + PIECE))
            found = []
            for slot in slots.tolist():
                row = scores[self.owner[slot] - start]
                at = np.flatnonzero(fits[self.owner[slot] - start] & (row >= max(self.low[slot], self.best.floor[slot])) & (row <= self.high[slot]))
                if len(at) > 4 * self.best.k:  # ties with the last stay, repeated pairs are no second one
                    distinct = np.unique(row[at])
                    at = at[row[at] >= distinct[-min(len(distinct), self.best.k)]]
                found.append((np.full(len(at), slot), row[at], ids[at]))
            if found:
                self.best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def keys(self) -> pa.RecordBatch:
        found = {
            pack(a, s, self.kind, i)
            for a, s, i in zip(self.ids[self.owner[self.best.slot]].tolist(), self.best.score.tolist(), self.best.id.tolist(), strict=True)
        }
        return pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["key"])


def candidates(rows: DataFrame, anchors: DataFrame, kind: int, k: int, blocks: int, stretches: int) -> DataFrame:
    """``(key)`` of what each anchor keeps of every stretch of rows: its best positives, or the best negatives of its windows.

    ``anchors(vec_id, label, width, vector, windows)``. They stand before the rows of the same block and stretch.
    """
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stretch = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(stretches)).cast("int")
    fixed = anchors.select("vec_id", "label", "width", "vector", "windows", block.alias("block"), F.lit(0).alias("turn"))
    moving = rows.select("vec_id", "label", "width", "vector", F.lit(None).cast("binary").alias("windows"), every(blocks).alias("block"), F.lit(1).alias("turn"))
    met = fixed.withColumn("stretch", every(stretches)).unionByName(moving.withColumn("stretch", stretch))
    group = ["width", "block", "stretch"]
    met = met.repartition(*group).sortWithinPartitions(*group, "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, past = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (*group, "turn")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                key, piece = tuple(keys[a, :3].tolist()), batch.slice(a, b - a)
                if key != now:
                    if past is not None:
                        yield past.keys()
                    now, waiting, past = key, [], None
                if keys[a, 3] == 0:
                    waiting.append(piece)
                    continue
                if waiting:
                    past, waiting = Block(pa.Table.from_batches(waiting), kind, k), []
                if past is not None:
                    past.stream(piece)
        if past is not None:
            yield past.keys()

    return met.mapInArrow(run, "key binary")


def sorted_keys(keys: DataFrame) -> RDD:
    """The keys, an anchor's together in one partition and in order."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = keys.rdd.map(lambda row: (bytes(row[0]), None))
    return pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8])).keys()


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def first_positives(keys: Iterator[bytes], count: int) -> Iterator[tuple[int, int, int]]:
    """``(anchor, positive, score)`` of each anchor's first keys."""
    anchor, seen, last = None, 0, None
    for key in keys:
        if key == last:
            continue
        last, (now, score, _, other) = key, unpack(key)
        if now != anchor:
            anchor, seen = now, 0
        if seen < count:
            seen += 1
            yield anchor, other, score


def emitted(keys: Iterator[bytes], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of the result from keys in order; holds the open windows of one anchor and nothing else."""
    anchor, last, windows = None, None, []
    for key in keys:
        if key == last:
            continue
        last, (now, score, kind, other) = key, unpack(key)
        if now != anchor:
            anchor, windows = now, []
        if kind == POSITIVE:
            if len(windows) < positives:
                windows.append([other, score, *window(score, low, high), 0])
            continue
        for one in windows:
            if one[2] <= score <= one[3] and one[4] < negatives:
                one[4] += 1
                yield anchor, one[0], one[4], other, one[1], score


FOUND = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: int = SCALE, block: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``rows(vec_id, label, embedding)``.

    ``anchors`` is a condition over ``vec_id`` and ``label``. For each anchor and each of its first ``positives`` rows of the
    same label, the first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the
    positive's. Higher scores come first, then smaller ids. A row with a null id or label, a null or empty vector, or
    a component that is null, NaN or infinite takes no part; vectors of different widths do not meet. Rows that repeat id
    and vector count once, and rows with an anchor's id are never its partners; of different anchors that share an id
    the smallest by label and vector counts, and a partner's id with several vectors may come once with each score.
    An anchor without positives or without fitting negatives gives no rows, as does an empty input. Other columns are
    ignored. Without a chance of error: every anchor is scored against all rows.
    """
    spark = rows.sparkSession
    scratch = scratch_dir(spark, "hard-negatives")
    named = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("vector"))
    given = written(scaled(named, scale), f"{scratch}/rows")
    chosen = given.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "width", "vector")).alias("v")).select("vec_id", "v.*")
    chosen = written(chosen.withColumn("windows", F.lit(None).cast("binary")), f"{scratch}/anchors")
    count = chosen.count()
    blocks = max(1, -(-count // block))
    stretches = max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks))

    keys = written(candidates(given, chosen, POSITIVE, positives, blocks, stretches), f"{scratch}/positive-keys")
    firsts = sorted_keys(keys).mapPartitions(lambda part: first_positives(part, positives))
    firsts = written(spark.createDataFrame(firsts, "vec_id bigint, other bigint, score bigint"), f"{scratch}/positives")
    windows = firsts.groupBy("vec_id").agg(F.collect_set("score").alias("scores"))
    windows = _packed_windows(windows, low, high)
    ready = written(chosen.drop("windows").join(windows, "vec_id"), f"{scratch}/windows")
    more = candidates(given, ready, NEGATIVE, negatives, blocks, stretches)
    both = written(_keys(firsts).unionByName(more), f"{scratch}/keys")
    found = sorted_keys(both).mapPartitions(lambda part: emitted(part, positives, negatives, low, high))
    return spark.createDataFrame(found, FOUND)


def _packed_windows(scores: DataFrame, low: int, high: int) -> DataFrame:
    return _mapped(scores, lambda row: (row["vec_id"], np.array([window(s, low, high) for s in row["scores"]], np.int64).tobytes()), "vec_id bigint, windows binary")


def _keys(firsts: DataFrame) -> DataFrame:
    return _mapped(firsts, lambda row: (pack(row["vec_id"], row["score"], POSITIVE, row["other"]),), "key binary")


def _mapped(rows: DataFrame, of_row: Callable[[dict], tuple], schema: str) -> DataFrame:
    """A few columns of small rows made from others."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [of_row(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)], names)

    return rows.mapInArrow(run, schema)
