"""Minimax contiguous partition of ordered atomic groups into shards.

Groups are ordered by their digest, and a distributed prefix sum gives each its place on a line as long as all sizes
together. A shard is a stretch of that line which begins and ends between groups. Binary search finds the smallest
capacity for which a greedy walk, each shard as long as the capacity allows, reaches the end of the line.

The walk asks for the last group boundary at or before a place. The driver knows the boundaries as a bounded number of
*blocks* (first and last boundary in a stretch), so it gets a lower and an upper answer. Where these still differ in
effect, the few blocks in question are read again in finer blocks, one aggregation for each step, until they agree.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.prefix import digest_key, random_key, running_totals
from stowage.session import scratch_dir, written

BLOCKS = 4096
FINER = 64


class Boundaries:
    """Group boundaries on a line from 0 to ``total``, known in blocks that ``finer`` can split.

    ``finer`` takes stretches ``[(low, high, width), ...]`` and returns the blocks ``[(first, last), ...]`` in them, of
    at most ``width`` each.
    """

    def __init__(self, blocks: Sequence[tuple[int, int]], total: int, finer: Callable[[list], list]) -> None:
        self.total, self.finer = total, finer
        self._put([(0, 0), *blocks])

    def _put(self, blocks: Sequence[tuple[int, int]]) -> None:
        self.blocks = sorted(blocks)
        self.lows, self.highs = [b[0] for b in self.blocks], [b[1] for b in self.blocks]
        self.open: set[int] = set()

    def floor(self, place: int, upper: bool) -> int:
        """The last boundary at or before ``place``: at least it, or (``upper``) at most it."""
        if place >= self.total:
            return self.total
        block = bisect.bisect_right(self.lows, place) - 1
        if place >= self.highs[block]:
            return self.highs[block]
        if place > self.lows[block]:
            self.open.add(block)
        return place if upper else self.lows[block]

    def ceil(self, place: int) -> int:
        """The first boundary at or after ``place``; a guess while its block is open."""
        block = bisect.bisect_left(self.highs, place)
        if place > self.lows[block]:
            self.open.add(block)
            return self.highs[block]
        return self.lows[block]

    def refine(self) -> bool:
        """Split the blocks asked for since the last call; False if there were none."""
        opened = [self.blocks[b] for b in sorted(self.open) if self.lows[b] < self.highs[b]]
        if not opened:
            self.open.clear()
            return False
        found = self.finer([(low, high, max(1, -(-(high - low + 1) // FINER))) for low, high in opened])
        self._put([b for b in self.blocks if b not in set(opened)] + found)
        return True


def _walk(lines: Boundaries, capacity: int, shards: int, upper: bool) -> bool:
    place = 0
    for _ in range(shards):
        place = lines.floor(place + capacity, upper)
    return place >= lines.total


def smallest_capacity(lines: Boundaries, shards: int, largest: int) -> int:
    """The smallest capacity with which ``shards`` shards hold all groups, of which the largest has size ``largest``."""
    while True:
        even = -(-lines.total // shards)
        found = []
        for upper in (True, False):
            low, high = max(largest, even), even + largest
            while low < high:
                middle = (low + high) // 2
                if _walk(lines, middle, shards, upper):
                    high = middle
                else:
                    low = middle + 1
            found.append(low)
        if found[0] == found[1]:
            return found[0]
        # Only blocks that a walk between the two answers can meet matter; a block lies open on one of the two walks.
        lines.open.clear()
        for capacity in {found[0], found[1] - 1, found[1]}:
            for upper in (True, False):
                _walk(lines, capacity, shards, upper)
        if not lines.refine():
            raise RuntimeError("capacities differ although all boundaries on the way are known")


def even_cuts(lines: Boundaries, shards: int, capacity: int) -> list[int]:
    """Inner cuts, as even as can be with no shard above ``capacity``: greedy, but no further than an even share needs.

    A walk from the end gives the earliest place at which each cut may lie, the greedy step the latest.
    """
    while True:
        lines.open.clear()
        earliest = [0] * shards + [lines.total]
        for i in range(shards - 1, 0, -1):
            earliest[i] = lines.ceil(max(0, earliest[i + 1] - capacity))
        cuts, place = [], 0
        for i in range(1, shards):
            even = place + (lines.total - place) // (shards - i + 1)
            below, above = lines.floor(even, False), lines.ceil(even)
            cut = below if even - below <= above - even else above
            place = min(max(cut, earliest[i], place), lines.floor(place + capacity, False))
            cuts.append(place)
        if not lines.refine():
            return cuts


def _block_query(groups: DataFrame) -> Callable[[list], list]:
    def finer(stretches: list) -> list:
        inside = [F.col("end").between(low, high) for low, high, _ in stretches]
        which = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)])
        piece = F.coalesce(*[F.when(c, F.floor((F.col("end") - low) / width)) for c, (low, _, width) in zip(inside, stretches, strict=True)])
        low, high = min(s[0] for s in stretches), max(s[1] for s in stretches)
        found = groups.where(F.col("end").between(low, high)).select("end", which.alias("which"), piece.alias("piece"))
        blocks = found.where("which IS NOT NULL").groupBy("which", "piece").agg(F.min("end").alias("first"), F.max("end").alias("last"))
        return [(r["first"], r["last"]) for r in blocks.collect()]

    return finer


def place_groups(groups: DataFrame, shards: int, scratch: str) -> DataFrame:
    """``groups(digest, size)`` with ``shard``: contiguous stretches in digest order under the smallest capacity."""
    facts = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    rows, total, largest = facts
    keyed = groups.withColumn("key", digest_key(F.col("digest")))
    summed = running_totals(keyed, [], "key", ["digest"], "size", rows)
    summed = written(summed.select("digest", "before", (F.col("before") + F.col("size")).alias("end")), f"{scratch}/line")
    if not rows:
        return summed.select("digest", F.lit(0).alias("shard"))
    finer = _block_query(summed)
    lines = Boundaries(finer([(1, total, -(-total // BLOCKS))]), total, finer)
    cuts = even_cuts(lines, shards, smallest_capacity(lines, shards, largest))
    shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda cut: cut <= F.col("before"))) if cuts else F.lit(0)
    return summed.select("digest", shard.cast("int").alias("shard"))


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row for each row of ``docs``.

    Documents with equal texts are one group and never part. ``law`` is ``bytes``: the largest shard is as small as the
    order of the groups allows, and the others as even as that leaves room for. A group larger than an even share fills
    a shard of its own. ``slot`` counts from 0 without a gap within a shard, in hash-random order of ids; rows with equal
    ids are ordered by size and checksum. Null texts count as empty and have size 1. Null ids are hashed like a value.
    Other columns are ignored, and an empty input gives no rows.
    """
    scratch = scratch_dir(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = written(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("digest"),
            random_key("doc_id", seed).alias("slot_key"),
        ),
        f"{scratch}/sized",
    )
    groups = written(sized.groupBy("digest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), f"{scratch}/groups")
    rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    placed = sized.join(written(place_groups(groups, shards, scratch), f"{scratch}/placed"), "digest")
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "slot_key", F.lit(1).cast("bigint").alias("one"))
    slots = running_totals(placed, ["shard"], "slot_key", ["doc_id", "size", "text_crc32"], "one", rows, into="slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
