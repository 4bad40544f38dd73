import random
import zlib
from collections import defaultdict

import pytest

from stowage.llm import sharding

SCHEMA = "doc_id bigint, text string"


class Known(sharding.Boundaries):
    """Boundaries over a plain list, known in coarse blocks at first."""

    def __init__(self, ends, blocks):
        self.ends = ends
        super().__init__(self._blocks([(1, ends[-1], -(-ends[-1] // blocks))]), ends[-1], self._blocks)

    def _blocks(self, stretches):
        out = []
        for low, high, width in stretches:
            pieces = defaultdict(list)
            for e in self.ends:
                if low <= e <= high:
                    pieces[(e - low) // width].append(e)
            out += [(min(p), max(p)) for p in pieces.values()]
        return out


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, filled = (low + high) // 2, 1, 0
        for s in sizes:
            if filled + s > middle:
                used, filled = used + 1, 0
            filled += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed", range(25))
def test_capacity_and_cuts(seed):
    rng = random.Random(seed)
    sizes = [rng.choice((1, 2, 5, 30, rng.randint(1, 500))) for _ in range(rng.randint(1, 400))]
    if seed % 3 == 0:
        sizes[rng.randrange(len(sizes))] = sum(sizes) // 2 + 1
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    shards = rng.choice((1, 2, 7, 16))
    lines = Known(ends, rng.choice((1, 4, 50)))
    capacity = sharding.smallest_capacity(lines, shards, max(sizes))
    assert capacity == brute_capacity(sizes, shards)
    cuts = sharding.even_cuts(lines, shards, capacity)
    edges = [0, *cuts, total]
    assert len(cuts) == shards - 1 and edges == sorted(edges) and set(cuts) <= {0, *ends}
    assert max(b - a for a, b in zip(edges[:-1], edges[1:])) <= capacity


def check(spark, rows, shards):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "doc_id AS size", "text AS digest", "1 AS shard")
    found = sharding.assign_shards(docs, shards).collect()
    assert len(found) == len(rows)
    groups, slots, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    text_of = {}
    for doc_id, text in rows:
        text_of[doc_id, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())] = text or ""
    for r in found:
        groups[text_of[r.doc_id, r["size"], r.text_crc32]].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_even_shards(spark):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randint(0, 200)) for i in range(1500)] + [(i, "t" * rng.randint(0, 99) + str(i)) for i in range(1500, 3000)]
    sizes = check(spark, rows, 16)
    assert len(sizes) == 16 and max(sizes.values()) < 1.2 * min(sizes.values())


def test_hot_group_nulls_and_repeats(spark):
    rows = [(i, "copy " * 5) for i in range(400)] + [(1000 + i, f"text {i}") for i in range(700)]
    rows += [(5000, None), (5001, ""), (5000, None), (None, "no id"), (6000, "long" * 50_000)]
    check(spark, rows, 16)


def test_few_and_none(spark):
    assert check(spark, [(1, "a")], 16) == {15: 2}
    assert sharding.assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0
