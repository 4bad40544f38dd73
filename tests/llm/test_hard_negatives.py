import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import hard_negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>"


def brute(rows, step):
    """By set of (id, score), as rows that repeat both count once."""
    valid = {(r[0], r[1], tuple(r[2])) for r in rows if None not in r and r[2] and all(x is not None and math.isfinite(x) for x in r[2])}
    valid = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in valid]
    out = []
    for anchor in {r[0] for r in valid if r[0] % step == 0}:
        _, label, v = min(r for r in valid if r[0] == anchor)
        score = lambda r: sum(a * b for a, b in zip(v, r[2], strict=True))  # noqa: B023, E731
        others = {(-score(r), r[1] != label, r[0]) for r in valid if r[0] != anchor and len(r[2]) == len(v)}
        same, different = (sorted((s, i) for s, d, i in others if d == kind) for kind in (False, True))
        for p, positive in same[:5]:
            fits = [(n, i) for n, i in different if 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(anchor, positive, k + 1, i, -p, -n) for k, (n, i) in enumerate(fits)]
    return sorted(out)


def found(df, step, **options):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % step == 0, **options).collect()))


def some_rows():
    rng = np.random.default_rng(3)
    return [(i, int(rng.integers(0, 3)), (rng.integers(-2, 3, size=4) / 2 + 0.0).tolist()) for i in range(300)]


ODD = [
    (500, 0, None), (550, None, [1.0] * 4), (None, 1, [1.0] * 4), (600, 1, [math.inf] * 4), (650, 1, [None, 1.0, 1.0, 1.0]), (660, 1, [math.nan] * 4),
    (700, 1, []), (750, 2, [0.0] * 4), (800, 2, [1.0]), (805, 2, [3.0]), (806, 1, [2.0]), (810, 1, [-0.001, 0.001, 1.0, 1.0]),
]


@pytest.mark.parametrize("block", [16, 2048])
def test_equals_brute_force(spark, block):
    rows = some_rows()
    rows += [*ODD, rows[7], rows[7], rows[0], (7, 1, [1.0, 0.5, 1.0, -0.5]), (10, 2, [1.0, 0.5, 1.0, 1.0])]
    assert found(spark.createDataFrame(rows, SCHEMA), 5, block=block) == brute(rows, 5)


def test_small_pieces_and_ties(spark, monkeypatch):
    rows = [(i, i % 2, [1.0 if i % 3 else 0.8, 0.0]) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark.createDataFrame(rows, SCHEMA), 10) == brute(rows, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_sort_as_pairs_do():
    pairs = [(a, s, k, i) for a in (-3, 0, 7) for s in (-(2**40), -1, 0, 5) for k in (0, 1) for i in (-9, 2, 2**50)]
    keys = sorted(hard_negatives.pack(*p) for p in pairs)
    assert [hard_negatives.unpack(k) for k in keys] == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_windows():
    for score in range(-500, 500):
        low, high = hard_negatives.window(score)
        assert [s for s in range(-600, 600) if 50 * score <= 100 * s <= 95 * score] == list(range(low, high + 1))


def test_products_are_exact():
    a = np.array([[2.0**30 - 1, 3.0], [-(2.0**30), 1.0]])
    assert hard_negatives.products(a, a).tolist() == [[int(x[0]) * int(y[0]) + int(x[1]) * int(y[1]) for y in a] for x in a]


def test_empty_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA), 5) == []
    rows = some_rows()[:60]
    clash = spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], SCHEMA + ", windows string, block string, turn string")
    assert found(clash, 5) == brute(rows, 5)
