from collections import Counter

import numpy as np
import pytest

from stowage.llm import cross_polytope

SCHEMA = "vec_id bigint, label int, embedding array<double>"


def brute(rows, least=cross_polytope.LEAST):
    links, parent = [0] * len(rows), list(range(len(rows)))
    valid = [r[0] is not None and r[1] is not None and bool(r[2]) and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2]) for r in rows]

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if not (valid[i] and valid[j]):
                continue
            x, y = (np.array(r[2]) / np.abs(r[2]).max() for r in (a, b))
            linked = a[1] == b[1] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least
            if linked:
                links[i], links[j] = links[i] + 1, links[j] + 1
            if linked or a[0] == b[0]:
                parent[top(i)] = top(j)
    least_id = {}
    for i, r in enumerate(rows):
        if valid[i]:
            least_id[top(i)] = min(least_id.get(top(i), r[0]), r[0])
    component = [least_id[top(i)] if valid[i] else r[0] for i, r in enumerate(rows)]
    return Counter((r[0], links[i], component[i], r[0] == component[i]) for i, r in enumerate(rows))


def clusters(width=16):
    rng, rows = np.random.default_rng(1), []
    for i in range(120):
        centre = rng.normal(size=width)
        rows.append((i, i % 3, centre.tolist()))
        rows += [(1000 + 5 * i + k, i % 3, (centre + 0.15 * rng.normal(size=width)).tolist()) for k in range(i % 4)]
    return rows


ODD = [
    (5000, 1, None), (5001, None, [1.0] * 16), (None, 1, [1.0] * 16), (5002, 1, [0.0] * 16), (5003, 1, [float("nan")] * 16),
    (5004, 1, [1.0, None] + [0.0] * 14), (5005, 1, []), (5006, 1, [1.0]), (5007, 1, [2.0]), (5008, 1, [-1.0]), (5009, 1, [float("inf")] * 16),
    (5010, 2, [1e308] * 16), (5011, 2, [1e-300] * 16), (5012, 0, [1.0] * 16),
]


@pytest.mark.parametrize("block", [3, 2048])
def test_equals_brute_force(spark, block):
    rows = clusters()
    rows += ODD + [rows[0]] * 3 + [(7000, *rows[0][1:])] * 2 + [(0, 2, rows[5][2])]
    found = cross_polytope.near_vectors(spark.createDataFrame(rows, SCHEMA), block=block)
    assert Counter(map(tuple, found.collect())) == brute(rows)


def test_a_large_group_of_near_copies_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    rows = [(i, 0, (centre + 0.02 * rng.normal(size=8)).tolist()) for i in range(150)] + [(200 + i, 0, centre.tolist()) for i in range(50)]
    found = cross_polytope.near_vectors(spark.createDataFrame(rows, SCHEMA), block=16).collect()
    assert {tuple(r)[1:3] for r in found} == {(199, 0)} and sum(r.kept for r in found) == 1


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1)[:, None]
    x, y = cross_polytope.codes(a), cross_polytope.codes(b)
    met = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any(axis=(1, 2))
    assert met.mean() > 0.99


def test_rotation_keeps_angles():
    rng = np.random.default_rng(4)
    x, signs = rng.normal(size=(20, 32)), rng.choice((-1.0, 1.0), (3, 32))
    turned = cross_polytope.rotated(x, signs) / 32**1.5
    assert np.allclose(turned @ turned.T, x @ x.T)


def test_empty_and_clashing_columns(spark):
    assert cross_polytope.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = clusters()[:20]
    clash = spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], SCHEMA + ", key string, rep string, own string")
    assert Counter(map(tuple, cross_polytope.near_vectors(clash).collect())) == brute(rows)
