import random
import re
from collections import defaultdict

import pytest

from stowage.llm import mixing

SCHEMA = "doc_id bigint, text string, source string"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share out, stop what is over, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, full = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(target[s] for s in full)
        unit = left / sum(weight[s] for s in rest)
        for s in rest:
            target[s] = unit * weight[s]
        over = {s for s in rest if target[s] > most * sizes[s]}
        if not over:
            return target
        for s in over:
            target[s] = float(most * sizes[s])
        full |= over
        if len(full) == len(names):
            return target


def corpus(rng):
    rows = [(i, " ".join("w" for _ in range(rng.choice((0, 1, 7, 40)))), rng.choice(("b", "a", "z", None, "ä", ""))) for i in range(300)]
    rows += [(1000 + i, "x\ty \n z", "hot") for i in range(200)]
    rows += [(2000, None, "none"), (2001, "", "none"), (2002, "one two", "small"), (1000, "x\ty \n z", "hot"), (None, "q r", "a")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = corpus(random.Random(seed))
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "doc_id AS size", "source AS source_key", "1 AS key")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += count(text)
    targets = brute_targets(sizes)
    of = {(d, count(t)): s for d, t, s in rows}
    taken = defaultdict(int)
    for r in found:
        source = of[r.doc_id, r["size"]]
        taken[source] += r.taken
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source])
        assert 0 <= r.taken <= 2 * r["size"]
    for source, n in taken.items():
        assert n == round(targets[source])
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)


def test_seed_changes_the_choice(spark):
    docs = spark.createDataFrame(corpus(random.Random(3)), SCHEMA)
    assert {tuple(r) for r in mixing.mix(docs).collect()} != {tuple(r) for r in mixing.mix(docs, seed=9).collect()}


def test_documents_are_repeated_whole(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" if i else "t") for i in range(11)], SCHEMA).selectExpr("*", "1 AS before")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = defaultdict(int)
    for r in out.collect():
        copies[r.source] += 1
    target = brute_targets({"s": 40, "t": 4})
    assert copies["t"] == round(target["t"] / 4) and abs(copies["s"] - target["s"] / 4) <= 0.5


def test_empty_and_no_words(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    found = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], SCHEMA)).collect()
    assert {(r.doc_id, r["size"], r.taken, r.target) for r in found} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}
    assert mixing.mixed_documents(spark.createDataFrame([], SCHEMA)).count() == 0
