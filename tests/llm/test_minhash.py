import random

import pytest

from stowage.llm import minhash
from stowage.llm.components import components


def brute(rows):
    sets = {}
    for doc_id, text in rows:
        w = minhash.words(text or "")
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def edited(words, share, rng):
    return [rng.choice("pqrstuv") * rng.randint(1, 9) if rng.random() < share else w for w in words]


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    for share in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1):
        rows += [" ".join(edited(base, share, rng)) for _ in range(12)]
    for _ in range(40):
        own = [rng.choice(vocabulary) for _ in range(rng.choice((3, 10, 30, 200)))]
        rows.append(" ".join(own + passage))
        rows.append(" ".join(own).upper())
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(8):
        rows.append(" ".join(chain[6 * i :] + [rng.choice(vocabulary) for _ in range(6 * i)]))
    rows += ["", None, " \t\n", "one", "One", "one two three", "one two three four five", "ONE two three  four five"]
    rows += [" ".join(base)] * 5 + [" ".join(rng.choice(vocabulary) for _ in range(5000))]
    rng.shuffle(rows)
    return list(enumerate(rows, 3))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = minhash.near_duplicates(docs.withColumn("label", docs.doc_id)).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_chain_and_repeated_rows(spark):
    words = [f"a{i}" for i in range(60)]
    # Each is linked with the next, the ends with each other not.
    rows = [(i, " ".join(words[i * 4 : i * 4 + 40])) for i in range(5)]
    found = minhash.near_duplicates(spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string")).collect()
    assert len(found) == 7 and {r.component_id for r in found} == {0}


def test_nulls_and_empty(spark):
    schema = "doc_id bigint, text string"
    text = "a b c d e f"
    found = minhash.near_duplicates(spark.createDataFrame([(None, text), (4, text), (None, None)], schema)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(None, 2, None, True), (4, 2, 4, True), (None, 0, None, True)], key=repr)
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_rows_with_one_id(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "a b c d e f g"), (3, "q r s t u v w")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r.doc_id for r in found if r.kept].count(1) == 2
    assert len({r.component_id for r in found}) == 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (1, 2), (2, 1)]
    edges += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, found)) == sorted((n, find(n)) for n in parent)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_texts_and_sets_reach_python_in_small_batches(spark, monkeypatch):
    setting, limits, write = "spark.sql.execution.arrow.maxBytesPerBatch", [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, path: limits.append(spark.conf.get(setting)) or write(df, path))
    before = spark.conf.get(setting)
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, None)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert limits and set(limits) == {f"{minhash.BATCH_BYTES}b"}
    assert spark.conf.get(setting) == before
