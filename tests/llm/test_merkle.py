import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stowage.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(row, text=None):
    values = [*row[:4], row[4] if text is None else text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Root, and for each leaf what stands before and after its path at every level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // 16 * 16 :][:16]
            paths[i].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
            at[i] = place // 16
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in sources]
    trees = [tree([leaf_of(r) for r in g]) for g in groups]
    root, upper = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for group, (subroot, paths), above in zip(groups, trees, upper, strict=True):
        for row, path in zip(group, paths, strict=True):
            marked = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            now = leaf_of(row, row[4].translate({i: i + 32 for i in range(65, 91)}) if marked else None)
            for before, after in path + above:
                now = sha(before, now, after)
            proof = sha(*(a + b for a, b in path + above))
            out.append((row[0], leaf_of(row), subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, merkle.verification(df).collect()), key=str)


ODD = [
    (1, None, None, None, None), (2, None, "", 0, ""), (None, "b", "de", 1, "x"), (None, "b", "de", 1, "x"), (3, "b", "de", 1, "É A\n"),
    (3, "b", "de", 1, "É A\n"), (-4, "é", "-", None, "Z" * 100_000), (5, "", None, 7, "AB"), (5, "", None, 7, "ab"),
]


def test_odd_rows(spark):
    assert found(spark.createDataFrame(ODD, SCHEMA)) == brute(ODD)


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257])
def test_widths_of_trees(spark, n):
    rows = [(i, "a", "en", i, f"Text {i}") for i in range(n)] + [(i, f"s{i:03d}", "en", 1, "T") for i in range(min(n, 40))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_several_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 1)
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(900)] + [(i, f"t{i}", None, None, None) for i in range(20)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_proofs_lead_to_the_root(spark, data):
    rows = merkle.manifest(data(spark, "documents"), carry={"n": F.col("n_chars")})
    wrong = rows.where((merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")) | F.col("n").isNull())
    assert wrong.isEmpty() and rows.count() == data(spark, "documents").count()


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == []
    rows = [(i, "a", "en", i, "x") for i in range(20)]
    clash = spark.createDataFrame(rows, SCHEMA)
    for name in ("grp", "rank", "levels", "place", "digest", "item", "block", "proof", "root"):
        clash = clash.withColumn(name, F.lit("mine"))
    assert found(clash) == brute(rows)
