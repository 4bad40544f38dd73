import hashlib
import os

from pyspark.sql.classic.dataframe import DataFrame

from stowage.llm.exact_dedup import DigestIndex, deduplicate

SCHEMA = "doc_id bigint, text string"


def digest(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return hashlib.sha256(folded.encode()).hexdigest()


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "text AS digest", "doc_id AS keep_id")
    found = deduplicate(DigestIndex.create(spark), docs).collect()
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(digest(text), []).append(doc_id)
    expected = []
    for doc_id, text in rows:
        ids = groups[digest(text)]
        keep = max((i for i in ids if i is not None), default=None)
        expected.append((doc_id, keep, len(ids), doc_id == keep, digest(text)))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_groups(spark):
    check(spark, [(1, "Aa"), (2, "aA"), (3, "Ä"), (4, "ä"), (5, None), (6, ""), (7, " "), (8, "x" * 300_000), (9, "X" * 300_000)])


def test_hot_group_and_repeated_rows(spark):
    check(spark, [(i, "same") for i in range(300)] + [(299, "same"), (299, "other"), (1, "other")])


def test_null_ids(spark):
    check(spark, [(None, "a"), (3, "A"), (None, "b"), (None, "B")])


def test_empty(spark):
    index = DigestIndex.create(spark)
    assert deduplicate(index, spark.createDataFrame([], SCHEMA)).count() == 0
    assert index.rows().count() == 0


def test_index_persists_over_batches(spark):
    index = DigestIndex.create(spark, buckets=4)
    deduplicate(index, spark.createDataFrame([(5, "a"), (6, "b")], SCHEMA))
    second = deduplicate(DigestIndex(spark, index.table, 4), spark.createDataFrame([(1, "A"), (9, "a"), (7, "c")], SCHEMA)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in second} == {(1, 5, 2, False), (9, 5, 2, False), (7, 7, 1, True)}
    assert {(r.digest, r.keep_id) for r in index.rows().collect()} == {(digest("a"), 5), (digest("b"), 6), (digest("c"), 7)}
    index.drop()


def test_index_is_bucketed_and_not_shuffled(spark):
    index = DigestIndex.create(spark, buckets=4)
    fresh = spark.range(100).selectExpr("sha2(CAST(id AS STRING), 256) AS digest", "id AS keep_id")
    index.append(fresh)
    plan = index.unseen(fresh)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    scan = [line for line in plan.splitlines() if "FileScan" in line and index.table in line]
    assert len(scan) == 1 and "Bucketed: true" in scan[0]
    assert plan.count("Exchange hashpartitioning") == 1
    files = [f for f in index.rows().inputFiles() if os.path.basename(f).startswith("part-")]
    assert len(files) <= 4


def test_one_file_for_each_bucket_whatever_the_number_of_tasks(spark, monkeypatch):
    dealt = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *cols: dealt(self, max(n, 45), *cols))
    index = DigestIndex.create(spark, buckets=4)
    docs = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 1500 AS string) AS text")
    assert deduplicate(index, docs).where("kept").count() == 1500
    files = [f.rsplit("/", 1)[-1] for f in index.rows().inputFiles()]
    assert len(files) == 4 and index.rows().count() == 1500
    index.drop()
