import pytest

from stowage.llm import members


def table(spark, n):
    rows = spark.range(n).selectExpr("concat('t', id) AS text", "id AS doc_id")
    return rows.unionByName(spark.sql("SELECT 'x' AS text, CAST(NULL AS BIGINT) AS doc_id"))


def test_all_members_and_few_others(spark):
    rows = table(spark, 20_000)
    ids = spark.range(0, 20_000, 40).selectExpr("-id AS doc_id").unionByName(spark.range(0, 20_000, 40).selectExpr("id AS doc_id"))
    one = members.Filter.of(ids)
    found = members.passing(rows, (one, True))
    assert found.columns == rows.columns
    kept = [r.doc_id for r in found.collect()]
    assert set(range(0, 20_000, 40)) <= set(kept) and len(kept) < 600 and None not in kept
    rest = [r.doc_id for r in members.passing(rows, (one, False)).collect()]
    assert sorted(kept + rest) == list(range(20_000))
    none = members.Filter.of(ids.limit(0))
    assert members.passing(rows, (none, True)).count() == 0


@pytest.mark.parametrize("most", [27, 14, 12, 6])
def test_exact_members(spark, monkeypatch, tmp_path, most):
    # 6 leaves a filter of 64 bits that lets everything through, 12 one that lets much through.
    monkeypatch.setattr(members, "LEAST_BITS", 6)
    monkeypatch.setattr(members, "MOST_BITS", most)
    rows, ids = table(spark, 5000), spark.range(0, 5000, 3).selectExpr("id AS doc_id")
    found = members.exactly_among(rows, ids, f"{tmp_path}/{most}")
    assert sorted(r.doc_id for r in found.collect()) == list(range(0, 5000, 3)) and found.columns == rows.columns
