import pytest

from stowage.errors import StowageError
from stowage.operators import checks
from stowage.operators.checks import Check, differing_rows, run_checks, select_checks


@pytest.fixture
def people(spark, database):
    rows = [(1, "a", 10), (2, "b", 20), (2, None, 30), (None, "c", None), (3, "a", 40)]
    spark.createDataFrame(rows, "id int, kind string, amount int").write.saveAsTable(f"{database}.people")
    spark.createDataFrame([(1,), (2,), (9,)], "key int").write.saveAsTable(f"{database}.known")
    return f"{database}.people"


def results(df):
    return {r.check: (r.status, r.violations) for r in df.collect()}


def test_every_kind_counts_its_violations(spark, people, database):
    suite = [
        Check("ids", "not_null", people, ("id",)),
        Check("both", "not_null", people, ("id", "kind")),
        Check("kinds", "accepted_values", people, ("kind",), ("a", "b")),
        Check("amounts", "predicate", people, sql="amount < 35"),
        Check("unique", "unique", people, ("id",)),
        Check("pairs", "unique", people, ("id", "kind")),
        Check("parents", "relationship", people, ("id",), to=f"{database}.known", to_columns=("key",)),
        Check("same", "same_content", people, to=people),
    ]
    assert results(run_checks(spark, suite, continue_on_failure=True)) == {
        "ids": ("FAIL", 1), "both": ("FAIL", 2), "kinds": ("FAIL", 1), "amounts": ("FAIL", 2), "unique": ("FAIL", 2),
        "pairs": ("PASS", 0), "parents": ("FAIL", 1), "same": ("PASS", 0),
    }


def test_errors_are_rows_and_do_not_hide_other_checks(spark, people):
    suite = [
        Check("bad column", "not_null", people, ("missing",)),
        Check("good", "not_null", people, ("kind",)),
        Check("no table", "unique", "nowhere.t", ("id",)),
        Check("no kind", "magic", people),
        Check("no sql", "predicate", people),
    ]
    found = results(run_checks(spark, suite, continue_on_failure=True))
    assert found == {
        "bad column": ("ERROR", None), "good": ("FAIL", 1), "no table": ("ERROR", None), "no kind": ("ERROR", None),
        "no sql": ("ERROR", None),
    }


def test_a_failure_stops_later_tables(spark, people, database):
    suite = [
        Check("first", "not_null", people, ("id",)),
        Check("later", "not_null", f"{database}.known", ("key",)),
        Check("last", "unique", people, ("id",)),
    ]
    assert results(run_checks(spark, suite)) == {"first": ("FAIL", 1), "later": ("NOT_RUN", None), "last": ("NOT_RUN", None)}


def test_selection_variables_sources_and_models(spark, people, database):
    suite = [
        Check("limit", "predicate", "people", sql="amount <= :top OR amount IS NULL", tags=("x",)),
        Check("other", "predicate", "people", sql="false", tags=("y",)),
        Check("prod", "predicate", "people", sql="false", tags=("x",), target="prod"),
        Check("built", "predicate", f"{database}.totals", sql="n = 1", tags=("x",), target="dev"),
    ]
    found = run_checks(
        spark, suite, continue_on_failure=True, tags=["x"], target="dev", variables={"top": 25, "unused": 1},
        sources={"people": people}, models={f"{database}.totals": f"SELECT id, count(*) AS n FROM {people} GROUP BY id"},
    )
    assert results(found) == {"limit": ("FAIL", 2), "built": ("FAIL", 1)}
    assert [c.name for c in select_checks(suite, ["y"])] == ["other"]


def test_rows_group_into_one_scan_per_table(spark, people):
    suite = [Check(str(i), "predicate", people, sql=f"amount <> {i}") for i in range(5)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checks", "checks")
    try:
        run_checks(spark, suite, continue_on_failure=True)
        assert len(tracker.getJobIdsForGroup("checks")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_differing_rows_counts_copies(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "x int, y string")
    right = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "x int, y string")
    found = {tuple(r) for r in differing_rows(left, right).collect()}
    assert found == {(1, "a", 2, 1), (3, "c", 1, 0), (4, "d", 0, 1)}
    with pytest.raises(StowageError):
        differing_rows(left, right.select("y", "x"))


def counted(df):
    return sorted(((*r[:-2],), r.left_rows, r.right_rows) for r in df.collect())


def test_differences_of_any_type_are_found(spark):
    schema = "a int, b string, c double, d array<string>, e struct<x: int, y: string>, f timestamp_ntz"
    rows = [
        (1, "x", 0.5, ["p", None], (1, "q"), None), (None, "1", 0.0, [], (None, "1"), None), (1, None, -0.0, None, None, None), (1, "x", 0.5, ["p", None], (1, "q"), None),
    ]
    left = spark.createDataFrame(rows, schema)
    assert differing_rows(left, left.orderBy("b")).isEmpty()
    for changed in (
        (1, "x", 0.5, [None, "p"], (1, "q"), None), (1, "x", 0.5, ["p"], (1, "q"), None), (1, "x", 0.5, ["p", None], (1, None), None),
        (1, "x", 0.5, ["p", None], None, None), (None, "x", 0.5, ["p", None], (1, "q"), None), (1, "x", None, ["p", None], (1, "q"), None),
    ):
        found = differing_rows(left, spark.createDataFrame([changed, *rows[1:]], schema)).collect()
        assert sorted((r.left_rows, r.right_rows) for r in found) == [(0, 1), (2, 1)], changed
    assert differing_rows(left, spark.createDataFrame([(1, None, 0.0, None, None, None), rows[0], rows[0], rows[1]], schema)).isEmpty()


def test_only_digests_and_unequal_rows_are_shuffled(spark):
    rows = spark.range(0, 30_000, 1, 4).selectExpr("id % 1000 AS k", "sha2(CAST(id AS STRING), 256) AS v")
    planted = rows.where("v <> sha2('77', 256)").unionByName(spark.sql("SELECT 5L AS k, 'new' AS v"))
    found = sorted((r.v == "new", r.left_rows, r.right_rows) for r in differing_rows(rows, planted).collect())
    assert found == [(False, 1, 0), (True, 0, 1)]
    assert differing_rows(rows, rows.repartition(7)).isEmpty()
    everything = differing_rows(rows, spark.createDataFrame([], rows.schema))
    assert everything.count() == 30_000 and everything.agg({"right_rows": "max"}).first()[0] == 0


def test_rows_are_shuffled_once_and_hashes_summed_as_whole_numbers(spark, monkeypatch):
    sums, unequal = [], checks._unequal
    monkeypatch.setattr(checks, "_unequal", lambda rows, *buckets: sums.append(unequal(rows, *buckets)) or sums[-1])
    rows = spark.range(0, 2000, 1, 4).selectExpr("id AS k", "sha2(CAST(id AS STRING), 256) AS v")
    planted = rows.where("k % 10 <> 3").unionByName(rows.where("k % 10 = 4"))
    found = differing_rows(rows, planted)
    assert sorted((r.k, r.left_rows, r.right_rows) for r in found.collect()) == sorted(
        [(k, 1, 0) for k in range(3, 2000, 10)] + [(k, 1, 2) for k in range(4, 2000, 10)]
    )
    assert all("decimal" not in kind for s in sums for _, kind in s.dtypes)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert not any("hashpartitioning(row#" in line for line in plan.splitlines())
