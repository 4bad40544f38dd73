import datetime

import pytest
from conftest import same_rows

from stowage.errors import StowageError
from stowage.operators import incremental, views
from stowage.operators import partitions as parts
from stowage.operators.tables import drop_object, write_table

AGGREGATES = {
    "n": ("count", "*"), "known": ("count", "value"), "total": ("sum", "CAST(value * 100 AS DECIMAL(18, 0))"), "low": ("min", "value"),
    "high": ("max", "ts"), "mean": ("avg", "CAST(user_id AS DECIMAL(18, 0))"),
}


def recomputed(spark, base, where="value > 5"):
    return spark.sql(
        f"SELECT event_type, count(*) AS n, count(value) AS known, sum(CAST(value * 100 AS DECIMAL(18, 0))) AS total, min(value) AS low, max(ts) AS high, "
        f"avg(CAST(user_id AS DECIMAL(18, 0))) AS mean FROM {base} WHERE {where} GROUP BY event_type"
    )


@pytest.mark.parametrize("partition", [None, parts.time_partition("ts", "DAY"), parts.column_partition("event_type")])
def test_appends_and_deletions_equal_a_recompute(spark, database, data, partition):
    events, base, view = data(spark, "events"), f"{database}.events", f"{database}.by_type"
    write_table(spark, base, events.where("event_id % 3 = 0"), partition)
    incremental.create_incremental_view(spark, view, base, ["event_type"], AGGREGATES, "value > 5")
    same = lambda: sorted(map(str, spark.table(view).drop("mean").collect())) == sorted(map(str, recomputed(spark, base).drop("mean").collect()))
    assert same()
    write_table(spark, base, events.where("event_id % 3 = 1"), mode="append")
    assert not same()
    before = len(spark.table(base).inputFiles())
    found = incremental.refresh_incremental(spark, view)
    assert same() and found["dropped"] == 0 and 0 < found["added"] < before
    assert incremental.refresh_incremental(spark, view) == {"added": 0, "dropped": 0}
    means = [{r.event_type: round(float(r["mean"]), 4) for r in df.collect()} for df in (spark.table(view), recomputed(spark, base))]
    assert means[0] == means[1]
    write_table(spark, base, spark.table(base).where("event_id % 2 = 0"), partition, mode="overwrite")
    found = incremental.refresh_incremental(spark, view)
    assert same() and found["dropped"] and found["added"]
    log = incremental.change_log(spark, view)
    assert {r.action for r in log.select("action").distinct().collect()} == {"ADDED", "DROPPED"}
    drop_object(spark, database, "by_type")
    assert [t.name for t in spark.catalog.listTables(database) if t.name.startswith("by_type")] == []


def test_only_new_files_are_scanned(spark, database, data, monkeypatch):
    base, view = f"{database}.events", f"{database}.counts"
    write_table(spark, base, data(spark, "events"))
    incremental.create_incremental_view(spark, view, base, [], {"n": ("count", "*")})
    scanned, states = [], incremental._states
    monkeypatch.setattr(incremental, "_states", lambda files, spec: scanned.append(files.count()) or states(files, spec))
    write_table(spark, base, data(spark, "events").limit(7), mode="append")
    incremental.refresh_incremental(spark, view)
    assert scanned == [7] and spark.table(view).first().n == data(spark, "events").count() + 7


def test_a_refresh_cut_off_counts_nothing_twice(spark, database, data, monkeypatch):
    base, view = f"{database}.events", f"{database}.counts"
    write_table(spark, base, data(spark, "events"))
    incremental.create_incremental_view(spark, view, base, ["event_type"], {"n": ("count", "*")})
    write_table(spark, base, data(spark, "events"), mode="append")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(incremental, "_log_rows", lost)
        with pytest.raises(RuntimeError):
            incremental.refresh_incremental(spark, view)
    incremental.refresh_incremental(spark, view)
    assert same_rows(spark.table(view).orderBy("event_type"), spark.sql(f"SELECT event_type, count(*) AS n FROM {base} GROUP BY event_type ORDER BY 1"))


def test_refresh_by_interval_and_errors(spark, database, data):
    base, view = f"{database}.events", f"{database}.counts"
    write_table(spark, base, data(spark, "events"))
    at = datetime.datetime(2024, 1, 1)
    incremental.create_incremental_view(spark, view, base, [], {"n": ("count", "*")}, as_of=at, refresh_interval_seconds=3600)
    write_table(spark, base, data(spark, "events").limit(3), mode="append")
    assert not views.refresh_materialized(spark, view, at + datetime.timedelta(minutes=59))
    assert spark.table(view).first().n == 1000 * 1 and views.refresh_materialized(spark, view, at + datetime.timedelta(hours=1))
    assert spark.table(view).first().n == 1003
    with pytest.raises(StowageError):
        incremental.create_incremental_view(spark, f"{database}.other", base, [], {"n": ("median", "value")})
    with pytest.raises(StowageError):
        views.create_view(spark, f"{database}.plain", f"SELECT * FROM {base}")
        incremental.refresh_incremental(spark, f"{database}.plain")
