import datetime
import json

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from stowage.errors import ObjectExists, SnapshotIncomplete, StowageError, VersionMismatch
from stowage.functions import routines
from stowage.operators import partitions as parts
from stowage.operators import views
from stowage.operators.tables import load_table, read_table, snapshot_table, write_table
from stowage.plans.archive import archive_dataset, snapshot_of
from stowage.plans.restore import restore_dataset
from stowage.session import small_frame
from stowage.sources import catalog, layout, manifest, schemas
from stowage.sources.formats import FileFormat


def archive(spark, database, tmp_path, **options):
    return snapshot_of(archive_dataset(spark, database, str(tmp_path / "archive"), **options))


def statuses(df):
    return {(r.kind, r.name): r.status for r in df.collect()}


@pytest.fixture
def fixture_database(spark, database):
    """The shapes of FIXTURES.md part A."""
    spark.sql(f"ALTER DATABASE {database} SET DBPROPERTIES ('site' = 'plant')")
    days = spark.sql("SELECT id, concat('n', id) AS name, date_add(date'2024-01-01', CAST(id % 5 AS INT)) AS day FROM range(50)")
    write_table(spark, f"{database}.by_day", days, parts.time_partition("day", "DAY"), "by day", {"grain": "daily"})
    ids = spark.sql("SELECT id - 20 AS meter, 'x' AS name FROM range(150)")
    write_table(spark, f"{database}.by_meter", ids, parts.range_partition("meter", 0, 100, 10))
    readings = spark.sql("SELECT id, concat('g', id) AS name, timestamp_ntz'2024-03-10 02:30:00.000001' AS local_time, "
                        "timestamp'2024-03-10 02:30:00Z' AS seen_at FROM range(10)")
    write_table(
        spark, f"{database}.readings", readings, description="readings", labels={"unit": "kwh"},
        schema=schemas.annotate(readings.schema, ["id"], {"name": "it's a name"}, {"name": "'none'"}),
    )
    returns = "STRUCT<head: STRING, whole: STRING>"
    routines.create_function(
        spark, database, "split_pair", "pair STRING", returns, "named_struct('head', split(pair, '-')[0], 'whole', pair)", "tags"
    )
    routines.create_function(spark, database, "per_unit", "x BIGINT, y BIGINT DEFAULT 2", "DOUBLE", "x / y")
    routines.create_function(spark, database, "a_rate", "x BIGINT", "DOUBLE", f"{database}.per_unit(x, 3L) + {database}.per_unit(x)")
    routines.create_script(
        spark, database, "add_reading",
        f"BEGIN DECLARE nm STRING; SET nm = uuid(); INSERT INTO {database}.readings (id) VALUES (:id); "
        "SELECT format_string('added %s', nm) AS m; END", [{"name": "id", "type": "bigint"}], "adds a row",
    )
    views.create_view(spark, f"{database}.z_fixed", "SELECT CAST(3 AS BIGINT) AS id, 'fixed' AS name", description="one row", labels={"role": "v"})
    views.create_view(
        spark, f"{database}.all_names",
        f"SELECT * EXCEPT (local_time, seen_at) FROM spark_catalog.{database}.readings UNION ALL "
        f"SELECT * EXCEPT (day) FROM {database}.by_day UNION ALL SELECT * FROM z_fixed",
    )
    views.create_view(spark, f"{database}.a_top", "SELECT id, a_rate(id) AS v FROM all_names")
    views.create_view(spark, f"{database}.heads", f"SELECT `{database}`.split_pair('7-x').head AS id")
    views.create_materialized_view(
        spark, f"{database}.daily_counts", "SELECT day, count(*) AS n FROM by_day GROUP BY day",
        True, 3700, parts.time_partition("day", "MONTH"), "mat", {"speed": "v"},
    )
    return database


def test_whole_database_moves(spark, fixture_database, target, tmp_path):
    status = archive_dataset(
        spark, fixture_database, str(tmp_path / "archive"), concurrency=4,
        table_data_archive_format_mapping={"readings": "csv", "by_meter": "csv"},
    )
    assert set(statuses(status).values()) == {"OK"}, [tuple(r)[:5] for r in status.filter("status = 'FAILED'").collect()]
    spark.sql("SET TIME ZONE 'America/New_York'")
    try:
        result = restore_dataset(spark, snapshot_of(status), target, concurrency=4)
        assert set(statuses(result).values()) == {"OK"}, result.collect()
    finally:
        spark.sql("SET TIME ZONE 'UTC'")
    for name in ("by_day", "by_meter", "readings", "all_names", "a_top", "heads", "daily_counts", "z_fixed"):
        old, new = spark.table(f"{fixture_database}.{name}"), spark.table(f"{target}.{name}")
        assert same_rows(old, new), name
        assert described_columns(old) == described_columns(new), name
    assert spark.table(f"{fixture_database}.readings").schema.json() == spark.table(f"{target}.readings").schema.json()

    # Nothing depends on the source any more.
    spark.sql(f"DROP DATABASE {fixture_database} CASCADE")
    assert spark.table(f"{target}.a_top").count() == 61
    assert spark.sql(f"SELECT {target}.a_rate(2L)").first()[0] == pytest.approx(2 / 3 + 1)

    described = catalog.describe(spark, target, "readings")
    assert described["comment"] == "readings"
    assert catalog.labels_of(described) == {"unit": "kwh", "archive_ts": layout_ts(status)}
    assert catalog.required_of(catalog.properties_of(described)) == ["id"]
    assert catalog.describe_database(spark, target)["labels"]["site"] == "plant"
    assert catalog.describe_function(spark, target, "split_pair")["description"] == "tags"
    mat = catalog.properties_of(catalog.describe(spark, target, "daily_counts"))
    assert mat[catalog.REFRESH_INTERVAL] == "3660" and mat[catalog.ENABLE_REFRESH] == "true"
    assert "MONTH" in mat[catalog.PARTITION]
    pruned = read_table(spark, f"{target}.by_meter", [("meter", "=", 42)])
    assert [r.meter for r in pruned.collect()] == [42]
    message = routines.run_script(spark, f"{target}.add_reading", id=99).first().m
    assert message.startswith("added ")
    row = spark.table(f"{target}.readings").filter("id = 99").first()
    assert row.name == "none" and row.local_time is None


def described_columns(df):
    return [(f.name, f.dataType.simpleString(), f.metadata.get("comment")) for f in df.schema]


def layout_ts(status):
    return snapshot_of(status).rpartition("=")[2]


def test_existing_objects_are_kept_unless_overwritten(spark, fixture_database, target, tmp_path):
    snapshot = archive(spark, fixture_database, tmp_path)
    restore_dataset(spark, snapshot, target, attach_archive_ts_to_label=False)
    assert "archive_ts" not in catalog.labels_of(catalog.describe(spark, target, "readings"))
    again = restore_dataset(spark, snapshot, target, continue_on_failure=True)
    found = {r.name: (r.status, r.error or "") for r in again.collect()}
    for name in ("readings", "by_day", "z_fixed", "daily_counts", "per_unit", "add_reading"):
        assert found[name][0] == "FAILED" and "ObjectExists" in found[name][1], name
    assert found["a_top"][0] == "BLOCKED"
    assert spark.table(f"{target}.by_day").count() == 50

    appended = restore_dataset(spark, snapshot, target, continue_on_failure=True, append=True)
    assert statuses(appended)["table", "by_day"] == "OK"
    assert spark.table(f"{target}.by_day").count() == 100
    assert spark.table(f"{target}.readings").count() == 20

    over = restore_dataset(spark, snapshot, target, overwrite_existing=True)
    assert set(statuses(over).values()) == {"OK"}, [tuple(r) for r in over.filter("error is not null").collect()]
    assert spark.table(f"{target}.by_day").count() == 50


def test_first_failure_stops_the_run(spark, fixture_database, target, tmp_path):
    snapshot = archive(spark, fixture_database, tmp_path)
    spark.sql(f"CREATE DATABASE {target}")
    write_table(spark, f"{target}.by_day", spark.range(1))
    found = statuses(restore_dataset(spark, snapshot, target))
    assert found["table", "by_day"] == "FAILED"
    assert found["table", "readings"] == found["view", "a_top"] == found["function", "a_rate"] == "NOT_RUN"


def test_skipped_objects_count_as_done(spark, fixture_database, target, tmp_path):
    snapshot = archive(spark, fixture_database, tmp_path)
    found = statuses(
        restore_dataset(spark, snapshot, target, continue_on_failure=True, skip_restore={"z_fixed": True, "readings": False})
    )
    assert found["view", "z_fixed"] == "SKIPPED"
    # Spark analyses one row when it is created, so one row over a skipped one fails and blocks its own dependents.
    assert found["view", "all_names"] == "FAILED"
    assert found["view", "a_top"] == "BLOCKED"
    assert found["view", "heads"] == "OK"


def test_blocked_rows_name_the_failure(spark, database, target, tmp_path):
    write_table(spark, f"{database}.t", spark.range(3))
    views.create_view(spark, f"{database}.broken", f"SELECT * FROM {database}.t")
    views.create_view(spark, f"{database}.over", "SELECT * FROM broken")
    views.create_view(spark, f"{database}.top", "SELECT * FROM over")
    snapshot = archive(spark, database, tmp_path)
    result = restore_dataset(spark, snapshot, target, continue_on_failure=True, table_replacement_mapping={f"{database}.t": "no.such"})
    found = {r.name: r for r in result.collect()}
    assert found["broken"].status == "FAILED"
    assert found["over"].status == found["top"].status == "BLOCKED"
    assert found["top"].error == f"depends on failed relation spark_catalog.{target}.broken"


def test_names_resolve_where_the_view_was_created(spark, database, target, tmp_path):
    other = f"{database}_other"
    spark.sql(f"CREATE DATABASE {other}")
    try:
        write_table(spark, f"{other}.t", spark.range(5))
        write_table(spark, f"{database}.t", spark.range(2))
        views.create_view(spark, f"{database}.elsewhere", "SELECT * FROM t", namespace=other)
        views.create_view(spark, f"{database}.here", "SELECT * FROM t")
        restore_dataset(spark, archive(spark, database, tmp_path), target)
        assert spark.table(f"{target}.elsewhere").count() == 5
        assert spark.table(f"{target}.here").count() == 2
    finally:
        spark.sql(f"DROP DATABASE {other} CASCADE")


def test_user_mapping_moves_other_references(spark, database, target, tmp_path):
    write_table(spark, f"{database}.t", spark.range(4))
    views.create_view(spark, f"{database}.v", f"SELECT * FROM {database}.t")
    snapshot = archive(spark, database, tmp_path)
    mapping = {"unused": "x"}
    restore_dataset(spark, snapshot, target, statement_replacement_mapping=mapping)
    assert mapping == {"unused": "x"}
    assert spark.table(f"{target}.v").count() == 4


def test_required_columns_are_checked_while_loading(spark, database, target, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "id bigint, name string")
    with pytest.raises(Exception, match="required column id holds NULL"):
        write_table(spark, f"{database}.t", df, schema=schemas.annotate(df.schema, ["id"]))
    assert not spark.catalog.tableExists(f"{database}.t")

    good = df.filter("id is not null")
    write_table(spark, f"{database}.t", good, schema=schemas.annotate(good.schema, ["id"]))
    with pytest.raises(Exception, match="required column id holds NULL"):
        write_table(spark, f"{database}.t", df, mode="append")
    assert spark.table(f"{database}.t").count() == 1
    # A NULL that slipped in by plain SQL is caught by the restore.
    spark.sql(f"INSERT INTO {database}.t VALUES (NULL, 'c')")
    found = restore_dataset(spark, archive(spark, database, tmp_path), target, continue_on_failure=True).filter("kind = 'table'").first()
    assert found.status == "FAILED"
    assert not spark.catalog.tableExists(f"{target}.t")


def test_broken_and_foreign_snapshots_are_refused(spark, database, target, tmp_path):
    write_table(spark, f"{database}.t", spark.range(4))
    snapshot = archive(spark, database, tmp_path, archive_ts="20240101000000")
    with pytest.raises(SnapshotIncomplete):
        restore_dataset(spark, snapshot.replace("20240101000000", "20230101000000"), target)

    rows = [r.asDict(recursive=True) for r in manifest.read_manifest(spark, snapshot).collect()]

    def rewritten(ts, change):
        changed = [change(dict(r)) for r in rows]
        path = layout.snapshot_path(str(tmp_path / "archive"), "spark_catalog", database, ts)
        changed = [r for r in changed if r is not None]
        small_frame(spark, [tuple(r[n] for n in manifest.OBJECT_SCHEMA.names) for r in changed], manifest.OBJECT_SCHEMA).write.json(
            f"{path}/{layout.MANIFEST}"
        )
        return path

    with pytest.raises(SnapshotIncomplete, match="1 of 2"):
        restore_dataset(spark, rewritten("20240102000000", lambda r: r if r["kind"] == "dataset" else None), target)
    with pytest.raises(VersionMismatch, match="v2"):
        restore_dataset(spark, rewritten("20240103000000", lambda r: {**r, "metadata_version": "v2"}), target)
    assert not spark.catalog.databaseExists(target)


def test_failed_archive_leaves_no_manifest(spark, database, tmp_path):
    write_table(spark, f"{database}.nested", spark.range(2).select(F.array("id").alias("a")))
    write_table(spark, f"{database}.plain", spark.range(2))
    prefix = str(tmp_path / "archive")
    options = {"table_data_archive_format_mapping": {"nested": "csv"}, "archive_ts": "20240101000000"}
    stopped = archive_dataset(spark, database, prefix, **options)
    assert statuses(stopped)["table", "nested"] == "FAILED"
    with pytest.raises(SnapshotIncomplete):
        manifest.read_manifest(spark, snapshot_of(stopped))
    options["archive_ts"] = "20240102000000"
    went_on = archive_dataset(spark, database, prefix, continue_on_failure=True, **options)
    assert statuses(went_on) == {("table", "nested"): "FAILED", ("table", "plain"): "OK"}
    restored = restore_dataset(spark, snapshot_of(went_on), f"{database}_b", continue_on_failure=True)
    try:
        assert statuses(restored)["table", "nested"] == "FAILED"
        assert spark.table(f"{database}_b.plain").count() == 2
    finally:
        spark.sql(f"DROP DATABASE {database}_b CASCADE")


def test_code_functions(spark, database, target, tmp_path):
    name = f"plus_{database}"
    routines.create_code_function(spark, database, name, f"def {name}(s):\n    return s + 1\n", "bigint", [{"name": "s", "type": "bigint"}])
    routines.create_code_function(spark, database, "js", "return x", "bigint", [], "javascript", imported_libraries=["lib.js"])
    spark.sql(f"CREATE FUNCTION {database}.rows(x INT) RETURNS TABLE (y INT) RETURN SELECT x")
    with pytest.raises(ObjectExists):
        routines.create_code_function(spark, database, "js", "", "bigint")
    snapshot = archive(spark, database, tmp_path)
    js = manifest.read_manifest(spark, snapshot).filter("name = 'js'").first()
    assert (js.language, js.body, js.imported_libraries) == ("JAVASCRIPT", "return x", ["lib.js"])
    found = statuses(restore_dataset(spark, snapshot, target))
    assert found["function", "js"] == "UNSUPPORTED" and found["function", name] == "OK"
    assert found["unsupported", "rows"] == "UNSUPPORTED"
    assert routines.register_code_functions(spark, target) == []
    assert routines.register_code_functions(spark, target, allow_code=True) == [name]
    assert spark.range(3).select(F.expr(f"{name}(id)")).collect() == [(1,), (2,), (3,)]


def test_scripts_check_their_arguments(spark, database):
    routines.create_script(spark, database, "s", "BEGIN SELECT :d AS d; END", [{"name": "d", "type": "date"}])
    assert routines.run_script(spark, f"{database}.s", d="2024-02-03").first().d == datetime.date(2024, 2, 3)
    with pytest.raises(StowageError):
        routines.run_script(spark, f"{database}.s")
    with pytest.raises(StowageError):
        routines.run_script(spark, f"{database}.missing")


def test_external_tables(spark, database, target, tmp_path):
    spark.range(20).withColumn("p", F.col("id") % 3).write.partitionBy("p").option("sep", ";").csv(str(tmp_path / "files"))
    schema = spark.range(1).selectExpr("id", "id AS p").schema
    views.create_external_table(spark, f"{database}.ext", "csv", str(tmp_path / "files"), schema, {"sep": ";"}, ("p",), "files", {"k": "v"})
    spark.range(7).write.parquet(str(tmp_path / "more/x=1/data"))
    spark.range(3).write.parquet(str(tmp_path / "more/x=2/data"))
    views.create_external_table(spark, f"{database}.globbed", "parquet", str(tmp_path / "more/*/data"), spark.range(1).schema)
    snapshot = archive(spark, database, tmp_path)
    row = manifest.read_manifest(spark, snapshot).filter("name = 'ext'").first()
    assert row.rows is None and row.options == {"sep": ";"}
    restore_dataset(spark, snapshot, target)
    assert same_rows(spark.table(f"{target}.ext"), spark.table(f"{database}.ext"))
    assert spark.table(f"{target}.ext").count() == 20
    assert spark.table(f"{target}.globbed").count() == 10
    spark.sql(f"DROP DATABASE {target} CASCADE")
    assert spark.table(f"{database}.ext").count() == 20


def test_refresh_waits_for_its_interval(spark, database):
    write_table(spark, f"{database}.t", spark.range(3))
    start = datetime.datetime(2024, 1, 1)
    views.create_materialized_view(spark, f"{database}.m", "SELECT count(*) AS n FROM t", True, 600, as_of=start, description="d")
    write_table(spark, f"{database}.t", spark.range(4), mode="append")
    assert not views.refresh_materialized(spark, f"{database}.m", start + datetime.timedelta(seconds=599))
    assert spark.table(f"{database}.m").first().n == 3
    assert views.refresh_materialized(spark, f"{database}.m", start + datetime.timedelta(seconds=600))
    assert spark.table(f"{database}.m").first().n == 7
    assert catalog.describe(spark, database, "m")["comment"] == "d"
    tables = [t.name for t in spark.catalog.listTables(database)]
    assert len([t for t in tables if t.startswith("m__")]) == 1
    views.create_materialized_view(spark, f"{database}.off", "SELECT count(*) AS n FROM t", False, 60, as_of=start)
    assert not views.refresh_materialized(spark, f"{database}.off", start + datetime.timedelta(days=1))
    with pytest.raises(StowageError):
        views.refresh_materialized(spark, f"{database}.t")


def test_manifest_reads_all_snapshots_and_prunes(spark, database, tmp_path):
    write_table(spark, f"{database}.t", spark.sql("SELECT 1 AS a, named_struct('b', array('x')) AS s"))
    for ts in ("20240101000000", "20240102000000"):
        archive(spark, database, tmp_path, archive_ts=ts)
    everything = manifest.read_manifests(spark, str(tmp_path / "archive"))
    assert everything.select("archive_ts").distinct().count() == 2
    assert manifest.latest_snapshots(everything).first().archive_ts == "20240102000000"
    one = manifest.read_manifests(spark, str(tmp_path / "archive"), F.col("archive_ts") == "20240101000000")
    assert one.count() == 2
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(archive_ts" in plan
    columns = {r.name: (r.type, r.mode) for r in manifest.archived_columns(one).collect()}
    assert columns == {"a": ("int", "NULLABLE"), "s": ("struct<b:array<string>>", "NULLABLE"), "s.b": ("string", "REPEATED")}
    per_object = spark.read.json(f"{tmp_path}/archive/project=spark_catalog/dataset={database}/archive_ts=20240101000000/tables/table=t/*.json")
    assert json.loads(per_object.first().schema_json)["fields"][0]["name"] == "a"


def test_loading_a_partitioned_archive_needs_no_shuffle(spark, database, tmp_path):
    config = parts.time_partition("d", "DAY")
    df = spark.sql("SELECT id, date_add(date'2024-01-01', CAST(id % 7 AS INT)) AS d FROM range(1000)")
    fmt = FileFormat("parquet", "zstd")
    snapshot_table(parts.add_partition_column(df, config), str(tmp_path / "x"), fmt, config)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("load", "load")
    try:
        load_table(spark, f"{database}.t", str(tmp_path / "x"), fmt, df.schema, config)
        jobs = tracker.getJobIdsForGroup("load")
        assert jobs and all(len(tracker.getJobInfo(j).stageIds) == 1 for j in jobs)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert same_rows(spark.table(f"{database}.t"), df)


def test_a_lost_database_comes_back_in_place(spark, fixture_database, tmp_path):
    before = {n: spark.table(f"{fixture_database}.{n}").collect() for n in ("z_fixed", "readings")}
    snapshot = archive(spark, fixture_database, tmp_path)
    routines.drop_functions(spark, fixture_database)
    spark.sql(f"DROP DATABASE {fixture_database} CASCADE")
    result = restore_dataset(spark, snapshot, concurrency=4)
    assert set(statuses(result).values()) == {"OK"}, [tuple(r) for r in result.filter("error is not null").collect()]
    for name, rows in before.items():
        assert sorted(spark.table(f"{fixture_database}.{name}").collect(), key=repr) == sorted(rows, key=repr)
    assert spark.table(f"{fixture_database}.a_top").count() == 61


def test_short_names_in_parallel_materialized_views(spark, database, target, tmp_path):
    write_table(spark, f"{database}.t", spark.range(100))
    for i in range(8):
        views.create_materialized_view(spark, f"{database}.m{i}", f"SELECT count(*) AS n FROM t WHERE id % 8 <= {i}")
    result = restore_dataset(spark, archive(spark, database, tmp_path), target, concurrency=8)
    assert set(statuses(result).values()) == {"OK"}
    assert spark.catalog.currentDatabase() == "default"
    assert spark.table(f"{target}.m7").first().n == 100


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_partition_values_keep_their_text(spark, database, target, tmp_path, fmt):
    values = ["01", "1", "a b/c=d", "2024-01-01", "%", "é", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, k string")
    write_table(spark, f"{database}.t", df, parts.column_partition("k"))
    restore_dataset(spark, archive(spark, database, tmp_path, table_data_archive_format=fmt), target)
    assert same_rows(spark.table(f"{target}.t"), df)


def test_functions_named_like_builtin_ones_are_no_cycle(spark, database, target, tmp_path):
    routines.create_function(spark, database, "upper", "x STRING", "STRING", "concat('up:', upper(x))")
    routines.create_function(spark, database, "trim", "x STRING", "STRING", f"{database}.upper(trim(x))")
    result = restore_dataset(spark, archive(spark, database, tmp_path), target)
    assert set(statuses(result).values()) == {"OK"}, [tuple(r) for r in result.filter("error is not null").collect()]
    assert spark.sql(f"SELECT {target}.trim(' a ')").first()[0] == "up:A"


def test_overwriting_a_partitioned_table_keeps_it_until_the_new_data_is_there(spark, database):
    config = parts.range_partition("id", 0, 10, 5)
    write_table(spark, f"{database}.t", spark.range(10), config)
    broken = spark.range(3).select(F.when(F.col("id") < 2, F.col("id")).otherwise(F.raise_error(F.lit("boom"))).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="boom"):
        write_table(spark, f"{database}.t", broken, config, mode="overwrite")
    assert spark.table(f"{database}.t").count() == 10
    write_table(spark, f"{database}.t", spark.range(4), config, mode="overwrite")
    assert spark.table(f"{database}.t").count() == 4
    assert len([t for t in spark.catalog.listTables(database) if not t.isTemporary]) == 2
