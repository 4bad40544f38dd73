import datetime
import threading

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from stowage.errors import PartitionFilterRequired, StowageError
from stowage.operators import partitions as parts
from stowage.operators import tables, zones
from stowage.operators.tables import drop_object, expire_partitions, load_table, read_table, snapshot_table, write_table
from stowage.sources import catalog
from stowage.sources.formats import FileFormat

PARQUET = FileFormat("parquet", "zstd")


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def storage(spark, database, table):
    name = catalog.properties_of(catalog.describe(spark, database, table))[catalog.STORAGE]
    return spark.table(f"{database}.{name}")


def test_range_values_match_brute_force(spark):
    config = parts.range_partition("x", 5, 47, 10)
    df = spark.createDataFrame([(x,) for x in [None, *range(-20, 70)]], "x bigint")
    found = {r.x: r[parts.HIDDEN_COLUMN] for r in parts.add_partition_column(df, config).collect()}
    expected = {x: 5 + (x - 5) // 10 * 10 if x is not None and 5 <= x < 47 else None for x in [None, *range(-20, 70)]}
    assert found == expected


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_values_ignore_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS n, timestamp'2024-03-10 23:59:59Z' AS t, "
                        "timestamp_ntz'1969-12-31 23:30:00' AS early, date'2024-03-10' AS d, timestamp'1969-12-31 23:30:00Z' AS e")

        def value(field, unit):
            config = parts.time_partition(field, unit)
            return parts.add_partition_column(row, config).first()[parts.HIDDEN_COLUMN]

        assert value("n", "DAY") == value("t", "DAY") == value("d", "DAY") == datetime.date(2024, 3, 10)
        assert value("n", "MONTH") == value("t", "MONTH") == datetime.date(2024, 3, 1)
        assert value("n", "YEAR") == datetime.date(2024, 1, 1)
        hours = (datetime.datetime(2024, 3, 10) - datetime.datetime(1970, 1, 1)) // datetime.timedelta(hours=1)
        assert value("n", "HOUR") == hours + 2
        assert value("t", "HOUR") == hours + 23
        assert value("early", "HOUR") == value("e", "HOUR") == -1
        assert value("early", "DAY") == value("e", "DAY") == datetime.date(1969, 12, 31)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unusable_configs_are_refused(spark):
    with pytest.raises(StowageError):
        parts.time_partition("x", "WEEK")
    with pytest.raises(StowageError):
        parts.range_partition("x", 0, 10, 0)
    with pytest.raises(StowageError):
        parts.add_partition_column(spark.range(1), parts.time_partition("id", "DAY"))


def test_hidden_column_stays_hidden_and_order_is_kept(spark, database, data):
    events = data(spark, "events")
    write_table(spark, f"{database}.events", events, parts.time_partition("ts", "DAY"))
    assert spark.table(f"{database}.events").columns == events.columns
    assert same_rows(spark.table(f"{database}.events"), events)


@pytest.mark.parametrize(
    "filters, where",
    [
        ([("ts", ">=", datetime.datetime(2024, 1, 10, 12)), ("ts", "<", datetime.datetime(2024, 1, 12))],
         "ts >= '2024-01-10 12:00:00' AND ts < '2024-01-12'"),
        ([("ts", "between", ("2024-01-03", "2024-01-04 06:00:00"))], "ts BETWEEN '2024-01-03' AND '2024-01-04 06:00:00'"),
        ([("ts", "=", "2024-01-01 00:03:52.824425")], "ts = '2024-01-01 00:03:52.824425'"),
        ([("ts", ">", "2024-01-29")], "ts > '2024-01-29'"),
        ([("ts", "<=", "2024-01-02"), ("user_id", "in", [1, 2, 3])], "ts <= '2024-01-02' AND user_id IN (1, 2, 3)"),
    ],
)
@pytest.mark.parametrize("unit", ["DAY", "MONTH"])
def test_filters_on_time_prune_and_keep_every_row(spark, database, data, unit, filters, where):
    events = data(spark, "events")
    write_table(spark, f"{database}.events", events, parts.time_partition("ts", unit))
    df = read_table(spark, f"{database}.events", filters)
    assert same_rows(df, events.filter(where))
    # Without a file that can hold such a row nothing is scanned at all.
    assert f"PartitionFilters: [isnotnull({parts.HIDDEN_COLUMN}" in plan(df) or "LocalTableScan" in plan(df)


def test_range_filters_match_brute_force(spark, database):
    values = [None, *range(-15, 75)]
    df = spark.createDataFrame([(x,) for x in values], "x bigint")
    write_table(spark, f"{database}.t", df, parts.range_partition("x", 0, 50, 10))
    checks = {"=": lambda x, v: x == v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v,
              "<=": lambda x, v: x <= v}
    frames = []
    expected = set()
    for operator, check in checks.items():
        for value in (-5, 0, 9, 10, 49, 50, 60):
            name = f"{operator} {value}"
            frames.append(read_table(spark, f"{database}.t", [("x", operator, value)]).withColumn("q", F.lit(name)))
            expected |= {(x, name) for x in values if x is not None and check(x, value)}
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionAll(frame)
    assert {(r.x, r.q) for r in union.collect()} == expected
    inside = read_table(spark, f"{database}.t", [("x", "in", [3, 70])])
    assert {r.x for r in inside.collect()} == {3, 70}


def test_reads_without_the_required_filter_raise(spark, database, data):
    name = f"{database}.events"
    write_table(spark, name, data(spark, "events"), parts.time_partition("ts", "DAY", require_filter=True))
    for bad in ({}, {"where": "user_id = 1"}, {"filters": [("user_id", "=", 1)]}, {"where": "event_type = 'ts'"}):
        with pytest.raises(PartitionFilterRequired):
            read_table(spark, name, **bad)
    assert read_table(spark, name, where="ts < '2024-01-02'").count() > 0


def test_expired_partitions_are_not_even_read(spark, database, data, tmp_path):
    events = data(spark, "events").unionAll(
        spark.createDataFrame([(-1, None, 1, "x", 1.0, "{}")], data(spark, "events").schema)
    )
    config = parts.time_partition("ts", "DAY", expiration_ms=7 * parts.MILLIS_PER_DAY)
    snapshot_table(parts.add_partition_column(events, config), str(tmp_path / "x"), PARQUET, config)
    for as_of, first in ((datetime.datetime(2024, 1, 22), "2024-01-15"), (datetime.datetime(2024, 1, 22, 6), "2024-01-16")):
        name = f"{database}.t{as_of.hour}"
        load_table(spark, name, str(tmp_path / "x"), PARQUET, events.schema, config, as_of=as_of)
        assert same_rows(spark.table(name), events.filter(f"ts >= '{first}' OR ts IS NULL"))
    load_table(spark, f"{database}.all", str(tmp_path / "x"), PARQUET, events.schema, config)
    assert spark.table(f"{database}.all").count() == events.count()


def test_hour_retention(spark, data):
    config = parts.time_partition("ts", "HOUR", expiration_ms=3 * parts.MILLIS_PER_HOUR)
    df = parts.add_partition_column(data(spark, "events"), config)
    kept = df.filter(parts.retention_predicate(config, datetime.datetime(2024, 1, 2, 5, 30)))
    assert same_rows(kept.drop(parts.HIDDEN_COLUMN), data(spark, "events").filter("ts >= '2024-01-02 03:00:00'"))


def test_a_hot_partition_is_written_by_several_tasks(spark, database):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        df = spark.range(0, 600_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit(datetime.date(2024, 1, 1)))
            .otherwise(F.date_add(F.lit(datetime.date(2024, 1, 2)), (F.col("id") % 20).cast("int"))).alias("d"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        write_table(spark, f"{database}.hot", df, parts.time_partition("d", "DAY"))
        files = storage(spark, database, "hot").filter("d = '2024-01-01'").select(F.input_file_name()).distinct().count()
        assert files > 1
        assert spark.table(f"{database}.hot").count() == 600_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


WHERES = [
    ("ts >= '2024-01-02'", True), ("TS >= TIMESTAMP '2024-01-02 03:00:00' AND id > 3", True), ("ts IN ('2024-01-01 05:00:00', '2024-01-02')", True),
    ("(ts >= '2024-01-02')", True), ("date(ts) = '2024-01-02'", True), ("ts >= CAST('2024-01-03' AS TIMESTAMP_NTZ)", True), ("`ts` IS NULL", True),
    ("id = 1 AND 'ts > 1' = 'x'", False), ("id IN (3, 4)", False),
]


@pytest.mark.parametrize("unit", parts.TIME_UNITS)
def test_predicates_guard_and_prune(spark, database, unit):
    rows = spark.sql("SELECT id, timestamp_ntz'2023-12-20 01:30:00' + make_dt_interval(0, CAST(id * 7 AS INT)) AS ts FROM range(90)").unionByName(
        spark.sql("SELECT -1L AS id, CAST(NULL AS TIMESTAMP_NTZ) AS ts")
    )
    name = f"{database}.by_{unit.lower()}"
    write_table(spark, name, rows, parts.time_partition("ts", unit, require_filter=True))
    for where, names_field in WHERES:
        if not names_field:
            with pytest.raises(PartitionFilterRequired):
                read_table(spark, name, where=where)
            with pytest.raises(PartitionFilterRequired):
                read_table(spark, name, [F.expr(where)])
            continue
        expected = sorted(map(str, rows.where(where).collect()))
        assert sorted(map(str, read_table(spark, name, where=where).collect())) == expected, where
        found = read_table(spark, name, [F.expr(where)])
        assert sorted(map(str, found.collect())) == expected, where
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: []" not in text or not expected, where


def test_a_column_prunes_to_the_partitions_with_rows(spark, database, data):
    events, name = data(spark, "events"), f"{database}.events"
    write_table(spark, name, events, parts.time_partition("ts", "DAY"))
    found = read_table(spark, name, [F.to_date("ts").isin(datetime.date(2024, 1, 3), datetime.date(2024, 1, 9)) & (F.col("user_id") > 0)])
    assert same_rows(found, events.where("date(ts) IN ('2024-01-03', '2024-01-09') AND user_id > 0"))
    files = {f.split("stowage_part=")[1].split("/")[0] for f in found.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert files == {"2024-01-03", "2024-01-09"}


def test_range_predicates(spark, database):
    rows = spark.sql("SELECT id - 20 AS x FROM range(150)")
    name = f"{database}.ranges"
    write_table(spark, name, rows, parts.range_partition("x", 0, 100, 10, require_filter=True))
    for where in ("x = 42", "x > 95 AND x < 120", "7 >= x", "x BETWEEN 33 AND 51", "x >= 100", "x > 3 OR x < 2", "x + 1 = 3", "x IN (-3, 5, 140)"):
        expected = sorted(r.x for r in rows.where(where).collect())
        for found in (read_table(spark, name, where=where), read_table(spark, name, [F.expr(where)])):
            assert sorted(r.x for r in found.collect()) == expected, where


def test_zone_map(spark, database, data):
    events, name = data(spark, "events"), f"{database}.events"
    write_table(spark, name, events, parts.time_partition("ts", "MONTH"))
    kept = [t.name for t in spark.catalog.listTables(database) if t.name.endswith(zones.SUFFIX)]
    assert len(kept) == 1
    zone = spark.table(f"{database}.{kept[0]}")
    assert zone.agg(F.sum("rows")).first()[0] == events.count()
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    assert zone.agg(F.min("zones.ts.low"), F.max("zones.ts.high")).first() == (low, high)
    late = events.limit(10).withColumn("ts", F.expr("timestamp_ntz'2031-05-01 10:00:00' + make_dt_interval(event_id % 20)"))
    write_table(spark, name, late, mode="append")
    assert zones.has_map(spark, database, kept[0].removesuffix(zones.SUFFIX))
    assert spark.table(f"{database}.{kept[0]}").agg(F.sum("rows")).first()[0] == events.count() + 10
    found = read_table(spark, name, [("ts", ">", "2031-01-01")])
    assert same_rows(found, late) and 0 < len(found.inputFiles()) < len(spark.table(name).inputFiles())
    drop_object(spark, database, "events")
    assert not spark.catalog.listTables(database)


def test_plain_sql_skips_row_groups(spark, database):
    rows = spark.range(0, 400_000, 1, 4).selectExpr("(id * 7919) % 400000 AS x", "sha2(cast(id AS STRING), 256) AS payload")
    spark.conf.set("parquet.block.size", str(1 << 20))
    try:
        write_table(spark, f"{database}.t", rows, parts.range_partition("x", 0, 400_000, 400_000))
    finally:
        spark.conf.unset("parquet.block.size")
    found = spark.sql(f"SELECT * FROM {database}.t WHERE x IN (5, 399990) OR x BETWEEN 1000 AND 1010")
    assert sorted(r.x for r in found.collect()) == [5, *range(1000, 1011), 399990]
    assert rows_out_of_scan(found) < 200_000


def rows_out_of_scan(df):
    """How many rows the scan of files handed on."""
    plan_of = df._jdf.queryExecution().executedPlan()
    plan_of = plan_of.executedPlan() if plan_of.nodeName().startswith("Adaptive") else plan_of
    leaves, total = plan_of.collectLeaves(), 0
    for i in range(leaves.length()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_overwriting_never_misses_the_table(spark, database):
    name = f"{database}.t"
    spark.range(10).write.saveAsTable(name)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(spark.sql(f"SELECT count(*), min(id) FROM {name}").first())

    reader = threading.Thread(target=read)
    reader.start()
    for start in (100, 200, 300):
        write_table(spark, name, spark.range(start, start + 20), mode="overwrite", labels={"n": str(start)}, description=f"from {start}")
    stop.set()
    reader.join()
    assert {tuple(r) for r in seen} <= {(10, 0), (20, 100), (20, 200), (20, 300)}
    assert [r.id for r in spark.table(name).orderBy("id").collect()] == list(range(300, 320))
    found = catalog.describe(spark, database, "t")
    assert catalog.labels_of(found) == {"n": "300"} and found["comment"] == "from 300"
    assert [r.name for r in catalog.list_objects(spark, database).collect()] == ["t"]
    spark.sql(f"INSERT INTO {name} VALUES (7)")
    assert spark.table(name).count() == 21
    drop_object(spark, database, "t")
    assert not spark.catalog.listTables(database)


def test_an_overwrite_cut_off_is_recovered(spark, database, monkeypatch):
    name = f"{database}.t"
    spark.range(10).write.saveAsTable(name)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(tables, "_rename", crash)
        with pytest.raises(RuntimeError):
            write_table(spark, name, spark.range(5).selectExpr("id", "'x' AS other"), mode="overwrite")
    assert not spark.catalog.tableExists(name)
    assert tables.recover_overwrites(spark, database, "t") and spark.table(name).columns == ["id", "other"] and spark.table(name).count() == 5
    assert not tables.recover_overwrites(spark, database, "t")
    assert catalog.REPLACES not in catalog.properties_of(catalog.describe(spark, database, "t"))


def test_overwriting_a_column_partitioned_table_keeps_its_rows(spark, database):
    rows = spark.createDataFrame([(1, "a b"), (2, "x=1/y"), (3, None), (4, "100%")], "id int, kind string")
    for n, df in enumerate((rows, rows.selectExpr("id + 10 AS id", "kind"), rows.selectExpr("id + 20 AS id", "kind"))):
        write_table(spark, f"{database}.t", df, parts.column_partition("kind"), mode="overwrite")
        assert sorted(map(str, spark.table(f"{database}.t").select("id", "kind").collect())) == sorted(map(str, df.collect())), n
    assert spark.table(f"{database}.t").where("kind = 'a b'").first().id == 21


def test_expired_partitions_are_dropped_by_the_catalog(spark, database, data):
    events, name = data(spark, "events"), f"{database}.events"
    rows = events.unionByName(events.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    write_table(spark, name, rows, parts.time_partition("ts", "DAY", expiration_ms=7 * parts.MILLIS_PER_DAY))
    before = len(spark.table(name).inputFiles())
    assert expire_partitions(spark, name, datetime.datetime(2024, 1, 22)) > 0
    assert same_rows(spark.table(name), rows.where("ts IS NULL OR ts >= '2024-01-15'")) and len(spark.table(name).inputFiles()) < before
    assert same_rows(read_table(spark, name, [("ts", "<", "2024-01-16")]), rows.where("ts >= '2024-01-15' AND ts < '2024-01-16'"))
    assert expire_partitions(spark, name, datetime.datetime(2024, 1, 22)) == 0
    assert catalog.properties_of(catalog.describe(spark, database, "events"))[catalog.KEPT_FROM] == "2024-01-22T00:00:00"
    write_table(spark, f"{database}.plain", events, parts.time_partition("ts", "DAY"))
    assert expire_partitions(spark, f"{database}.plain", datetime.datetime(2030, 1, 1)) == 0
