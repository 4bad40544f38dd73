"""

Queries that archive or restore write their files below a fresh scratch folder (see
``stowage.session.scratch_dir``) and use databases of their own with unique names.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.functions import references as refs
from stowage.functions import routines
from stowage.operators import checks, incremental, partitions, views, zones
from stowage.operators.tables import expire_partitions, load_table, read_snapshot, read_table, snapshot_table, split_name, write_table
from stowage.plans import graph
from stowage.plans.archive import archive_dataset, snapshot_of
from stowage.plans.restore import restore_dataset
from stowage.session import literal, quoted, scratch_dir, spread
from stowage.sources import catalog, manifest, schemas
from stowage.sources.formats import FileFormat

try:
    import corpus_pipeline
    from stowage.llm import queries as llm
except ImportError:  # the subpackage may be left out
    corpus_pipeline = llm = None

PARQUET = FileFormat("parquet", "zstd")
CSV = FileFormat("csv", "gzip")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


class Workspace:
    """A scratch folder with databases in it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self.path = scratch_dir(spark, "query")
        self.tag = uuid.uuid4().hex[:10]
        self.source = self.database("src")
        self.target = f"dst_{self.tag}"

    def database(self, label: str) -> str:
        name = f"{label}_{self.tag}"
        self.spark.sql(f"CREATE DATABASE {quoted(name)} LOCATION {literal(f'{self.path}/{name}')}")
        return name

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def copy(self, *tables: str, **options) -> None:
        """Managed copies of given tables in the source database."""
        for table in tables:
            write_table(self.spark, f"{self.source}.{table}", self.read(table), **options)

    def archive(self, **options) -> str:
        return snapshot_of(archive_dataset(self.spark, self.source, f"{self.path}/archive", **options))

    def restore(self, snapshot: str, **options) -> DataFrame:
        return restore_dataset(
            self.spark, snapshot, self.target, location=f"{self.path}/{self.target}", **options
        )

    def round_trip(self, **options) -> DataFrame:
        return self.restore(self.archive(), **options)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.target}.{name}")


def _file_round_trip(spark: SparkSession, sf_dir: str, table: str, fmt: FileFormat,
                     partition: partitions.PartitionConfig | None = None, **load) -> tuple[Workspace, str]:
    """Archive one table's files and load them into a new table."""
    ws = Workspace(spark, sf_dir)
    df = ws.read(table)
    path = f"{ws.path}/files"
    laid_out = df if partition is None else partitions.cluster_for_write(partitions.add_partition_column(df, partition), partition)
    seen = snapshot_table(laid_out, path, fmt, partition)
    name = f"{ws.source}.{table}"
    load_table(spark, name, path, fmt, df.schema, partition, seen["multi_line"], **load)
    return ws, name


# -- snapshot and load -------------------------------------------------------------------------


def roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_file_round_trip(spark, sf_dir, "orders", PARQUET)[1])


def roundtrip_csv_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_file_round_trip(spark, sf_dir, "lineitem", CSV)[1])


def roundtrip_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_file_round_trip(spark, sf_dir, "documents", CSV)[1])


def roundtrip_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    df = ws.read("customer")
    snapshot_table(df, f"{ws.path}/files", FileFormat("csv", "none"))
    inferred = read_snapshot(spark, f"{ws.path}/files", FileFormat("csv", "none"))
    return inferred.select([F.col(f.name).cast(f.dataType) for f in df.schema])


def roundtrip_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.table(_file_round_trip(spark, sf_dir, "embeddings", PARQUET)[1])
    return df.select("vec_id", "label", F.posexplode("embedding").alias("pos", "val")).select(
        "vec_id", "label", F.col("pos").cast("bigint").alias("pos"), F.col("val").cast("double").alias("val")
    )


def format_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    ws.copy("region", "nation", "customer", "supplier", "orders")
    snapshot = ws.archive(
        concurrency=4,
        table_data_archive_format_mapping={"region": "csv", "customer": "CSV"},
        table_data_archive_compression_mapping={"nation": "snappy", "customer": "deflate"},
    )
    return manifest.read_manifest(spark, snapshot).filter("kind = 'table'").select("name", "format", "compression", "rows")


def datetime_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_file_round_trip(spark, sf_dir, "events", CSV)[1]).select("event_id", "ts", "user_id")


# -- partitioning ------------------------------------------------------------------------------


def _partition_counts(spark: SparkSession, name: str) -> DataFrame:
    database, table = split_name(spark, name)
    storage = catalog.properties_of(catalog.describe(spark, database, table))[catalog.STORAGE]
    counts = spark.table(f"{database}.{storage}").groupBy(F.col(partitions.HIDDEN_COLUMN).alias("part")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(F.coalesce(F.col("part").cast("string"), F.lit("none")).alias("part"), "n")


def time_partition_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = partitions.time_partition("ts", "DAY")
    return _partition_counts(spark, _file_round_trip(spark, sf_dir, "events", PARQUET, config)[1])


def time_partition_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = partitions.time_partition("ts", "HOUR")
    return _partition_counts(spark, _file_round_trip(spark, sf_dir, "events", PARQUET, config)[1])


def time_partition_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = partitions.time_partition("o_orderdate", "MONTH")
    return _partition_counts(spark, _file_round_trip(spark, sf_dir, "orders", CSV, config)[1])


def time_partition_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = partitions.time_partition("l_shipdate", "YEAR")
    return _partition_counts(spark, _file_round_trip(spark, sf_dir, "lineitem", PARQUET, config)[1])


def range_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = partitions.range_partition("c_custkey", 0, 1000, 100)
    return _partition_counts(spark, _file_round_trip(spark, sf_dir, "customer", PARQUET, config)[1])


def column_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = partitions.column_partition("c_mktsegment")
    ws = Workspace(spark, sf_dir)
    ws.copy("customer", partition=config)
    ws.round_trip()
    return ws.table("customer")


def partition_expiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = partitions.time_partition("ts", "DAY", expiration_ms=7 * partitions.MILLIS_PER_DAY)
    as_of = datetime.datetime(2024, 1, 22)
    return spark.table(_file_round_trip(spark, sf_dir, "events", PARQUET, config, as_of=as_of)[1])


def partition_expiration_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table loaded whole whose partitions expire afterwards, at two times; the zone map follows."""
    config = partitions.time_partition("ts", "DAY", expiration_ms=7 * partitions.MILLIS_PER_DAY)
    _, name = _file_round_trip(spark, sf_dir, "events", PARQUET, config)
    dropped = [expire_partitions(spark, name, datetime.datetime(2024, 1, day)) for day in (15, 22, 22)]
    return read_table(spark, name, [("ts", ">=", "2024-01-01")]).withColumn("again", F.lit(dropped[2]).cast("bigint"))


def guarded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = partitions.time_partition("l_shipdate", "MONTH", require_filter=True)
    _, name = _file_round_trip(spark, sf_dir, "lineitem", PARQUET, config)
    return read_table(
        spark, name,
        filters=[("l_shipdate", ">=", datetime.datetime(1996, 3, 10)), ("l_shipdate", "<", datetime.datetime(1997, 2, 3))],
        where="l_quantity > 10",
    )


def guarded_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = partitions.range_partition("c_custkey", 0, 1000, 100, require_filter=True)
    _, name = _file_round_trip(spark, sf_dir, "customer", PARQUET, config)
    return read_table(spark, name, filters=[("c_custkey", "between", (250, 1200))])


# -- whole databases ---------------------------------------------------------------------------


def archive_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    ws.copy("orders", "customer", "events")
    views.create_external_table(spark, f"{ws.source}.part", "parquet", f"{sf_dir}/part.parquet", ws.read("part").schema)
    views.create_view(spark, f"{ws.source}.open_orders", "SELECT * FROM orders WHERE o_orderstatus = 'O'")
    views.create_materialized_view(
        spark, f"{ws.source}.segments", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"
    )
    routines.create_function(spark, ws.source, "twice", "x BIGINT", "BIGINT", "x * 2")
    routines.create_script(spark, ws.source, "noop", "BEGIN SELECT 1 AS one; END")
    status = archive_dataset(spark, ws.source, f"{ws.path}/archive", concurrency=4)
    restored = ws.restore(snapshot_of(status), concurrency=4)
    archived = status.select("kind", "name", F.col("status").alias("archived"), F.col("rows").alias("archived_rows"))
    return archived.join(
        restored.select("kind", "name", F.col("status").alias("restored"), F.col("rows").alias("restored_rows")),
        ["kind", "name"],
    ).fillna(-1)


def skip_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    ws.copy("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    restored = ws.round_trip(concurrency=4, skip_restore={"part": True, "orders": True, "nation": False})
    return restored.filter("kind = 'table'").select("name", "status", "rows").fillna(-1)


def manifest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    ws.copy("nation", "orders", "embeddings")
    customer = ws.read("customer")
    annotated = schemas.annotate(
        customer.schema, required=["c_custkey"], descriptions={"c_name": "full name"}, defaults={"c_mktsegment": "'NONE'"}
    )
    write_table(spark, f"{ws.source}.customer", customer, schema=annotated)
    manifests = manifest.read_manifests(spark, f"{ws.path}/archive", F.col("dataset") == ws.source) if ws.archive() else None
    rows = manifests.select(F.col("name").alias("object"), "rows")
    return (
        manifest.archived_columns(manifests)
        .join(rows, "object")
        .select("object", F.col("pos").cast("bigint").alias("pos"), "name", "type", "mode", "description",
                "default_expression", "rows")
    )


def snapshot_addressing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    ws.copy("nation", "events")
    ws.archive(archive_ts="20240101000000")
    write_table(spark, f"{ws.source}.events", ws.read("events").filter("event_type = 'click'"), mode="append")
    ws.archive(archive_ts="20240201000000")
    manifests = manifest.read_manifests(spark, f"{ws.path}/archive")
    newest = manifest.latest_snapshots(manifests)
    return (
        manifests.join(newest.withColumnRenamed("archive_ts", "newest_ts"), ["project", "dataset"])
        .filter("kind = 'table'")
        .select("archive_ts", "name", "rows", (F.col("archive_ts") == F.col("newest_ts")).alias("newest"))
    )


def commit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshots by the commit index, past one that is short of rows and one of another version."""
    ws = Workspace(spark, sf_dir)
    ws.copy("nation")
    ws.archive(archive_ts="20240101000000")
    ws.copy("orders")
    good = ws.archive(archive_ts="20240102000000")
    for stamp, change in (("20240103000000", {"object_count": F.lit(99)}), ("20240104000000", {"metadata_version": F.lit("v9")})):
        rows = spark.read.json(f"{good}/dataset.json").withColumns(change)
        rows.write.json(f"{good.replace('20240102000000', stamp)}/dataset.json")
    added = manifest.rebuild_commits(spark, f"{ws.path}/archive")
    newest = manifest.newest_snapshots(spark, f"{ws.path}/archive")
    listed = manifest.latest_snapshots(manifest.read_manifests(spark, f"{ws.path}/archive")).first().archive_ts
    tables = manifest.read_manifest(spark, good).where("kind = 'table'").select("archive_ts", "name", "rows")
    return tables.join(newest, "archive_ts").select(
        "archive_ts", "name", "rows", F.lit(added).cast("bigint").alias("added"), F.lit(listed).alias("listed"),
    )


def restore_newest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    ws.copy("labels")
    ws.archive(archive_ts="20240101000000")
    write_table(spark, f"{ws.source}.labels", ws.read("labels"), mode="append")
    newest = ws.archive(archive_ts="20240201000000")
    ws.restore(newest)
    return ws.table("labels")


def table_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    write_table(spark, f"{ws.source}.supplier", ws.read("supplier"), description="who delivers", labels={"team": "supply"})
    ws.restore(ws.archive(archive_ts="20240101000000"))
    found = catalog.describe(spark, ws.target, "supplier")
    labels = catalog.labels_of(found)
    return ws.table("supplier").select(
        "*",
        F.lit(found["comment"]).alias("description"),
        F.lit(labels["team"]).alias("team"),
        F.lit(labels["archive_ts"]).alias("archive_ts"),
    )


def required_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested rows with required fields at three depths, archived and loaded with their checks."""
    ws = Workspace(spark, sf_dir)
    turn = F.struct("turn", "role", "text")
    nested = ws.read("conversations").groupBy("conv_id").agg(F.struct(F.sort_array(F.collect_list(turn)).alias("turns")).alias("talk"))
    marked = schemas.annotate(nested.schema, ["conv_id", ["talk", "turns", "[]", "turn"], ["talk", "turns", "[]"]])
    write_table(spark, f"{ws.source}.talks", nested, schema=marked)
    ws.round_trip()
    required = catalog.required_of(catalog.properties_of(catalog.describe(spark, ws.target, "talks")))
    paths = ",".join(r if isinstance(r, str) else ".".join(r) for r in required)
    return ws.table("talks").select("conv_id", F.inline("talk.turns")).withColumn("required", F.lit(paths))


def predicate_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guarded table read by predicates that no comparison with a constant expresses; only partitions with rows are read."""
    config = partitions.time_partition("ts", "DAY", require_filter=True)
    _, name = _file_round_trip(spark, sf_dir, "events", PARQUET, config)
    return read_table(spark, name, [(F.dayofweek("ts") == 2) | F.to_date("ts").isin(datetime.date(2024, 1, 3)), ("ts", "<", "2024-01-20")])


def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the zone map of a table says of its files after a load and an append, by month."""
    config = partitions.time_partition("l_shipdate", "MONTH")
    ws, name = _file_round_trip(spark, sf_dir, "lineitem", PARQUET, config)
    write_table(spark, name, ws.read("lineitem").where("l_linenumber = 1"), mode="append")
    storage = catalog.properties_of(catalog.describe(spark, *split_name(spark, name)))[catalog.STORAGE]
    files = spark.table(f"{ws.source}.{zones.map_of(storage)}").select("rows", "zones.l_shipdate.*")
    return files.groupBy(F.trunc("low", "MONTH").alias("month")).agg(
        F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("nulls").alias("nulls")
    )


def materialized_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that are refreshed from new files after an append and from dropped files after an overwrite."""
    ws = Workspace(spark, sf_dir)
    base, view = f"{ws.source}.orders", f"{ws.source}.totals"
    orders = ws.read("orders")
    write_table(spark, base, orders.where("o_orderstatus = 'F'"))
    incremental.create_incremental_view(
        spark, view, base, ["o_orderpriority"],
        {"orders": ("count", "*"), "total": ("sum", "CAST(o_totalprice AS DECIMAL(18, 2))"), "last": ("max", "o_orderdate")},
    )
    write_table(spark, base, orders.where("o_orderstatus = 'O'"), mode="append")
    first = incremental.refresh_incremental(spark, view)
    write_table(spark, base, spark.table(base).where("o_custkey % 2 = 0"), mode="overwrite")
    second = incremental.refresh_incremental(spark, view)
    return ws.spark.table(view).select(
        "o_orderpriority", "orders", F.col("total").cast("double").alias("total"), "last",
        F.lit(first["added"] > 0 and first["dropped"] == 0 and second["dropped"] > 0).alias("by_files"),
    )


def chain_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves where each order waits for the one its customer placed before it."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.col("o_orderkey").alias("key"))
    before = F.lag("key").over(Window.partitionBy("o_custkey").orderBy("key"))
    edges = orders.select("key", before.alias("requisite")).where("requisite IS NOT NULL")
    return graph.restore_waves(orders.select("key"), edges).select("key", F.col("wave").cast("bigint").alias("wave"))


def restore_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a restore in which a view fails, with and without going on after it."""
    ws = Workspace(spark, sf_dir)
    ws.copy("orders", "customer")
    views.create_view(spark, f"{ws.source}.open_orders", "SELECT * FROM orders WHERE o_orderstatus = 'O'")
    views.create_view(spark, f"{ws.source}.open_customers", "SELECT DISTINCT o_custkey FROM open_orders")
    views.create_view(spark, f"{ws.source}.rich", "SELECT * FROM customer WHERE c_acctbal > 0")
    routines.create_script(spark, ws.source, "noop", "BEGIN SELECT 1 AS one; END")
    snapshot = ws.archive()
    found = None
    for go_on in (True, False):
        target = f"dst_{go_on}_{ws.tag}".lower()
        ledger = restore_dataset(
            spark, snapshot, target, location=f"{ws.path}/{target}", continue_on_failure=go_on, skip_restore={"orders": True}
        ).select(F.lit(go_on).alias("go_on"), "kind", "name", "status", F.coalesce("rows", F.lit(-1)).cast("bigint").alias("rows"))
        found = ledger if found is None else found.unionByName(ledger)
    return found.where("kind <> 'dataset'")


def script_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restored script that draws a token and writes some columns of a row with VALUES and a formatted text."""
    ws = Workspace(spark, sf_dir)
    ws.copy("supplier")
    routines.create_script(
        spark, ws.source, "note",
        "BEGIN DECLARE token STRING; DECLARE held BIGINT; SET token = uuid(); SET held = (SELECT count(*) FROM supplier); "
        f"INSERT INTO {ws.source}.supplier (s_suppkey, s_name) VALUES (:id, format_string('%s of %d suppliers', substr(token, 9, 1), held)); "
        "SELECT token; END",
        [{"name": "id", "type": "bigint"}],
    )
    ws.round_trip()
    routines.run_script(spark, f"{ws.target}.note", id=-1).collect()
    return ws.table("supplier")


def tag_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that reads a JSON array of tags into a struct: known keys only, one renamed, the last of several counts."""
    ws = Workspace(spark, sf_dir)
    ws.copy("events")
    of = "try_element_at(filter(transform(from_json(tags, 'array<string>'), t -> split(t, ':')), p -> p[0] = '{0}' AND size(p) > 1), -1)[1]"
    routines.create_function(
        spark, ws.source, "tagged", "tags STRING", "STRUCT<action: STRING, account: STRING, missing: STRING>",
        f"named_struct('action', {of.format('type')}, 'account', {of.format('user')}, 'missing', {of.format('none')})",
    )
    tags = "to_json(array(concat('type:', event_type), concat('user:', user_id), 'other:x', concat('user:', user_id + 1, ':more'), 'bare'))"
    views.create_view(
        spark, f"{ws.source}.tags", f"SELECT event_id, tagged({tags}).action AS action, `{ws.source}`.tagged({tags}).account AS account, tagged('[]').missing AS missing FROM events"
    )
    ws.round_trip()
    return ws.table("tags")


# -- views, references, graphs -----------------------------------------------------------------


def view_union_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading parties of both sides from three inputs under names of one, two and three parts, one of them a view."""
    ws = Workspace(spark, sf_dir)
    ws.copy("customer", "supplier", "orders")
    project, source = spark.catalog.currentCatalog(), ws.source
    views.create_view(spark, f"{source}.buyers", "SELECT DISTINCT o_custkey AS party, 'buyer' AS role FROM orders")
    views.create_view(
        spark, f"{source}.parties",
        f"SELECT * FROM buyers UNION ALL SELECT s_suppkey, 'seller' FROM (SELECT * EXCEPT (s_name, s_acctbal) FROM `{source}`.supplier) "
        f"UNION ALL SELECT c_custkey, c_mktsegment FROM {project}.{source}.customer AS {source} -- not {source}.orders",
    )
    ws.round_trip()
    spark.sql(f"DROP DATABASE {source} CASCADE")
    return ws.table("parties")


def view_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    ws.copy("orders", "customer", "nation")
    # Named against the order of creation, so that only the dependencies can order the restore.
    views.create_view(spark, f"{ws.source}.c_base", "SELECT * FROM orders WHERE o_totalprice > 1000")
    views.create_view(
        spark, f"{ws.source}.b_joined",
        "WITH customers AS (SELECT c_custkey, c_nationkey FROM customer) "
        "SELECT o.o_orderkey, o.o_orderpriority, c.c_nationkey FROM c_base o JOIN customers c ON o.o_custkey = c.c_custkey",
    )
    views.create_view(
        spark, f"{ws.source}.a_report",
        "SELECT n.n_name, j.o_orderpriority, count(*) AS orders FROM b_joined j, nation n "
        "WHERE j.c_nationkey = n.n_nationkey GROUP BY n.n_name, j.o_orderpriority",
    )
    ws.round_trip()
    return ws.table("a_report")


# A statement per order. {n} is a number taken from the row; the CASE picks the form by priority.
_FORMS = {
    "1-URGENT": ("SELECT * FROM proj.sales.t{n} a JOIN sales.u{n} b ON a.k = b.k, `proj.sales`.w", ["proj.sales.t{n}", "sales.u{n}", "proj.sales.w"],
                 "SELECT * FROM `proj-2`.mart.t{n} a JOIN mart.u{n} b ON a.k = b.k, `proj-2`.mart.w", []),
    "2-HIGH": ("WITH c AS (SELECT sales.f(x) FROM sales.base{n}) SELECT c.x FROM c -- from sales.no", ["sales.base{n}"],
               "WITH c AS (SELECT mart.f(x) FROM mart.base{n}) SELECT c.x FROM c -- from sales.no", ["sales.f"]),
    "3-MEDIUM": ("SELECT extract(YEAR FROM d), \"from sales.no\" FROM (sales_new.a{n} LEFT JOIN t{n} USING (k))", ["sales_new.a{n}", "t{n}"],
                 "SELECT extract(YEAR FROM d), \"from sales.no\" FROM (sales_new.a{n} LEFT JOIN t{n} USING (k))", ["extract"]),
    "4-NOT SPECIFIED": ("SELECT sales.h{n}.c FROM sales.h{n} /* sales.no */ WHERE x IN (SELECT y FROM i)", ["sales.h{n}", "i"],
                        "SELECT mart.h{n}.c FROM mart.h{n} /* sales.no */ WHERE x IN (SELECT y FROM i)", []),
    "5-LOW": ("SELECT sales.x, sales.g(sales.y) FROM other.k sales UNION ALL SELECT * FROM sales.v{n}", ["other.k", "sales.v{n}"],
              "SELECT sales.x, mart.g(sales.y) FROM other.k sales UNION ALL SELECT * FROM mart.v{n}", ["sales.g"]),
}
_MAPPING = {"proj.sales": "proj-2.mart", "sales": "mart", "mart": "twice"}


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    text = F.lit(None).cast("string")
    for priority, (form, *_rest) in _FORMS.items():
        text = F.when(F.col("o_orderpriority") == priority, F.lit(form)).otherwise(text)
    number = F.col("o_custkey").cast("string")
    return spread(orders, "o_orderkey").select("o_orderkey", F.replace(text, F.lit("{n}"), number).alias("sql"))


def table_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = refs.table_references(_statements(spark, sf_dir), "sql")
    return found.select("o_orderkey", "reference", refs.qualify(F.col("reference"), "p", "d").alias("full_name"))


def function_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.function_references(_statements(spark, sf_dir), "sql").select("o_orderkey", "reference")


def rewrite_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.rewrite_references(_statements(spark, sf_dir), "sql", _MAPPING).select("o_orderkey", "sql")


def rewrite_table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table names are mapped; aliases, literals and comments of the same name stay."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderkey")
    statements = orders.select(
        "o_orderkey",
        F.concat(
            F.lit("SELECT raw.a, s.raw.b, x.c FROM raw JOIN s.raw ON raw.k = s.raw.k JOIN p.s.t"),
            F.col("o_custkey").cast("string"), F.lit(" x WHERE c = 'raw "), "o_orderpriority", F.lit("' -- raw"),
        ).alias("sql"),
    )
    return refs.rewrite_references(statements, "sql", {"p.s": "q.s"}, {"raw": "clean", "s.raw": "s-2.clean"})


def _order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"))
    edges = nodes.filter("key > 0").select("key", F.floor(F.col("key") / 2).cast("bigint").alias("requisite"))
    return nodes, edges


def restore_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.restore_waves(*_order_graph(spark, sf_dir)).select("key", F.col("wave").cast("bigint").alias("wave"))


def blocked_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(
        "o_orderstatus = 'P' AND o_totalprice > 450000 AND o_orderpriority = '1-URGENT'"
    ).select(F.col("o_orderkey").alias("key"))
    return graph.blocked_dependents(*_order_graph(spark, sf_dir), failed)


def ready_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"))
    return graph.ready_nodes(*_order_graph(spark, sf_dir), done)


def external_requisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    edges = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("requisite")
    )
    done = customers.filter("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return graph.external_requisites(customers.select(F.col("c_custkey").alias("key")), edges, done)


def materialized_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    ws.copy("orders", "customer")
    created = datetime.datetime(2024, 1, 1)
    views.create_materialized_view(
        spark, f"{ws.source}.revenue",
        "SELECT c_nationkey, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS revenue "
        f"FROM {ws.source}.orders JOIN {ws.source}.customer ON o_custkey = c_custkey GROUP BY c_nationkey",
        enable_refresh=True, refresh_interval_seconds=3600, as_of=created,
    )
    ws.round_trip()
    write_table(spark, f"{ws.target}.orders", ws.read("orders").filter("o_orderstatus = 'F'"), mode="append")
    views.refresh_materialized(spark, f"{ws.target}.revenue", datetime.datetime(2100, 1, 1))
    return ws.table("revenue").select("c_nationkey", "orders", F.col("revenue").cast("double").alias("revenue"))


def materialized_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    ws.copy("orders")
    views.create_materialized_view(
        spark, f"{ws.source}.daily", "SELECT o_orderdate, count(*) AS n FROM orders GROUP BY o_orderdate",
        partition=partitions.time_partition("o_orderdate", "MONTH"),
    )
    ws.round_trip()
    return _partition_counts(spark, f"{ws.target}.daily")


def external_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    views.create_external_table(
        spark, f"{ws.source}.part", "parquet", f"{sf_dir}/part.parquet", ws.read("part").schema, description="parts"
    )
    ws.round_trip()
    return ws.table("part")


def external_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    customers = ws.read("customer")
    snapshot_table(customers, f"{ws.path}/files", PARQUET, partitions.column_partition("c_mktsegment"))
    views.create_external_table(
        spark, f"{ws.source}.customer", "parquet", f"{ws.path}/files", customers.schema, None, ("c_mktsegment",)
    )
    ws.round_trip()
    return ws.table("customer")


def external_over_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    ws.copy("orders")
    snapshot = ws.archive(archive_ts="20240101000000")
    views.create_external_table(
        spark, f"{ws.source}.old_orders", "parquet", f"{snapshot}/tables/table=orders/data/*", ws.read("orders").schema
    )
    ws.restore(ws.archive(archive_ts="20240102000000"), skip_restore={"orders": True})
    return ws.table("old_orders")


# -- functions and scripts ---------------------------------------------------------------------


def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    routines.create_function(
        spark, ws.source, "net_price", "price DOUBLE, discount DOUBLE, tax DOUBLE", "DOUBLE",
        "price * (1 - discount) * (1 + tax)", "what a line costs"
    )
    ws.round_trip()
    ws.read("lineitem").createOrReplaceTempView(f"lineitem_{ws.tag}")
    return spark.sql(
        f"SELECT l_orderkey, l_linenumber, {ws.target}.net_price(l_extendedprice, l_discount, l_tax) AS v FROM lineitem_{ws.tag}"
    )


def tag_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that reads an event's JSON properties into a struct, used by a view through both of its names."""
    ws = Workspace(spark, sf_dir)
    ws.copy("events")
    routines.create_function(
        spark, ws.source, "event_facts", "kind STRING, props STRING, amount DOUBLE",
        "STRUCT<code: BIGINT, even: BOOLEAN, label: STRING, band: STRING>",
        "named_struct('code', CAST(get_json_object(props, '$.k') AS BIGINT), "
        "'even', CAST(get_json_object(props, '$.k') AS BIGINT) % 2 = 0, "
        "'label', concat_ws(':', kind, get_json_object(props, '$.k'), get_json_object(props, '$.missing')), "
        "'band', CASE WHEN amount < 10 THEN 'low' WHEN amount < 100 THEN 'middle' ELSE 'high' END)",
    )
    views.create_view(
        spark, f"{ws.source}.facts",
        f"SELECT event_id, f.code, f.even, f.label, f.band, event_facts(event_type, NULL, NULL).label AS bare "
        f"FROM (SELECT *, `{ws.source}`.event_facts(event_type, props, value) AS f FROM events)",
    )
    ws.round_trip()
    return ws.table("facts")


def python_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    name = f"doubled_{ws.tag}"
    routines.create_code_function(
        spark, ws.source, name, f"def {name}(values):\n    return values * 2\n", "double", [{"name": "values", "type": "double"}]
    )
    ws.round_trip(allow_code=True)
    return ws.read("lineitem").select("l_orderkey", "l_linenumber", F.expr(f"{name}(l_extendedprice)").alias("doubled"))


def script_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restored script that books a late fee for each order of a customer."""
    ws = Workspace(spark, sf_dir)
    ws.copy("orders")
    routines.create_script(
        spark, ws.source, "book_fees",
        "BEGIN DECLARE fee DECIMAL(9, 4); SET fee = :percent / 100.0; "
        f"INSERT INTO {ws.source}.orders SELECT -o_orderkey, o_custkey, 'X', "
        "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * fee AS DECIMAL(18, 2)), o_orderdate, 'fee' "
        f"FROM orders WHERE o_orderstatus = 'P'; SELECT count(*) AS booked FROM {ws.source}.orders WHERE o_orderstatus = 'X'; END",
        [{"name": "percent", "type": "bigint"}],
    )
    ws.round_trip()
    routines.run_script(spark, f"{ws.target}.book_fees", percent=5).collect()
    source = spark.table(f"{ws.source}.orders").withColumn("place", F.lit("source"))
    return ws.table("orders").withColumn("place", F.lit("target")).unionByName(source)


def script_relocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restored script that creates, fills, empties and drops tables of its own database, and leaves the source alone."""
    ws = Workspace(spark, sf_dir)
    ws.copy("nation", "region", "supplier")
    db = ws.source
    routines.create_script(
        spark, db, "rebuild",
        f"BEGIN CREATE TABLE IF NOT EXISTS {db}.nation_copy USING parquet AS SELECT * FROM {db}.nation; "
        f"INSERT INTO {db}.nation_copy SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM {db}.nation; "
        f"TRUNCATE TABLE {db}.region; DROP TABLE IF EXISTS {db}.supplier; "
        f"CREATE OR REPLACE VIEW {db}.names AS SELECT n_name FROM {db}.nation_copy; SELECT 1 AS done; END",
        [],
    )
    ws.round_trip()
    routines.run_script(spark, f"{ws.target}.rebuild").collect()

    def rows(database: str, table: str, column: str) -> DataFrame:
        found = spark.table(f"{database}.{table}") if spark.catalog.tableExists(f"{database}.{table}") else None
        label = F.lit("source" if database == ws.source else "target").alias("place")
        empty = spark.range(0).select(label, F.lit(table).alias("object"), F.lit("").alias("value"))
        return empty if found is None else found.select(label, F.lit(table).alias("object"), F.col(column).cast("string").alias("value"))

    parts = [rows(d, t, c) for d in (ws.source, ws.target) for t, c in (
        ("nation", "n_name"), ("nation_copy", "n_name"), ("region", "r_name"), ("supplier", "s_name"), ("names", "n_name"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def materialized_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A materialized view, a label and a required column whose names Spark takes for secrets, moved and refreshed."""
    ws = Workspace(spark, sf_dir)
    pages = ws.read("pages")
    write_table(
        spark, f"{ws.source}.pages", pages, labels={"token_owner": "who?url=1"},
        schema=schemas.annotate(pages.schema, ["url"]),
    )
    views.create_materialized_view(
        spark, f"{ws.source}.per_url", "SELECT url, count(*) AS pages, sum(length(html)) AS chars FROM pages GROUP BY url",
        enable_refresh=True, refresh_interval_seconds=60,
    )
    ws.round_trip()
    more = ws.read("pages").where("page_id % 2 = 0").withColumn("page_id", -F.col("page_id") - 1)
    write_table(spark, f"{ws.target}.pages", more, mode="append")
    views.refresh_materialized(spark, f"{ws.target}.per_url", datetime.datetime(2999, 1, 1))
    found = catalog.describe(spark, ws.target, "pages")
    return ws.table("per_url").withColumn("owner", F.lit(catalog.labels_of(found)["token_owner"])).withColumn(
        "required", F.lit(",".join(catalog.required_of(catalog.properties_of(found))))
    )


def overwrite_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table overwritten from its own content, and an overwrite that fails and leaves it as it was."""
    ws = Workspace(spark, sf_dir)
    ws.copy("customer")
    name = f"{ws.source}.customer"
    doubled = spark.table(name).unionByName(spark.table(name).withColumn("c_custkey", -F.col("c_custkey") - 1))
    write_table(spark, name, doubled, mode="overwrite")
    broken = spark.table(name).withColumn("c_name", F.when(F.col("c_custkey") > 0, F.raise_error(F.lit("no"))).otherwise(F.col("c_name")))
    try:
        write_table(spark, name, broken, mode="overwrite")
    except PySparkException:
        return spark.table(name)
    raise AssertionError("the failing overwrite passed")


def archive_stale_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view whose base was dropped is archived by its definition, and serves again once the base is back."""
    ws = Workspace(spark, sf_dir)
    ws.copy("supplier")
    views.create_view(spark, f"{ws.source}.rich", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
    spark.sql(f"DROP TABLE {ws.source}.supplier")
    status = archive_dataset(spark, ws.source, f"{ws.path}/archive")
    columns = manifest.read_manifest(spark, snapshot_of(status)).where("name = 'rich'").select(
        F.concat_ws(",", F.col("columns.name")).alias("columns"), "status"
    ).first()
    spark.sql(f"CREATE DATABASE {quoted(ws.target)} LOCATION {literal(f'{ws.path}/{ws.target}')}")
    write_table(spark, f"{ws.target}.supplier", ws.read("supplier"))
    restore_dataset(spark, snapshot_of(status), ws.target)
    return ws.table("rich").withColumn("archived", F.lit(columns["columns"])).withColumn("status", F.lit(columns["status"]))


def check_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown kinds and failing models are rows of the suite and do not end it."""
    sources = _source_views(spark, sf_dir, "orders")
    suite = [
        checks.Check("no_such_kind", "telepathy", "orders"),
        checks.Check("on_broken", "not_null", "broken", ("o_orderkey",)),
        checks.Check("keys", "unique", "orders", ("o_orderkey",)),
        checks.Check("status_known", "accepted_values", "orders", ("o_orderstatus",), values=("F", "O")),
    ]
    models = {"broken": f"SELECT no_such_column FROM {sources['orders']}"}
    found = checks.run_checks(spark, suite, continue_on_failure=True, sources=sources, models=models)
    return found.select("check", "status", "violations", F.col("message").contains("no_such_column").alias("names_column"))


# -- checks ------------------------------------------------------------------------------------


def _source_views(spark: SparkSession, sf_dir: str, *tables: str) -> dict[str, str]:
    """Given tables as temporary views with unique names, keyed by their own name."""
    tag = uuid.uuid4().hex[:10]
    for table in tables:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"{table}_{tag}")
    return {table: f"{table}_{tag}" for table in tables}


def check_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    suite = [
        checks.Check("price_known", "not_null", "orders", ("o_totalprice", "o_custkey"), tags=("daily",)),
        checks.Check("status_values", "accepted_values", "orders", ("o_orderstatus",), ("F", "O"), tags=("daily",)),
        checks.Check("price_limit", "predicate", "orders", sql="o_totalprice < :limit", tags=("daily",)),
        checks.Check("line_unique", "unique", "lineitem", ("l_orderkey", "l_linenumber"), tags=("daily",)),
        checks.Check("has_customer", "relationship", "orders", ("o_custkey",), to="customer", to_columns=("c_custkey",), tags=("daily",)),
        checks.Check("label_document", "relationship", "labels", ("doc_id",), to="documents", tags=("daily",)),
        checks.Check("turn_unique", "unique", "conversations", ("conv_id", "turn"), tags=("daily",), target="dev"),
        checks.Check("other_target", "not_null", "orders", ("o_orderkey",), tags=("daily",), target="prod"),
        checks.Check("other_tag", "not_null", "orders", ("o_orderkey",), tags=("weekly",)),
    ]
    sources = _source_views(spark, sf_dir, "orders", "lineitem", "customer", "labels", "documents", "conversations")
    return checks.run_checks(
        spark, suite, continue_on_failure=True, tags=["daily"], target="dev", variables={"limit": 400000.0}, sources=sources
    ).select("check", "status", "violations")


def check_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, sf_dir)
    ws.copy("events")
    model = f"{ws.source}.users"
    suite = [
        checks.Check("user_unique", "unique", model, ("user_id",)),
        checks.Check("user_active", "predicate", model, sql="events > 10"),
    ]
    return checks.run_checks(
        spark, suite, continue_on_failure=True,
        models={model: f"SELECT user_id, count(*) AS events FROM {ws.source}.events GROUP BY user_id"},
    ).select("check", "status", "violations")


def check_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return checks.orphan_rows(labels, ["doc_id"], spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])


def check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


def same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that went through CSV, held against its source; and against the source without some rows, one of them doubled."""
    _, name = _file_round_trip(spark, sf_dir, "lineitem", CSV)
    source, found = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.table(name)
    facts = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("left_rows"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("right_rows"), F.lit(0)).alias("right_rows"))
    planted = found.where("l_orderkey % 10 <> 3").unionByName(found.where("l_orderkey % 10 = 4 AND l_linenumber = 1"))
    return facts(checks.differing_rows(source, found)).withColumn("planted", F.lit(False)).unionByName(
        facts(checks.differing_rows(source, planted)).withColumn("planted", F.lit(True))
    )


def changed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, name = _file_round_trip(spark, sf_dir, "orders", PARQUET)
    changed = spark.table(name).withColumn(
        "o_totalprice", F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice"))
    )
    return checks.differing_rows(spark.read.parquet(f"{sf_dir}/orders.parquet"), changed)


# -- contract ----------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Archive a table and a view over it, restore both elsewhere, and query the restored view."""
    ws = Workspace(spark, "/root/testdata/sf0.001")
    ws.copy("orders")
    views.create_view(
        spark, f"{ws.source}.priorities",
        f"SELECT o_orderpriority, o_totalprice FROM {ws.source}.orders WHERE o_orderstatus <> 'P'",
    )
    ws.round_trip()
    return ws.table("priorities").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        f.__name__: f
        for f in (
            roundtrip_parquet, roundtrip_csv_schema, roundtrip_csv_text, roundtrip_csv_inferred, roundtrip_nested,
            format_mapping, datetime_restore, time_partition_day, time_partition_hour, time_partition_month,
            time_partition_year, range_partition, column_partition, partition_expiration, partition_expiration_later, guarded_read,
            guarded_range_read, archive_status, skip_restore, manifest_columns, snapshot_addressing,
            commit_index, restore_newest_snapshot, table_labels, view_union_except, view_chain, table_references,
            function_references, rewrite_references, rewrite_table_names, restore_waves, blocked_dependents, ready_nodes,
            external_requisites, materialized_refresh, materialized_partition, external_table, external_partitioned,
            external_over_snapshot, sql_function, tag_struct, python_function, script_insert,
            script_relocated, materialized_url, overwrite_table, archive_stale_view, check_errors, check_suite, check_build,
            check_relationship, check_unique, same_content, changed_content, required_nested, predicate_read, zone_map,
            materialized_incremental, chain_waves, restore_failures, script_values, tag_list,
        )
    }
    if llm is not None:
        found |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return found


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _numbered(form: str) -> str:
    """A SQL expression for a form with its number filled in."""
    return f"replace({_sql_text(form)}, '{{n}}', CAST(o_custkey AS VARCHAR))"


def _per_form(position: int) -> str:
    """``SELECT o_orderkey, reference`` over all names listed for the forms."""
    return " UNION ALL ".join(
        f"SELECT o_orderkey, {_numbered(name)} AS reference FROM orders WHERE o_orderpriority = {_sql_text(priority)}"
        for priority, form in _FORMS.items()
        for name in form[position]
    )


def _columns_sql(table: str, columns: list[tuple]) -> str:
    rows = []
    for pos, (name, kind, mode, description, default) in enumerate(columns):
        texts = [_sql_text(v) if v is not None else "CAST(NULL AS VARCHAR)" for v in (name, kind, mode, description, default)]
        rows.append(
            f"SELECT {_sql_text(table)} AS object, CAST({pos} AS BIGINT) AS pos, {texts[0]} AS name, {texts[1]} AS type, "
            f"{texts[2]} AS mode, {texts[3]} AS description, {texts[4]} AS default_expression, "
            f"(SELECT count(*) FROM {table}) AS rows"
        )
    return " UNION ALL ".join(rows)


def _plain(*columns: tuple[str, str]) -> list[tuple]:
    return [(name, kind, "NULLABLE", None, None) for name, kind in columns]


def oracle_sql() -> dict[str, str]:
    count = "(SELECT count(*) FROM {})"
    found = {
        "roundtrip_parquet": "SELECT * FROM orders",
        "roundtrip_csv_schema": "SELECT * FROM lineitem",
        "roundtrip_csv_text": "SELECT * FROM documents",
        "roundtrip_csv_inferred": "SELECT * FROM customer",
        "roundtrip_nested": "SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS BIGINT) AS pos, "
        "CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings",
        "format_mapping": " UNION ALL ".join(
            f"SELECT '{t}' AS name, '{f}' AS format, '{c}' AS compression, count(*) AS rows FROM {t}"
            for t, f, c in (("region", "csv", "gzip"), ("nation", "parquet", "snappy"), ("customer", "csv", "deflate"),
                            ("supplier", "parquet", "zstd"), ("orders", "parquet", "zstd"))
        ),
        "datetime_restore": "SELECT event_id, ts, user_id FROM events",
        "time_partition_day": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS part, count(*) AS n FROM events GROUP BY 1",
        "time_partition_hour": "SELECT CAST(date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS VARCHAR) AS part, "
        "count(*) AS n FROM events GROUP BY 1",
        "time_partition_month": "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS part, count(*) AS n FROM orders GROUP BY 1",
        "time_partition_year": "SELECT CAST(CAST(date_trunc('year', l_shipdate) AS DATE) AS VARCHAR) AS part, count(*) AS n FROM lineitem GROUP BY 1",
        "range_partition": "SELECT CASE WHEN c_custkey >= 0 AND c_custkey < 1000 THEN CAST(c_custkey // 100 * 100 AS VARCHAR) ELSE 'none' END AS part, "
        "count(*) AS n FROM customer GROUP BY 1",
        "column_partition": "SELECT * FROM customer",
        "partition_expiration": "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'",
        "partition_expiration_later": "SELECT *, 0::BIGINT AS again FROM events WHERE ts >= TIMESTAMP '2024-01-15'",
        "guarded_read": "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-10' "
        "AND l_shipdate < TIMESTAMP '1997-02-03' AND l_quantity > 10",
        "guarded_range_read": "SELECT * FROM customer WHERE c_custkey BETWEEN 250 AND 1200",
        "archive_status": " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, '{name}' AS name, 'OK' AS archived, {archived} AS archived_rows, "
            f"'OK' AS restored, {restored} AS restored_rows"
            for kind, name, archived, restored in (
                *(("table", t, count.format(t), count.format(t)) for t in ("orders", "customer", "events")),
                ("external_table", "part", "-1", "-1"),
                ("view", "open_orders", "-1", "-1"),
                ("materialized_view", "segments", "-1",
                 "(SELECT count(DISTINCT c_mktsegment) FROM customer)"),
                ("function", "twice", "-1", "-1"),
                ("stored_procedure", "noop", "-1", "-1"),
            )
        ),
        "skip_restore": " UNION ALL ".join(
            f"SELECT '{t}' AS name, '{s}' AS status, {count.format(t) if s == 'OK' else '-1'} AS rows"
            for t, s in (("region", "OK"), ("nation", "OK"), ("customer", "OK"), ("supplier", "OK"), ("part", "SKIPPED"),
                         ("orders", "SKIPPED"), ("lineitem", "OK"))
        ),
        "manifest_columns": " UNION ALL ".join(
            (
                _columns_sql("nation", _plain(("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))),
                _columns_sql("orders", _plain(
                    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))),
                _columns_sql("embeddings", [("vec_id", "bigint", "NULLABLE", None, None), ("embedding", "float", "REPEATED", None, None),
                                            ("label", "int", "NULLABLE", None, None)]),
                _columns_sql("customer", [
                    ("c_custkey", "bigint", "REQUIRED", None, None), ("c_name", "string", "NULLABLE", "full name", None),
                    ("c_nationkey", "int", "NULLABLE", None, None), ("c_acctbal", "double", "NULLABLE", None, None),
                    ("c_mktsegment", "string", "NULLABLE", None, "'NONE'")]),
            )
        ),
        "snapshot_addressing": " UNION ALL ".join(
            f"SELECT '{ts}' AS archive_ts, '{name}' AS name, {rows} AS rows, {newest} AS newest"
            for ts, name, rows, newest in (
                ("20240101000000", "nation", count.format("nation"), "FALSE"),
                ("20240101000000", "events", count.format("events"), "FALSE"),
                ("20240201000000", "nation", count.format("nation"), "TRUE"),
                ("20240201000000", "events",
                 "(SELECT count(*) + count(*) FILTER (WHERE event_type = 'click') FROM events)", "TRUE"),
            )
        ),
        "commit_index": "SELECT '20240102000000' AS archive_ts, name, rows, 1::BIGINT AS added, '20240102000000' AS listed FROM "
        "(SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders)",
        "restore_newest_snapshot": "SELECT * FROM labels UNION ALL SELECT * FROM labels",
        "table_labels": "SELECT *, 'who delivers' AS description, 'supply' AS team, '20240101000000' AS archive_ts FROM supplier",
        "view_union_except": "SELECT DISTINCT o_custkey AS party, 'buyer' AS role FROM orders UNION ALL SELECT s_suppkey, 'seller' FROM supplier "
        "UNION ALL SELECT c_custkey, c_mktsegment FROM customer",
        "view_chain": "SELECT n_name, o_orderpriority, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey "
        "JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY n_name, o_orderpriority",
        "table_references": "SELECT o_orderkey, reference, CASE length(reference) - length(replace(reference, '.', '')) "
        f"WHEN 2 THEN reference WHEN 1 THEN 'p.' || reference ELSE 'p.d.' || reference END AS full_name FROM ({_per_form(1)})",
        "function_references": _per_form(3),
        "rewrite_references": "SELECT o_orderkey, CASE o_orderpriority "
        + " ".join(f"WHEN {_sql_text(p)} THEN {_numbered(form[2])}" for p, form in _FORMS.items())
        + " END AS sql FROM orders",
        "rewrite_table_names": "SELECT o_orderkey, 'SELECT clean.a, `s-2`.clean.b, x.c FROM clean JOIN `s-2`.clean "
        "ON clean.k = `s-2`.clean.k JOIN q.s.t' || CAST(o_custkey AS VARCHAR) || ' x WHERE c = ''raw ' "
        "|| o_orderpriority || chr(39) || ' -- raw' AS sql FROM orders",
        "restore_waves": "WITH RECURSIVE up(key, place, steps) AS (SELECT o_orderkey, o_orderkey, CAST(0 AS BIGINT) FROM orders "
        "UNION ALL SELECT key, place // 2, steps + 1 FROM up WHERE place > 0) SELECT key, max(steps) AS wave FROM up GROUP BY key",
        "blocked_dependents": "WITH RECURSIVE failed AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'P' "
        "AND o_totalprice > 450000 AND o_orderpriority = '1-URGENT'), "
        "up(key, place) AS (SELECT o_orderkey, o_orderkey // 2 FROM orders WHERE o_orderkey > 0 "
        "UNION ALL SELECT key, place // 2 FROM up WHERE place > 0) "
        "SELECT up.key, min(up.place) AS failed_requisite FROM up JOIN failed ON up.place = failed.key "
        "WHERE up.key NOT IN (SELECT key FROM failed) GROUP BY up.key",
        "ready_nodes": "SELECT o.o_orderkey AS key FROM orders o LEFT JOIN orders r ON r.o_orderkey = o.o_orderkey // 2 AND o.o_orderkey > 0 "
        "WHERE o.o_orderstatus = 'P' AND (r.o_orderkey IS NULL OR r.o_orderstatus <> 'P')",
        "external_requisites": "SELECT DISTINCT o_custkey AS key, o_orderkey AS requisite FROM orders "
        "WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_orderkey AND NOT c_acctbal < 0)",
        "materialized_refresh": "SELECT c_nationkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue "
        "FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F') "
        "JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
        "materialized_partition": "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS part, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY 1",
        "external_table": "SELECT * FROM part",
        "external_partitioned": "SELECT * FROM customer",
        "external_over_snapshot": "SELECT * FROM orders",
        "sql_function": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS v FROM lineitem",
        "tag_struct": "SELECT event_id, k AS code, k % 2 = 0 AS even, event_type || ':' || k AS label, CASE WHEN value < 10 THEN 'low' "
        "WHEN value < 100 THEN 'middle' ELSE 'high' END AS band, event_type AS bare "
        "FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
        "python_function": "SELECT l_orderkey, l_linenumber, l_extendedprice * 2 AS doubled FROM lineitem",
        "script_insert": "SELECT *, 'source' AS place FROM orders UNION ALL SELECT *, 'target' FROM orders UNION ALL "
        "SELECT -o_orderkey, o_custkey, 'X', CAST(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * CAST(0.05 AS DECIMAL(9, 4)) AS DECIMAL(18, 2)) AS DOUBLE), "
        "o_orderdate, 'fee', 'target' FROM orders WHERE o_orderstatus = 'P'",
        "script_relocated": "SELECT place, 'nation' AS object, n_name AS value FROM nation, (VALUES ('source'), ('target')) AS p(place) "
        "UNION ALL SELECT 'target', o, n FROM (SELECT n_name AS n FROM nation UNION ALL SELECT upper(n_name) FROM nation), "
        "(VALUES ('nation_copy'), ('names')) AS v(o) UNION ALL SELECT 'source', 'region', r_name FROM region "
        "UNION ALL SELECT 'source', 'supplier', s_name FROM supplier",
        "materialized_url": "SELECT url, count(*) AS pages, sum(length(html))::BIGINT AS chars, 'who?url=1' AS owner, 'url' AS required FROM "
        "(SELECT url, html FROM pages UNION ALL SELECT url, html FROM pages WHERE page_id % 2 = 0) GROUP BY url",
        "overwrite_table": "SELECT * FROM customer UNION ALL SELECT -c_custkey - 1, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
        "archive_stale_view": "SELECT s_suppkey, s_name, s_acctbal, 's_suppkey,s_name,s_acctbal' AS archived, 'OK' AS status FROM supplier WHERE s_acctbal > 0",
        "check_errors": "SELECT \"check\", status, violations::BIGINT AS violations, names_column FROM (VALUES ('no_such_kind', 'ERROR', NULL, FALSE), "
        "('on_broken', 'ERROR', NULL, TRUE)) AS v(\"check\", status, violations, names_column) UNION ALL "
        "SELECT 'keys', 'PASS', 0::BIGINT, NULL UNION ALL SELECT 'status_known', 'FAIL', count(*), FALSE FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
        "check_suite": "SELECT \"check\", CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status, violations FROM ("
        "SELECT 'price_known' AS \"check\", count(*) AS violations FROM orders WHERE o_totalprice IS NULL OR o_custkey IS NULL "
        "UNION ALL SELECT 'status_values', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') "
        "UNION ALL SELECT 'price_limit', count(*) FROM orders WHERE NOT coalesce(o_totalprice < 400000, FALSE) "
        "UNION ALL SELECT 'line_unique', coalesce(CAST(sum(n) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) "
        "UNION ALL SELECT 'has_customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) "
        "UNION ALL SELECT 'label_document', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) "
        "UNION ALL SELECT 'turn_unique', coalesce(CAST(sum(n) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1))",
        "check_build": "SELECT \"check\", CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status, violations FROM ("
        "SELECT 'user_unique' AS \"check\", count(*) - count(*) AS violations FROM events "
        "UNION ALL SELECT 'user_active', count(*) FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) <= 10))",
        "check_relationship": "SELECT doc_id, count(*) AS rows FROM documents d "
        "WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY doc_id",
        "check_unique": "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
        "same_content": "WITH l AS (SELECT *, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, n * (CASE WHEN l_orderkey % 10 = 3 THEN 0 "
        "WHEN l_orderkey % 10 = 4 AND l_linenumber = 1 THEN 2 ELSE 1 END) AS m FROM l) "
        "SELECT 0::BIGINT AS n, 0::BIGINT AS left_rows, 0::BIGINT AS right_rows, FALSE AS planted "
        "UNION ALL SELECT count(*), coalesce(sum(n), 0)::BIGINT, coalesce(sum(m), 0)::BIGINT, TRUE FROM r WHERE n <> m",
        "required_nested": "SELECT conv_id, turn, role, text, 'conv_id,talk.turns.[],talk.turns.[].turn' AS required FROM conversations",
        "predicate_read": "SELECT * FROM events WHERE (dayofweek(ts) = 1 OR ts::DATE = DATE '2024-01-03') AND ts < TIMESTAMP '2024-01-20'",
        "zone_map": "SELECT date_trunc('month', l_shipdate)::DATE AS month, count(*) AS rows, min(l_shipdate) AS low, max(l_shipdate) AS high, "
        "0::BIGINT AS nulls FROM (SELECT l_shipdate FROM lineitem UNION ALL SELECT l_shipdate FROM lineitem WHERE l_linenumber = 1) GROUP BY 1",
        "materialized_incremental": "SELECT o_orderpriority, count(*) AS orders, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, max(o_orderdate) AS last, "
        "TRUE AS by_files FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey % 2 = 0 GROUP BY o_orderpriority",
        "chain_waves": "SELECT o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS wave FROM orders",
        "restore_failures": "SELECT go_on, kind, name, status, CASE WHEN name = 'customer' THEN (SELECT count(*) FROM customer) ELSE -1 END AS rows FROM (VALUES "
        "(TRUE, 'table', 'orders', 'SKIPPED'), (TRUE, 'table', 'customer', 'OK'), (TRUE, 'view', 'open_orders', 'FAILED'), "
        "(TRUE, 'view', 'open_customers', 'BLOCKED'), (TRUE, 'view', 'rich', 'OK'), (TRUE, 'stored_procedure', 'noop', 'OK'), "
        "(FALSE, 'table', 'orders', 'SKIPPED'), (FALSE, 'table', 'customer', 'OK'), (FALSE, 'view', 'open_orders', 'FAILED'), "
        "(FALSE, 'view', 'open_customers', 'NOT_RUN'), (FALSE, 'view', 'rich', 'NOT_RUN'), (FALSE, 'stored_procedure', 'noop', 'NOT_RUN')"
        ") AS v(go_on, kind, name, status)",
        "script_values": "SELECT * FROM supplier UNION ALL SELECT -1, '- of ' || count(*) || ' suppliers', NULL, NULL FROM supplier",
        "tag_list": "SELECT event_id, event_type AS action, (user_id + 1)::VARCHAR AS account, NULL::VARCHAR AS missing FROM events",
        "changed_content": "SELECT *, CAST(1 AS BIGINT) AS left_rows, CAST(0 AS BIGINT) AS right_rows FROM orders WHERE o_orderstatus = 'P' AND o_totalprice <> 0 "
        "UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 0.0, o_orderdate, o_orderpriority, 0, 1 FROM orders WHERE o_orderstatus = 'P' AND o_totalprice <> 0",
    }
    if llm is not None:
        found |= llm.oracle_sql()
    return found
