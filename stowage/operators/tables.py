"""Tables: create, read, snapshot to files and load from files."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterable, Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.errors import ObjectExists, StowageError
from stowage.operators import partitions as parts
from stowage.operators import zones
from stowage.operators.partitions import PartitionConfig
from stowage.session import literal, properties_clause, quoted
from stowage.sources import catalog, formats, schemas
from stowage.sources.formats import FileFormat


def split_name(spark: SparkSession, name: str) -> tuple[str, str]:
    database, _, table = name.rpartition(".")
    return database or spark.catalog.currentDatabase(), table


def drop_object(spark: SparkSession, database: str, name: str) -> None:
    """Drop a table or view, with the storage table behind it if it has one."""
    if not spark.catalog.tableExists(quoted(database, name)):
        return
    description = catalog.describe(spark, database, name)
    kind = "VIEW" if description.get("type") == "VIEW" else "TABLE"
    spark.sql(f"DROP {kind} IF EXISTS {quoted(database, name)}")
    storage = catalog.properties_of(description).get(catalog.STORAGE)
    for table in (storage, catalog.properties_of(description).get(catalog.PREVIOUS)):
        if table:
            _drop_storage(spark, database, table)


def _drop_storage(spark: SparkSession, database: str, storage: str) -> None:
    for table in (storage, zones.map_of(storage)):
        spark.sql(f"DROP TABLE IF EXISTS {quoted(database, table)}")


def create_physical(df: DataFrame, database: str, name: str, partition_columns: Iterable[str],
                    properties: Mapping[str, str], description: str | None = None) -> int:
    """Write ``df`` as a parquet table in one job and return its row count.

    The table appears in the catalog only after its data is committed. Rows are counted while
    they are written.
    """
    counted = Observation(f"rows-{uuid.uuid4().hex}")
    writer = (
        df.observe(counted, F.count(F.lit(1)).alias("rows"))
        .writeTo(quoted(database, name))
        .using("parquet")
        .option("compression", "zstd")
    )
    for key, value in catalog.stored(properties).items():
        writer = writer.tableProperty(key, value)
    columns = [F.col(quoted(c)) for c in partition_columns]
    if columns:
        writer = writer.partitionedBy(*columns)
    writer.create()
    if description:
        df.sparkSession.sql(f"COMMENT ON TABLE {quoted(database, name)} IS {literal(description)}")
    return counted.get["rows"]


def view_columns(schema: T.StructType) -> str:
    """Column list of a CREATE VIEW, with comments."""
    return ", ".join(
        quoted(f.name) + (f" COMMENT {literal(f.metadata['comment'])}" if f.metadata.get("comment") else "")
        for f in schema
    )


def publish(spark: SparkSession, database: str, name: str, df: DataFrame, schema: T.StructType,
            partition: PartitionConfig | None, properties: Mapping[str, str], description: str | None,
            clustered: bool = False) -> int:
    """Write a storage table and put a view over it that shows exactly the columns of ``schema``.

    Replacing the view is the last step, so readers see the old content or the new, and a failed
    write leaves the old content in place. The storage table of the previous content stays for readers that are still at
    it, and is dropped when the view is replaced again.
    """
    previous = before = None
    if spark.catalog.tableExists(quoted(database, name)):
        found = catalog.properties_of(catalog.describe(spark, database, name))
        previous, before = found.get(catalog.STORAGE), found.get(catalog.PREVIOUS)
    storage = f"{name}__{uuid.uuid4().hex[:12]}"
    physical: tuple[str, ...] = ()
    if partition is not None:
        if partition.is_derived and parts.HIDDEN_COLUMN not in df.columns:
            df = parts.add_partition_column(df, partition)
        physical = partition.physical_columns
        if not clustered:
            df = parts.cluster_for_write(df, partition)
        df = parts.sorted_for_write(df, partition)
    rows = create_physical(df, database, storage, physical, {catalog.STORAGE_OF: name})
    if partition is not None and partition.is_derived:
        zones.write_map(spark, database, storage, name, [partition.field])
    selected = ", ".join(quoted(f.name) for f in schema)
    comment = f"COMMENT {literal(description)}" if description else ""
    spark.sql(
        f"CREATE OR REPLACE VIEW {quoted(database, name)} ({view_columns(schema)}) {comment} "
        f"TBLPROPERTIES {properties_clause(catalog.stored({**properties, catalog.STORAGE: storage, **({catalog.PREVIOUS: previous} if previous else {})}))} "
        f"AS SELECT {selected} FROM {quoted(database, storage)}"
    )
    if before:
        _drop_storage(spark, database, before)
    return rows


def write_table(
    spark: SparkSession,
    name: str,
    df: DataFrame,
    partition: PartitionConfig | None = None,
    description: str | None = None,
    labels: Mapping[str, str] | None = None,
    schema: T.StructType | None = None,
    mode: str = "error",
    clustered: bool = False,
) -> int:
    """Create a table from ``df`` and return its row count.

    ``schema`` carries column attributes (see :func:`stowage.sources.schemas.annotate`); columns it
    marks as not nullable are checked while the rows are written. ``mode`` is ``error``,
    ``overwrite`` or ``append``. ``clustered`` says that each task already holds few partitions.
    """
    database, table = split_name(spark, name)
    if mode not in ("error", "overwrite", "append"):
        raise StowageError(f"unknown mode {mode!r}")
    # Without a schema nothing is required, even where Spark infers that an expression is never NULL.
    schema = schema or schemas.from_json(schemas.to_json(df.schema))
    if spark.catalog.tableExists(quoted(database, table)):
        if mode == "error":
            raise ObjectExists(f"{database}.{table} exists")
        if mode == "append":
            return append_rows(spark, database, table, df)
        behind_view = catalog.STORAGE in catalog.properties_of(catalog.describe(spark, database, table))
        if not (behind_view and partition is not None and partition.is_derived):
            return _replace_table(spark, database, table, df, partition, description, labels, schema, clustered)

    hidden = parts.HIDDEN_COLUMN if parts.HIDDEN_COLUMN in df.columns else None
    visible = T.StructType([f for f in schema if f.name != hidden])
    carried = T.StructType(visible.fields + ([df.schema[hidden]] if hidden else []))
    df = schemas.with_attributes(df, carried)
    properties = dict(labels or {})
    required = schemas.required_columns(visible)
    if required:
        properties[catalog.REQUIRED] = json.dumps(required)
    if partition is not None:
        properties[catalog.PARTITION] = partition.to_json()
    if partition is not None and partition.is_derived:
        properties[catalog.KIND] = "table"
        return publish(spark, database, table, df, visible, partition, properties, description, clustered)
    physical: tuple[str, ...] = ()
    if partition is not None:
        physical = partition.physical_columns
        if not clustered:
            df = parts.cluster_for_write(df, partition)
    return create_physical(df, database, table, physical, properties, description)


def _replace_table(spark: SparkSession, database: str, table: str, df: DataFrame, partition: PartitionConfig | None,
                   description: str | None, labels: Mapping[str, str] | None, schema: T.StructType, clustered: bool) -> int:
    """Write new content beside the old, which may be read on the way, and put it in its place.

    A table of the same columns without partitions is moved to the new files in one catalog operation: readers see the old
    content or the new and never miss the table. The old files stay until the next overwrite. Other tables
    are dropped and the new one renamed; what a crash leaves between the two, :func:`recover_overwrites` puts right.
    """
    recover_overwrites(spark, database, table)
    staged = f"{table}__{uuid.uuid4().hex[:12]}"
    marked = {**(labels or {}), catalog.REPLACES: table}
    rows = write_table(spark, f"{database}.{staged}", df, partition, description, marked, schema, "error", clustered)
    old, new = (catalog.describe(spark, database, t) for t in (table, staged))
    plain = all(d.get("type") == "MANAGED" and not d.get("partition_columns") and d.get("provider") == "parquet" for d in (old, new))
    same = [(f.name, f.dataType) for f in spark.table(quoted(database, table)).schema] == [(f.name, f.dataType) for f in spark.table(quoted(database, staged)).schema]
    if plain and same:
        was = catalog.properties_of(old)
        spark.sql(f"ALTER TABLE {quoted(database, table)} SET LOCATION {literal(new['location'])}")
        # From here on the staged name stands for the old files; the next overwrite drops them.
        spark.sql(f"ALTER TABLE {quoted(database, staged)} SET LOCATION {literal(old['location'])}")
        if was.get(catalog.PREVIOUS):
            spark.sql(f"DROP TABLE IF EXISTS {quoted(database, was[catalog.PREVIOUS])}")
        now = {k: v for k, v in catalog.properties_of(new).items() if k != catalog.REPLACES}
        gone = [k for k in was if k not in now and k != catalog.PREVIOUS]
        if gone:
            spark.sql(f"ALTER TABLE {quoted(database, table)} UNSET TBLPROPERTIES IF EXISTS ({', '.join(literal(k) for k in gone)})")
        spark.sql(f"ALTER TABLE {quoted(database, table)} SET TBLPROPERTIES {properties_clause(catalog.stored({**now, catalog.PREVIOUS: staged}))}")
        spark.sql(f"ALTER TABLE {quoted(database, staged)} SET TBLPROPERTIES {properties_clause(catalog.stored({catalog.STORAGE_OF: table}))}")
        spark.sql(f"COMMENT ON TABLE {quoted(database, table)} IS {literal(description) if description else 'NULL'}")
        return rows
    drop_object(spark, database, table)
    _rename(spark, database, staged, table)
    return rows


def _rename(spark: SparkSession, database: str, staged: str, table: str) -> None:
    kind = "VIEW" if catalog.describe(spark, database, staged).get("type") == "VIEW" else "TABLE"
    spark.sql(f"ALTER {kind} {quoted(database, staged)} RENAME TO {quoted(database, table)}")
    _follow(spark, database, table)
    spark.sql(f"ALTER {kind} {quoted(database, table)} UNSET TBLPROPERTIES IF EXISTS ({', '.join(literal(k) for k in catalog.stored({catalog.REPLACES: ''}))})")


def _follow(spark: SparkSession, database: str, table: str) -> None:
    """Point the partitions of a renamed table at its folder, where a catalog has moved the folder and not them."""
    found = catalog.describe(spark, database, table)
    if not found.get("partition_columns") or found.get("type") == "VIEW":
        return
    for row in spark.sql(f"SHOW PARTITIONS {quoted(database, table)}").collect():
        pairs = [part.split("=", 1) for part in row.partition.split("/")]
        spec = ", ".join(f"{quoted(unquote(name))} = {literal(unquote(value))}" for name, value in pairs)
        lines = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(database, table)} PARTITION ({spec})").collect()
        if next(r.data_type for r in lines if r.col_name == "Location").startswith(found["location"].rstrip("/") + "/"):
            continue
        spark.sql(f"ALTER TABLE {quoted(database, table)} PARTITION ({spec}) SET LOCATION {literal(found['location'].rstrip('/') + '/' + row.partition)}")


def recover_overwrites(spark: SparkSession, database: str, table: str) -> bool:
    """Put a table in place whose overwrite was cut off after the old one was dropped; tells whether there was one."""
    if spark.catalog.tableExists(quoted(database, table)):
        return False
    for found in spark.catalog.listTables(database, f"{table}__*"):
        if not found.isTemporary and catalog.properties_of(catalog.describe(spark, database, found.name)).get(catalog.REPLACES) == table:
            _rename(spark, database, found.name, table)
            return True
    return False


def append_rows(spark: SparkSession, database: str, table: str, df: DataFrame) -> int:
    """Add rows to an existing table, through its storage table if it has one."""
    found = catalog.describe(spark, database, table)
    properties = catalog.properties_of(found)
    config = partition_of(found)
    schema = schemas.from_json(
        schemas.to_json(spark.table(quoted(database, table)).schema, catalog.required_of(properties))
    )
    df = schemas.with_attributes(df, schema)
    target = table
    if config is not None and config.is_derived:
        target = properties[catalog.STORAGE]
        df = parts.add_partition_column(df, config)
    if config is not None:
        df = parts.sorted_for_write(parts.cluster_for_write(df, config), config)
    counted = Observation(f"rows-{uuid.uuid4().hex}")
    in_order = [F.col(quoted(c)) for c in spark.table(quoted(database, target)).columns]
    df.select(in_order).observe(counted, F.count(F.lit(1)).alias("rows")).write.insertInto(quoted(database, target))
    if target != table:
        zones.extend_map(spark, database, target)
    return counted.get["rows"]


def partition_of(description: dict) -> PartitionConfig | None:
    """The partitioning an object was created with."""
    text = catalog.properties_of(description).get(catalog.PARTITION)
    if text:
        return PartitionConfig.from_json(text)
    columns = description.get("partition_columns")
    return parts.column_partition(*columns) if columns else None


def read_table(spark: SparkSession, name: str, filters: Iterable[parts.Filter | Column] = (), where: str | None = None) -> DataFrame:
    """Read a table, leaving out partitions and files by ``filters`` and ``where``.

    ``filters`` is a conjunction of ``(column, operator, value)`` with operators ``= > >= < <= in between``, and of columns
    that hold any predicate. The former bound the partitions and, by the zone map, the files that are opened; the latter
    are first evaluated over the columns they read, to find the partitions with rows that meet them. ``where`` is a SQL
    predicate on top, which Spark pushes down to row groups. A table that requires a partition filter raises unless one
    of them reads its partition field.
    """
    database, table = split_name(spark, name)
    filters = list(filters)
    triples = [f for f in filters if not isinstance(f, Column)]
    predicates = [f for f in filters if isinstance(f, Column)]
    found = catalog.describe(spark, database, table)
    config = partition_of(found)
    visible = spark.table(quoted(database, table))
    given = [*predicates, *([F.expr(where)] if where else [])]
    if config is not None and config.require_filter:
        named = {f[0] for f in triples} | {config.field for p in given if parts.names_column(visible, p, config.field)}
        parts.require_partition_filter(f"{database}.{table}", config, named)
    df = visible
    if config is not None and config.is_derived:
        storage = catalog.properties_of(found)[catalog.STORAGE]
        files = zones.matching_files(spark, database, storage, triples)
        df = spark.table(quoted(database, storage)) if files is None else zones.read_files(spark, database, storage, files)
    predicate = parts.filter_predicate(triples, visible.schema, config)
    if predicate is not None:
        df = df.filter(predicate)
    if config is not None and config.is_derived:
        for one in predicates:
            if parts.names_column(visible, one, config.field):
                df = df.filter(parts.touched_partitions(df, one))
    for one in given:
        df = df.filter(one)
    return df.select([F.col(quoted(c)) for c in visible.columns])


def expire_partitions(spark: SparkSession, name: str, as_of: datetime.datetime) -> int:
    """Drop the partitions of a table that have expired at ``as_of`` and return how many there were.

    The partition list of the catalog tells which they are, so no data file is opened. Rows without a partition
    stay. What is kept from is recorded on the table; a second call at the same time drops nothing.
    """
    database, table = split_name(spark, name)
    found = catalog.describe(spark, database, table)
    config = partition_of(found)
    kept = parts.retention_predicate(config, as_of) if config is not None else None
    if kept is None:
        return 0
    storage = catalog.properties_of(found)[catalog.STORAGE]
    kind = spark.table(quoted(database, storage)).schema[parts.HIDDEN_COLUMN].dataType
    listed = spark.sql(f"SHOW PARTITIONS {quoted(database, storage)}")
    value = F.regexp_extract("partition", "=(.*)$", 1)
    told = listed.select(value.alias("text"), F.when(value != "__HIVE_DEFAULT_PARTITION__", value).cast(kind).alias(parts.HIDDEN_COLUMN))
    expired = [r.text for r in told.where(~kept).collect()]
    if expired:
        specs = ", ".join(f"PARTITION ({quoted(parts.HIDDEN_COLUMN)} = {literal(v)})" for v in expired)
        spark.sql(f"ALTER TABLE {quoted(database, storage)} DROP IF EXISTS {specs}")
        zones.shrink_map(spark, database, storage, expired)
    spark.sql(f"ALTER VIEW {quoted(database, table)} SET TBLPROPERTIES {properties_clause(catalog.stored({catalog.KEPT_FROM: as_of.isoformat()}))}")
    return len(expired)


def snapshot_table(df: DataFrame, path: str, fmt: FileFormat, partition: PartitionConfig | None = None) -> dict:
    """Write all rows of ``df`` to files: a map-only job, one pass, counting rows as it goes.

    A partitioned table keeps its partition directories in the archive, so that a later load needs
    no shuffle and a retention bound skips whole directories.
    """
    formats.check_storable(df.schema, fmt)
    physical = partition.physical_columns if partition is not None else ()
    seen = Observation(f"snapshot-{uuid.uuid4().hex}")
    observed = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), formats.has_line_break(df, fmt, physical).alias("multi_line")
    )
    formats.writer(formats.encode(observed, fmt, physical), fmt, physical).save(path)
    return seen.get


def read_snapshot(spark: SparkSession, path: str, fmt: FileFormat, schema: T.StructType | None = None,
                  partition: PartitionConfig | None = None, multi_line: bool = True) -> DataFrame:
    """Rows of an archived table. Without a schema it is inferred from the files."""
    if schema is None:
        return formats.reader(spark, fmt, None, multi_line).load(path)
    physical = partition.physical_columns if partition is not None else ()
    df = formats.reader(spark, fmt, formats.stored_schema(schema, fmt, physical), multi_line).load(path)
    return formats.decode(df, schema, fmt, physical)


def physical_schema(schema: T.StructType, partition: PartitionConfig | None) -> T.StructType:
    """The visible columns plus the derived partition column, typed as archived."""
    if partition is None or not partition.is_derived:
        return schema
    day = partition.category == "TIME" and partition.unit != "HOUR"
    return T.StructType(
        schema.fields + [T.StructField(parts.HIDDEN_COLUMN, T.DateType() if day else T.LongType(), True)]
    )


def load_table(
    spark: SparkSession,
    name: str,
    path: str,
    fmt: FileFormat,
    schema: T.StructType | None = None,
    partition: PartitionConfig | None = None,
    multi_line: bool = True,
    as_of: datetime.datetime | None = None,
    description: str | None = None,
    labels: Mapping[str, str] | None = None,
    mode: str = "error",
) -> int:
    """Load archived files into a table and return its row count.

    Casting text back, checking required columns, retention and partitioning happen in the one
    job that writes the table. ``as_of`` turns on retention for partitions with an expiration.
    """
    stored = physical_schema(schema, partition) if schema is not None else None
    df = read_snapshot(spark, path, fmt, stored, partition, multi_line)
    if schema is not None and partition is not None:
        kept = parts.retention_predicate(partition, as_of)
        if kept is not None:
            df = df.filter(kept)
    return write_table(
        spark, name, df, partition, description, labels, schema, mode, clustered=partition is not None and schema is not None
    )
