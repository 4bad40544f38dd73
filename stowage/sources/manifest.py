"""The manifest: one row per archived object."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.errors import SnapshotIncomplete, VersionMismatch
from stowage.session import small_frame
from stowage.sources import layout

METADATA_VERSION = "v1"


def fields(**types: T.DataType) -> T.StructType:
    """A struct of nullable fields; unlike a DDL text it needs no running session."""
    return T.StructType([T.StructField(name, data_type) for name, data_type in types.items()])


_TEXT, _COUNT, _FLAG = T.StringType(), T.LongType(), T.BooleanType()
_TEXTS = T.MapType(_TEXT, _TEXT)
ARGUMENTS = T.ArrayType(fields(name=_TEXT, type=_TEXT))

OBJECT_SCHEMA = fields(
    kind=_TEXT, name=_TEXT, status=_TEXT, error=_TEXT,
    metadata_version=_TEXT, archiver_version=_TEXT, object_count=_COUNT,
    description=_TEXT, labels=_TEXTS,
    schema_json=_TEXT,
    columns=T.ArrayType(fields(name=_TEXT, type=_TEXT, mode=_TEXT, description=_TEXT, default_expression=_TEXT)),
    format=_TEXT, compression=_TEXT, data_path=_TEXT, rows=_COUNT, multi_line=_FLAG,
    partition=fields(
        category=_TEXT, field=_TEXT, unit=_TEXT, expiration_ms=_COUNT, require_filter=_FLAG,
        range=T.ArrayType(_COUNT), columns=T.ArrayType(_TEXT),
    ),
    query=_TEXT, namespace=_TEXT, enable_refresh=_FLAG, refresh_interval_seconds=_COUNT,
    provider=_TEXT, location=_TEXT, options=_TEXTS,
    language=_TEXT, body=_TEXT, arguments=ARGUMENTS, arguments_sql=_TEXT, return_type=_TEXT,
    imported_libraries=T.ArrayType(_TEXT),
)
ADDRESS_SCHEMA = fields(project=_TEXT, dataset=_TEXT, archive_ts=_TEXT)
COMMIT_SCHEMA = T.StructType(ADDRESS_SCHEMA.fields + fields(metadata_version=_TEXT, object_count=_COUNT).fields)
MANIFEST_SCHEMA = T.StructType(OBJECT_SCHEMA.fields + ADDRESS_SCHEMA.fields)


def object_row(kind: str, name: str, **values) -> dict:
    """A manifest row with every field present."""
    row = dict.fromkeys(OBJECT_SCHEMA.names)
    row.update(kind=kind, name=name, metadata_version=METADATA_VERSION, archiver_version=METADATA_VERSION, status="OK")
    row.update(values)
    return row


def write_manifest(spark: SparkSession, snapshot: str, rows: list[dict]) -> None:
    """Write the object files, then ``dataset.json``.

    ``dataset.json`` comes last and every row says how many rows it must hold, so a reader can
    tell a committed snapshot from a broken one whatever the file system.
    """
    rows = [{**row, "object_count": len(rows)} for row in rows]
    df = small_frame(spark, [tuple(row[n] for n in OBJECT_SCHEMA.names) for row in rows], OBJECT_SCHEMA)
    for kind in sorted({row["kind"] for row in rows} & set(layout.KIND_DIRECTORIES)):
        directory, key = layout.KIND_DIRECTORIES[kind]
        (
            df.filter(F.col("kind") == kind)
            .withColumn(key, F.col("name"))
            .write.mode("append")
            .partitionBy(key)
            .json(f"{snapshot}/{directory}")
        )
    df.write.json(f"{snapshot}/{layout.MANIFEST}")
    _index(spark, layout.prefix_of(snapshot), [(*layout.address_of(snapshot), _archive_ts(snapshot), METADATA_VERSION, len(rows))])


def _archive_ts(snapshot: str) -> str:
    return snapshot.rstrip("/").rpartition("archive_ts=")[2]


def _index(spark: SparkSession, prefix: str, rows: list[tuple]) -> None:
    small_frame(spark, rows, COMMIT_SCHEMA).coalesce(1).write.mode("append").json(f"{prefix}/{layout.COMMITS}")


def commits(spark: SparkSession, prefix: str) -> DataFrame:
    """``(project, dataset, archive_ts, metadata_version, object_count)``: the append-only index of committed snapshots.

    A snapshot enters it after its manifest. Empty for a prefix whose snapshots are older than the index; see
    :func:`rebuild_commits`.
    """
    try:
        return spark.read.schema(COMMIT_SCHEMA).json(f"{prefix.rstrip('/')}/{layout.COMMITS}").distinct()
    except AnalysisException:
        return small_frame(spark, [], COMMIT_SCHEMA)


def newest_snapshots(spark: SparkSession, prefix: str) -> DataFrame:
    """The newest committed snapshot of each project and dataset that this version can read, found without listing any."""
    readable = commits(spark, prefix).where(F.col("metadata_version") == METADATA_VERSION)
    return readable.groupBy("project", "dataset").agg(F.max_by(F.struct("archive_ts", "object_count"), "archive_ts").alias("s")).select("project", "dataset", "s.*")


def rebuild_commits(spark: SparkSession, prefix: str) -> int:
    """Put snapshots into the index that are committed and not in it, from all manifests; returns how many."""
    known = [F.col(c) for c in ADDRESS_SCHEMA.names]
    found = committed(read_manifests(spark, prefix)).join(commits(spark, prefix).select(*known), ADDRESS_SCHEMA.names, "left_anti")
    rows = [tuple(r) for r in found.select(COMMIT_SCHEMA.names).collect()]
    if rows:
        _index(spark, prefix.rstrip("/"), rows)
    return len(rows)


def committed(manifests: DataFrame) -> DataFrame:
    """Of snapshots in ``manifests``, those with all their rows; a snapshot of mixed versions is none."""
    whole = manifests.groupBy(*ADDRESS_SCHEMA.names).agg(
        F.count(F.lit(1)).alias("rows"), F.max("object_count").alias("object_count"),
        F.min("metadata_version").alias("metadata_version"), F.max("metadata_version").alias("last_version"),
    )
    return whole.where("rows = object_count AND metadata_version = last_version").select(*COMMIT_SCHEMA.names)


def read_manifests(spark: SparkSession, prefix: str, where: Column | None = None) -> DataFrame:
    """Every object of every snapshot under ``prefix``; a predicate on the address columns prunes files."""
    df = (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("basePath", prefix)
        .json(f"{prefix.rstrip('/')}/project=*/dataset=*/archive_ts=*/{layout.MANIFEST}")
    )
    return df if where is None else df.filter(where)


def read_manifest(spark: SparkSession, snapshot: str) -> DataFrame:
    """The objects of one snapshot; refuses a snapshot whose manifest is missing or short."""
    try:
        df = (
            spark.read.schema(MANIFEST_SCHEMA)
            .option("basePath", layout.prefix_of(snapshot))
            .json(f"{snapshot.rstrip('/')}/{layout.MANIFEST}")
        )
    except AnalysisException as error:
        raise SnapshotIncomplete(f"no {layout.MANIFEST} in {snapshot}") from error
    found = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("object_count").alias("expected"),
        F.collect_set(
            F.when(
                ~F.col("metadata_version").eqNullSafe(METADATA_VERSION),
                F.coalesce("metadata_version", F.lit("an unknown version")),
            )
        ).alias("other_versions"),
    ).first()
    if found.rows == 0 or found.rows != found.expected:
        raise SnapshotIncomplete(f"{snapshot} holds {found.rows} of {found.expected} manifest rows")
    if found.other_versions:
        raise VersionMismatch(f"{snapshot} was written as {', '.join(sorted(found.other_versions))}, not {METADATA_VERSION}")
    return df


def latest_snapshots(manifests: DataFrame) -> DataFrame:
    """The newest committed ``archive_ts`` of each project and dataset that this version can read."""
    readable = committed(manifests).where(F.col("metadata_version") == METADATA_VERSION)
    return readable.groupBy("project", "dataset").agg(F.max("archive_ts").alias("archive_ts"))


def archived_columns(manifests: DataFrame) -> DataFrame:
    """One row per column of every archived object."""
    return manifests.select(
        "project", "dataset", "archive_ts", "kind", F.col("name").alias("object"), F.posexplode("columns").alias("pos", "c")
    ).select("project", "dataset", "archive_ts", "kind", "object", "pos", "c.*")
