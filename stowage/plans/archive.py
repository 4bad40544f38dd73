"""Snapshot of a whole database."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.routines import arguments_of, read_routines
from stowage.operators.tables import partition_of, snapshot_table
from stowage.plans.jobs import FAILED, Ledger, OK, Status, UNSUPPORTED, run_all
from stowage.session import quoted
from stowage.sources import catalog, formats, layout, manifest, schemas


def archive_dataset(
    spark: SparkSession,
    database: str,
    prefix: str,
    *,
    concurrency: int = 1,
    continue_on_failure: bool = False,
    archive_ts: str | None = None,
    table_data_archive_format: str | None = None,
    table_data_archive_format_mapping: dict[str, str] | None = None,
    table_data_archive_compression: str | None = None,
    table_data_archive_compression_mapping: dict[str, str] | None = None,
) -> DataFrame:
    """Archive every object of ``database`` below ``prefix`` and return one status row per object.

    Table data is written first and the manifest last. After a failure without
    ``continue_on_failure`` no manifest is written, so the snapshot can never be restored by mistake.
    The snapshot lies at ``layout.snapshot_path(prefix, catalog, database, archive_ts)``, also given
    in the ``snapshot`` column.
    """
    options = {
        "table_data_archive_format": table_data_archive_format,
        "table_data_archive_format_mapping": table_data_archive_format_mapping,
        "table_data_archive_compression": table_data_archive_compression,
        "table_data_archive_compression_mapping": table_data_archive_compression_mapping,
    }
    project = spark.catalog.currentCatalog()
    snapshot = layout.snapshot_path(prefix, project, database, archive_ts or layout.format_archive_ts())
    ledger = Ledger(continue_on_failure)
    rows: dict[tuple[str, str], dict] = {}
    items: list[tuple[str, str, Callable[[], int | None]]] = []
    routines = {r.name: r for r in read_routines(spark, database).collect()}

    def job(kind: str, name: str) -> Callable[[], int | None]:
        def run() -> int | None:
            row = _archive_object(spark, database, kind, name, snapshot, options, routines)
            rows[kind, name] = row
            return row["rows"]

        return run

    for found in catalog.inventory(spark, database).orderBy("kind", "name").collect():
        if found.kind == "unsupported":
            message = f"{found.object_type} objects are not archived"
            rows[found.kind, found.name] = manifest.object_row("unsupported", found.name, status=UNSUPPORTED, error=message)
            ledger.add(Status("unsupported", found.name, UNSUPPORTED))
        else:
            items.append((found.kind, found.name, job(found.kind, found.name)))
    run_all(spark, ledger, items, concurrency)

    if not ledger.stopped:
        for status in ledger.failed():
            rows[status.kind, status.name] = manifest.object_row(
                status.kind, status.name, status=FAILED, error=status.error
            )
        described = catalog.describe_database(spark, database)
        dataset = manifest.object_row(
            "dataset", database, description=described["description"], labels=described["labels"]
        )
        if not ledger.rows:
            # An empty database has a snapshot too.
            ledger.add(Status("dataset", database, OK))
        manifest.write_manifest(spark, snapshot, [dataset, *(rows[key] for key in sorted(rows))])
    return ledger.to_dataframe(spark).withColumn("snapshot", F.lit(snapshot))


def _archive_object(spark: SparkSession, database: str, kind: str, name: str, snapshot: str, options: dict,
                    routines: dict) -> dict:
    if kind in ("function", "stored_procedure"):
        return _archive_routine(spark, database, kind, name, routines)
    found = catalog.describe(spark, database, name)
    properties = catalog.properties_of(found)
    try:
        schema = spark.table(quoted(database, name)).schema
    except AnalysisException:
        # The base of the view is gone or out of reach; its definition says what its columns were.
        if kind != "view":
            raise
        schema = catalog.schema_of(found)
    common = {
        "description": found.get("comment"),
        "labels": catalog.labels_of(found),
        "schema_json": schemas.to_json(schema, catalog.required_of(properties)),
    }
    common["columns"] = schemas.column_rows(schemas.from_json(common["schema_json"]))
    partition = partition_of(found)
    if partition is not None:
        common["partition"] = partition.to_dict()

    if kind == "view":
        return manifest.object_row(kind, name, query=found["view_text"], namespace=_own_namespace(found), **common)
    if kind == "materialized_view":
        return manifest.object_row(
            kind, name,
            query=properties[catalog.QUERY],
            namespace=properties[catalog.NAMESPACE],
            enable_refresh=properties[catalog.ENABLE_REFRESH] == "true",
            refresh_interval_seconds=int(properties[catalog.REFRESH_INTERVAL]),
            **common,
        )
    if kind == "external_table":
        return manifest.object_row(
            kind, name, provider=found["provider"], location=found["location"],
            options=catalog.options_of(found), **common,
        )
    fmt = formats.resolve_format(name, options)
    path = layout.data_path(name)
    storage = properties.get(catalog.STORAGE, name)
    seen = snapshot_table(spark.table(quoted(database, storage)), f"{snapshot}/{path}", fmt, partition)
    return manifest.object_row(
        kind, name, format=fmt.name, compression=fmt.codec, data_path=path, rows=seen["rows"],
        multi_line=seen["multi_line"], **common,
    )


def _own_namespace(description: dict) -> str:
    return (description.get("view_catalog_and_namespace") or "").rpartition(".")[2]


def _archive_routine(spark: SparkSession, database: str, kind: str, name: str, routines: dict) -> dict:
    if name in routines:
        kept = routines[name]
        return manifest.object_row(
            kind, name, language=kept.language, body=kept.body, return_type=kept.return_type,
            description=kept.description, imported_libraries=kept.imported_libraries,
            arguments=[{"name": a["name"], "type": a["type"]} for a in kept.arguments or []],
        )
    found = catalog.describe_function(spark, database, name)
    return manifest.object_row(
        kind, name, language="SQL", body=found["body"], return_type=found["return_type"],
        description=found["description"], arguments=arguments_of(found["arguments_sql"]),
        arguments_sql=found["arguments_sql"], namespace=found["namespace"].rpartition(".")[2], imported_libraries=[],
    )


def snapshot_of(status: DataFrame) -> str:
    """The snapshot path a status DataFrame of :func:`archive_dataset` belongs to."""
    return status.select("snapshot").first().snapshot
