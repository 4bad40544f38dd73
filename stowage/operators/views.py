"""Views, materialized views and external tables."""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from stowage.errors import ObjectExists, StowageError
from stowage.operators.partitions import PartitionConfig
from stowage.operators.tables import drop_object, partition_of, publish, split_name, view_columns
from stowage.session import literal, properties_clause, quoted, using_database
from stowage.sources import catalog

DEFAULT_REFRESH_SECONDS = 1800
SECONDS_PER_MINUTE = 60


def _make_room(spark: SparkSession, database: str, name: str, overwrite: bool) -> None:
    if spark.catalog.tableExists(quoted(database, name)):
        if not overwrite:
            raise ObjectExists(f"{database}.{name} exists")
        drop_object(spark, database, name)


def create_view(spark: SparkSession, name: str, query: str, schema: T.StructType | None = None,
                description: str | None = None, labels: Mapping[str, str] | None = None,
                namespace: str | None = None, overwrite: bool = False) -> None:
    """Create a view; short names in its query resolve in ``namespace``, by default its own database."""
    database, view = split_name(spark, name)
    _make_room(spark, database, view, overwrite)
    columns = f"({view_columns(schema)})" if schema is not None else ""
    comment = f"COMMENT {literal(description)}" if description else ""
    properties = f"TBLPROPERTIES {properties_clause(catalog.stored(labels))}" if labels else ""
    with using_database(spark, namespace or database):
        spark.sql(f"CREATE VIEW {quoted(database, view)} {columns} {comment} {properties} AS {query}")


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)


def create_materialized_view(
    spark: SparkSession,
    name: str,
    query: str,
    enable_refresh: bool = False,
    refresh_interval_seconds: int = DEFAULT_REFRESH_SECONDS,
    partition: PartitionConfig | None = None,
    description: str | None = None,
    labels: Mapping[str, str] | None = None,
    namespace: str | None = None,
    as_of: datetime.datetime | None = None,
    overwrite: bool = False,
) -> int:
    """Run a query and keep its result behind a view, with the query and its refresh settings.

    The interval counts in whole minutes.
    """
    database, view = split_name(spark, name)
    _make_room(spark, database, view, overwrite)
    properties = {
        **(labels or {}),
        catalog.KIND: "materialized_view",
        catalog.QUERY: query,
        catalog.NAMESPACE: namespace or database,
        catalog.ENABLE_REFRESH: str(enable_refresh).lower(),
        catalog.REFRESH_INTERVAL: str(refresh_interval_seconds // SECONDS_PER_MINUTE * SECONDS_PER_MINUTE),
    }
    if partition is not None:
        properties[catalog.PARTITION] = partition.to_json()
    return _materialize(spark, database, view, properties, description, partition, as_of)


def _materialize(spark: SparkSession, database: str, view: str, properties: Mapping[str, str], description: str | None,
                 partition: PartitionConfig | None, as_of: datetime.datetime | None) -> int:
    with using_database(spark, properties[catalog.NAMESPACE]):
        df = spark.sql(properties[catalog.QUERY])
    refreshed = {**properties, catalog.REFRESHED_AT: (as_of or _now()).isoformat()}
    return publish(spark, database, view, df, df.schema, partition, refreshed, description)


def refresh_materialized(spark: SparkSession, name: str, as_of: datetime.datetime | None = None) -> bool:
    """Recompute a materialized view if refreshing is on and its interval has passed at ``as_of`` (UTC).

    Readers see the old result until the new one is complete. Tells whether it was recomputed.
    """
    database, view = split_name(spark, name)
    found = catalog.describe(spark, database, view)
    properties = dict(catalog.properties_of(found))
    if properties.get(catalog.KIND) != "materialized_view":
        raise StowageError(f"{database}.{view} is no materialized view")
    if properties[catalog.ENABLE_REFRESH] != "true":
        return False
    as_of = as_of or _now()
    age = as_of - datetime.datetime.fromisoformat(properties[catalog.REFRESHED_AT])
    if age.total_seconds() < int(properties[catalog.REFRESH_INTERVAL]):
        return False
    if catalog.INCREMENTAL in properties:
        from stowage.operators.incremental import refresh_incremental

        refresh_incremental(spark, name, as_of)
        return True
    for key in (catalog.STORAGE, catalog.PREVIOUS):
        properties.pop(key, None)
    _materialize(spark, database, view, properties, found.get("comment"), partition_of(found), as_of)
    return True


def create_external_table(
    spark: SparkSession,
    name: str,
    provider: str,
    location: str,
    schema: T.StructType | None = None,
    options: Mapping[str, str] | None = None,
    partition_columns: tuple[str, ...] = (),
    description: str | None = None,
    labels: Mapping[str, str] | None = None,
    overwrite: bool = False,
) -> None:
    """Put a table over files where they lie; ``location`` may hold glob patterns. No data is copied."""
    database, table = split_name(spark, name)
    _make_room(spark, database, table, overwrite)
    clauses = [f"CREATE TABLE {quoted(database, table)}"]
    if schema is not None:
        clauses.append(f"({schema.toDDL()})")
    clauses.append(f"USING {provider}")
    if options:
        clauses.append(f"OPTIONS {properties_clause(dict(options))}")
    if partition_columns:
        clauses.append(f"PARTITIONED BY ({', '.join(quoted(c) for c in partition_columns)})")
    clauses.append(f"LOCATION {literal(location)}")
    if description:
        clauses.append(f"COMMENT {literal(description)}")
    if labels:
        clauses.append(f"TBLPROPERTIES {properties_clause(catalog.stored(labels))}")
    spark.sql(" ".join(clauses))
    if partition_columns:
        spark.sql(f"ALTER TABLE {quoted(database, table)} RECOVER PARTITIONS")
