"""Rebuilding a database from a snapshot, in place or under another name."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from stowage.functions import references as refs
from stowage.functions.routines import (
    create_code_function,
    create_function,
    create_script,
    drop_functions,
    register_code_functions,
)
from stowage.operators import views
from stowage.operators.partitions import PartitionConfig
from stowage.operators.tables import load_table
from stowage.plans.graph import blocked_dependents, restore_waves
from stowage.plans.jobs import BLOCKED, FAILED, NOT_RUN, SKIPPED, UNSUPPORTED, Ledger, Status, run_all
from stowage.session import literal, properties_clause, quoted, scratch_dir, small_frame, written
from stowage.sources import catalog, formats, layout, manifest, schemas

DATA_KINDS = ("table", "external_table")
ORDERED_KINDS = ("function", "view", "materialized_view")
RELATION, FUNCTION = "relation ", "function "


def relocated(rows: DataFrame, source_project: str, source_dataset: str, target_project: str | None,
              target_dataset: str | None, mapping: Mapping[str, str] | None = None,
              table_mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Manifest rows of any number of snapshots of one dataset, with target columns and rewritten SQL.

    A missing target part falls back to the source's.
    """
    full = refs.relocation_mapping(
        source_project, source_dataset, target_project or source_project, target_dataset or source_dataset, mapping
    )
    placed = rows.withColumns(
        {
            "target_project": F.coalesce(F.lit(target_project), "project"),
            "target_dataset": F.coalesce(F.lit(target_dataset), "dataset"),
        }
    )
    if not full and not table_mapping:
        return placed
    # An object has a query or a body, so both are rewritten as one column.
    placed = placed.withColumn("statement", F.coalesce("query", F.when(F.upper("language") == "SQL", F.col("body"))))
    placed = refs.rewrite_references(placed, "statement", full, table_mapping)
    return placed.withColumns(
        {
            "query": F.when(F.col("query").isNotNull(), F.col("statement")),
            "body": F.when(F.upper("language") == "SQL", F.col("statement")).otherwise(F.col("body")),
        }
    ).drop("statement")


def object_keys(rows: DataFrame) -> DataFrame:
    """Graph nodes of the objects whose order matters; functions and relations have separate names."""
    name = F.lower(F.concat_ws(".", "target_project", "target_dataset", "name"))
    return rows.filter(F.col("kind").isin(*ORDERED_KINDS)).select(
        "kind", "name", F.concat(F.when(F.col("kind") == "function", FUNCTION).otherwise(RELATION), name).alias("key")
    )


def object_edges(rows: DataFrame) -> DataFrame:
    """Edges ``(key, requisite)``: the tables and functions named in a view, materialized view or SQL function.

    Short names are completed with the destination, or with the database a statement's names
    resolve in when that is not the source itself.
    """
    statements = rows.filter(F.col("kind").isin(*ORDERED_KINDS)).select(
        F.coalesce("query", F.when(F.upper("language") == "SQL", F.concat(F.lit("SELECT "), "body"))).alias("sql"),
        F.concat(
            F.when(F.col("kind") == "function", FUNCTION).otherwise(RELATION),
            F.lower(F.concat_ws(".", "target_project", "target_dataset", "name")),
        ).alias("key"),
        "target_project",
        F.when(F.coalesce("namespace", "dataset") == F.col("dataset"), F.col("target_dataset"))
        .otherwise(F.col("namespace")).alias("home"),
    ).filter("sql is not null")
    def named(names: str, kind: str) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), F.lower(n).alias("name")))

    found = refs.with_references(statements, "sql").select(
        "key", "target_project", "home", F.explode_outer(F.concat(named("tables", RELATION), named("functions", FUNCTION))).alias("r")
    ).filter(F.col("r").isNotNull()).select("key", "target_project", "home", "r.kind", "r.name")
    # An unqualified name of a built-in function always means the built-in one.
    builtin = rows.sparkSession.sql("SHOW SYSTEM FUNCTIONS").select(F.lower("function").alias("builtin"))
    found = found.join(builtin, (F.col("kind") == FUNCTION) & (F.col("name") == F.col("builtin")), "left_anti")
    requisite = F.concat("kind", refs.qualify(F.col("name"), F.lower("target_project"), F.lower("home")))
    return found.select("key", requisite.alias("requisite")).filter("key <> requisite").distinct()


def restore_dataset(
    spark: SparkSession,
    snapshot: str,
    target: str | None = None,
    *,
    concurrency: int = 1,
    continue_on_failure: bool = False,
    overwrite_existing: bool = False,
    append: bool = False,
    attach_archive_ts_to_label: bool = True,
    skip_restore: Mapping[str, bool] | None = None,
    statement_replacement_mapping: Mapping[str, str] | None = None,
    table_replacement_mapping: Mapping[str, str] | None = None,
    as_of: datetime.datetime | None = None,
    allow_code: bool = False,
    location: str | None = None,
) -> DataFrame:
    """Restore ``snapshot`` into the database ``target`` (default: its own) and return status rows.

    Tables and external tables come first, then functions, views and materialized views wave by wave
    in dependency order, then scripts. ``as_of`` drops partitions past their expiration.
    ``overwrite_existing`` drops the target database with its contents.
    """
    rows = manifest.read_manifest(spark, snapshot)
    skipped = small_frame(spark, [(n,) for n, skip in (skip_restore or {}).items() if skip], "name string")
    project, dataset = layout.address_of(snapshot)
    # Written out once: every later step reads the rewritten rows instead of rewriting them again.
    placed = written(
        relocated(rows, project, dataset, None, target, statement_replacement_mapping, table_replacement_mapping),
        scratch_dir(spark, "relocated"),
    )
    wanted = placed.join(skipped, "name", "left_anti")
    by_kind: dict[str, list[Row]] = {}
    for row in wanted.orderBy("kind", "name").collect():
        by_kind.setdefault(row.kind, []).append(row)
    ledger = Ledger(continue_on_failure)
    for row in placed.join(skipped, "name", "left_semi").select("kind", "name").collect():
        ledger.add(Status(row.kind, row.name, SKIPPED))

    run = _Restore(spark, snapshot, ledger, overwrite_existing, append, attach_archive_ts_to_label, as_of, allow_code)
    database = run.create_database(by_kind.get("dataset", []), target or dataset, location)
    for row in by_kind.get("unsupported", []):
        ledger.add(Status(row.kind, row.name, UNSUPPORTED, None, row.error))

    run_all(spark, ledger, [run.item(r) for kind in DATA_KINDS for r in by_kind.get(kind, [])], concurrency)
    ordered = [r for kind in ORDERED_KINDS for r in by_kind.get(kind, [])]
    if ordered and not ledger.stopped:
        run.in_order(wanted, ordered, concurrency)
    else:
        for row in ordered:
            ledger.add(Status(row.kind, row.name, NOT_RUN))
    run_all(spark, ledger, [run.item(r) for r in by_kind.get("stored_procedure", [])], 1)
    register_code_functions(spark, database, allow_code)
    return ledger.to_dataframe(spark)


class _Restore:
    """Options of one restore and the statements that create each kind of object."""

    def __init__(self, spark: SparkSession, snapshot: str, ledger: Ledger, overwrite: bool, append: bool,
                 attach_ts: bool, as_of: datetime.datetime | None, allow_code: bool) -> None:
        self.spark = spark
        self.snapshot = snapshot.rstrip("/")
        self.ledger = ledger
        self.overwrite = overwrite
        self.append = append
        self.attach_ts = attach_ts
        self.as_of = as_of
        self.allow_code = allow_code
        self.archive_ts = self.snapshot.rpartition("archive_ts=")[2]

    def labels(self, row: Row) -> dict[str, str]:
        labels = dict(row.labels or {})
        if self.attach_ts:
            labels["archive_ts"] = self.archive_ts
        return labels

    def create_database(self, rows: list[Row], database: str, location: str | None) -> str:
        """Create the target database; a skipped dataset row means it must exist already."""
        for row in rows:
            if self.overwrite and self.spark.catalog.databaseExists(database):
                drop_functions(self.spark, database)
                self.spark.sql(f"DROP DATABASE IF EXISTS {quoted(database)} CASCADE")
            comment = f"COMMENT {literal(row.description)}" if row.description else ""
            place = f"LOCATION {literal(location)}" if location else ""
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)} {comment} {place}")
            labels = self.labels(row)
            if labels:
                self.spark.sql(f"ALTER DATABASE {quoted(database)} SET DBPROPERTIES {properties_clause(catalog.stored(labels))}")
            self.ledger.add(Status("dataset", database))
        return database

    def item(self, row: Row) -> tuple[str, str, Callable[[], int | None]]:
        return row.kind, row.name, lambda: getattr(self, "restore_" + row.kind)(row)

    def in_order(self, wanted: DataFrame, rows: list[Row], concurrency: int) -> None:
        """Create objects wave by wave; what depends on a failed one is reported as blocked."""
        nodes = object_keys(wanted)
        edges = written(object_edges(wanted), scratch_dir(self.spark, "edges"))
        waves = {
            (r.kind, r.name): (r.wave, r.key)
            for r in restore_waves(nodes.select("key"), edges).join(nodes, "key").collect()
        }
        blocked: dict[str, str] = {}
        by_wave: dict[int, list[Row]] = {}
        for row in rows:
            by_wave.setdefault(waves[row.kind, row.name][0], []).append(row)
        for wave in sorted(by_wave):
            ready = []
            for row in by_wave[wave]:
                cause = blocked.get(waves[row.kind, row.name][1])
                if cause is not None:
                    self.ledger.add(Status(row.kind, row.name, BLOCKED, None, f"depends on failed {cause}"))
                elif row.kind == "function" and (row.language or "").upper() not in ("SQL", "PYTHON"):
                    self.ledger.add(
                        Status(row.kind, row.name, UNSUPPORTED, None, f"{row.language} functions cannot run on Spark")
                    )
                else:
                    ready.append(row)
            run_all(self.spark, self.ledger, [self.item(r) for r in ready], concurrency)
            keys = [
                (waves[s.kind, s.name][1],)
                for s in self.ledger.rows
                if s.status in (FAILED, UNSUPPORTED) and (s.kind, s.name) in waves
            ]
            if keys and not self.ledger.stopped:
                failed = small_frame(self.spark, keys, "key string")
                blocked = {
                    r.key: r.failed_requisite
                    for r in blocked_dependents(nodes.select("key"), edges, failed).collect()
                }

    def home(self, row: Row) -> str:
        """The database in which short names of a restored statement resolve."""
        return row.target_dataset if (row.namespace or row.dataset) == row.dataset else row.namespace

    def restore_table(self, row: Row) -> int:
        if row.status != "OK":
            raise RuntimeError(f"not in the snapshot: {row.error}")
        return load_table(
            self.spark,
            f"{row.target_dataset}.{row.name}",
            f"{self.snapshot}/{row.data_path}",
            formats.FileFormat(row.format, row.compression),
            schemas.from_json(row.schema_json) if row.schema_json else None,
            PartitionConfig.from_dict(row.partition.asDict() if row.partition else None),
            bool(row.multi_line) if row.multi_line is not None else True,
            self.as_of,
            row.description,
            self.labels(row),
            "overwrite" if self.overwrite else "append" if self.append else "error",
        )

    def restore_external_table(self, row: Row) -> None:
        partition = PartitionConfig.from_dict(row.partition.asDict() if row.partition else None)
        views.create_external_table(
            self.spark, f"{row.target_dataset}.{row.name}", row.provider, row.location,
            schemas.from_json(row.schema_json), row.options, tuple(partition.columns) if partition else (),
            row.description, self.labels(row), self.overwrite,
        )

    def restore_view(self, row: Row) -> None:
        views.create_view(
            self.spark, f"{row.target_dataset}.{row.name}", row.query, schemas.from_json(row.schema_json),
            row.description, self.labels(row), self.home(row), self.overwrite,
        )

    def restore_materialized_view(self, row: Row) -> int:
        return views.create_materialized_view(
            self.spark, f"{row.target_dataset}.{row.name}", row.query, row.enable_refresh, row.refresh_interval_seconds,
            PartitionConfig.from_dict(row.partition.asDict() if row.partition else None), row.description,
            self.labels(row), self.home(row), None, self.overwrite,
        )

    def restore_function(self, row: Row) -> None:
        if row.language.upper() == "SQL":
            create_function(
                self.spark, row.target_dataset, row.name, row.arguments_sql or "", row.return_type, row.body,
                row.description, self.overwrite,
            )
        else:
            create_code_function(
                self.spark, row.target_dataset, row.name, row.body, row.return_type,
                [a.asDict() for a in row.arguments or []], row.language, row.description,
                row.imported_libraries or [], self.overwrite,
            )

    def restore_stored_procedure(self, row: Row) -> None:
        create_script(
            self.spark, row.target_dataset, row.name, row.body, [a.asDict() for a in row.arguments or []],
            row.description, self.overwrite,
        )
