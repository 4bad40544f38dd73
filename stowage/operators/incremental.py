"""Materialized aggregates that are refreshed from what has changed.

For every file of the base table the view keeps the mergeable state of its aggregates (counts, sums, least and greatest values
for each key), and a change log says which files it has taken in or dropped and when. A refresh compares the log with the
files that the base table has now: new files are scanned and nothing else, the state of files that are gone is dropped, so
appends, deletions and overwrites all end in what a recompute would give. Readers see the merged state through a view.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.errors import StowageError
from stowage.operators.tables import create_physical, drop_object, split_name
from stowage.operators.zones import files_of, plain_path
from stowage.session import properties_clause, quoted, small_frame
from stowage.sources import catalog

KINDS = ("count", "sum", "min", "max", "avg")
LOG_SCHEMA = "file string, action string, at timestamp_ntz"
FILE = "stowage_file"


def _partials(number: int, kind: str, expression: str) -> list[Column]:
    """What a file keeps of an aggregate."""
    value, name = F.expr(expression) if expression != "*" else F.lit(1), f"p{number}"
    if kind in ("min", "max"):
        return [(F.min if kind == "min" else F.max)(value).alias(name)]
    counted = F.count(value).alias(f"{name}_n")
    return [counted] if kind == "count" else [counted, F.sum(value).alias(f"{name}_s")]


def _merged(number: int, kind: str) -> str:
    """The aggregate, from the states of all files."""
    name = f"p{number}"
    return {
        "count": f"sum({name}_n)", "sum": f"sum({name}_s)", "min": f"min({name})", "max": f"max({name})",
        "avg": f"sum({name}_s) / nullif(sum({name}_n), 0)",
    }[kind]


def _states(files: DataFrame, spec: dict) -> DataFrame:
    kept = files.where(spec["where"]) if spec["where"] else files
    file = F.col("_metadata.file_path").alias(FILE)
    partials = [p for i, (_, kind, expression) in enumerate(spec["aggregates"]) for p in _partials(i, kind, expression)]
    keyed = kept.select("*", file).groupBy(FILE, *[F.col(quoted(k)) for k in spec["keys"]])
    return keyed.agg(*partials)


def _base(spark: SparkSession, name: str) -> DataFrame:
    """The table with the files of ``name``, which may be a view over a storage table."""
    database, table = split_name(spark, name)
    storage = catalog.properties_of(catalog.describe(spark, database, table)).get(catalog.STORAGE)
    return spark.table(quoted(database, storage or table))


def _query(spec: dict) -> str:
    """The same view as a query that computes it from nothing."""
    columns = [*map(quoted, spec["keys"]), *(f"{kind}({expression}) AS {quoted(alias)}" for alias, kind, expression in spec["aggregates"])]
    where = f" WHERE {spec['where']}" if spec["where"] else ""
    grouped = f" GROUP BY {', '.join(map(quoted, spec['keys']))}" if spec["keys"] else ""
    return f"SELECT {', '.join(columns)} FROM {spec['base']}{where}{grouped}"


def create_incremental_view(
    spark: SparkSession, name: str, base: str, keys: Sequence[str], aggregates: Mapping[str, tuple[str, str]], where: str | None = None,
    as_of: datetime.datetime | None = None, refresh_interval_seconds: int = 0,
) -> None:
    """Create a view of aggregates over ``base`` for each combination of ``keys``.

    ``aggregates`` maps a column to ``(kind, expression)`` with a kind of ``count`` (``*`` counts rows), ``sum``, ``min``, ``max`` or
    ``avg``. Sums of floating-point values depend on the order of files; use decimals for exact ones. One
    refresh at a time; the view is archived as a materialized view with its query.
    """
    database, view = split_name(spark, name)
    unknown = [kind for kind, _ in aggregates.values() if kind not in KINDS]
    if unknown or not aggregates:
        raise StowageError(f"aggregates must be some of {', '.join(KINDS)}")
    spec = {
        "base": base, "keys": list(keys), "aggregates": [[alias, kind, expression] for alias, (kind, expression) in aggregates.items()],
        "where": where, "state": f"{view}__state_{uuid.uuid4().hex[:12]}", "log": f"{view}__log_{uuid.uuid4().hex[:12]}",
    }
    create_physical(_states(_base(spark, base), spec), database, spec["state"], (), {catalog.STORAGE_OF: view})
    taken = _log_rows(spark, files_of(_base(spark, base)), "ADDED", as_of)
    create_physical(taken, database, spec["log"], (), {catalog.STORAGE_OF: view})
    _show(spark, database, view, spec, as_of, refresh_interval_seconds)


def _log_rows(spark: SparkSession, files: Sequence[str], action: str, as_of: datetime.datetime | None) -> DataFrame:
    at = as_of or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    return small_frame(spark, [(file, action, at) for file in files], LOG_SCHEMA)


def _show(spark: SparkSession, database: str, view: str, spec: dict, as_of: datetime.datetime | None, interval: int) -> None:
    columns = [*map(quoted, spec["keys"]), *(f"{_merged(i, kind)} AS {quoted(alias)}" for i, (alias, kind, _) in enumerate(spec["aggregates"]))]
    grouped = f" GROUP BY {', '.join(map(quoted, spec['keys']))}" if spec["keys"] else ""
    at = as_of or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    properties = {
        catalog.KIND: "materialized_view", catalog.QUERY: _query(spec), catalog.NAMESPACE: database, catalog.ENABLE_REFRESH: "true",
        catalog.REFRESH_INTERVAL: str(interval), catalog.REFRESHED_AT: at.isoformat(), catalog.INCREMENTAL: json.dumps(spec),
        catalog.STORAGE: spec["state"], catalog.PREVIOUS: spec["log"],
    }
    spark.sql(
        f"CREATE OR REPLACE VIEW {quoted(database, view)} TBLPROPERTIES {properties_clause(catalog.stored(properties))} "
        f"AS SELECT {', '.join(columns)} FROM {quoted(database, spec['state'])}{grouped}"
    )


def refresh_incremental(spark: SparkSession, name: str, as_of: datetime.datetime | None = None) -> dict[str, int]:
    """Take in what has changed since the last refresh; gives the numbers of files added and dropped."""
    database, view = split_name(spark, name)
    properties = catalog.properties_of(catalog.describe(spark, database, view))
    if catalog.INCREMENTAL not in properties:
        raise StowageError(f"{database}.{view} is not incremental")
    spec, interval = json.loads(properties[catalog.INCREMENTAL]), int(properties[catalog.REFRESH_INTERVAL])
    base, state = _base(spark, spec["base"]), spark.table(quoted(database, spec["state"]))
    log = spark.table(quoted(database, spec["log"]))
    last = log.groupBy("file").agg(F.max_by("action", "at").alias("action")).where("action = 'ADDED'")
    # A refresh that was cut off after its states were committed has not written its log.
    known = {plain_path(r.file) for r in last.select("file").collect()} | {plain_path(r[FILE]) for r in state.select(FILE).distinct().collect()}
    now = set(files_of(base))
    fresh, gone = sorted(now - known), sorted(known - now)
    if gone:
        # Written anew without them, then the view is moved over.
        dropped = small_frame(spark, [(file,) for file in gone], "file string")
        left = state.join(dropped, F.regexp_replace(F.url_decode(FILE), "^file:/+", "file:/") == F.col("file"), "left_anti")
        replaced, spec["state"] = spec["state"], f"{view}__state_{uuid.uuid4().hex[:12]}"
        create_physical(left, database, spec["state"], (), {catalog.STORAGE_OF: view})
    if fresh:
        files = spark.read.schema(base.schema).parquet(*fresh) if not _partitioned(fresh) else _with_partitions(spark, base, fresh)
        _states(files, spec).write.insertInto(quoted(database, spec["state"]))
    changes = _log_rows(spark, fresh, "ADDED", as_of).unionByName(_log_rows(spark, gone, "DROPPED", as_of))
    if fresh or gone:
        changes.write.insertInto(quoted(database, spec["log"]))
    _show(spark, database, view, spec, as_of, interval)
    if gone:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(database, replaced)}")
    return {"added": len(fresh), "dropped": len(gone)}


def _partitioned(files: Sequence[str]) -> bool:
    return any("=" in part for part in files[0].split("/")[:-1])


def _with_partitions(spark: SparkSession, base: DataFrame, files: Sequence[str]) -> DataFrame:
    parts = files[0].split("/")
    first = next(i for i, part in enumerate(parts) if "=" in part)
    return spark.read.schema(base.schema).option("basePath", "/".join(parts[:first])).parquet(*files)


def change_log(spark: SparkSession, name: str) -> DataFrame:
    """``(file, action, at)``: the files of the base table that the view has taken in or dropped."""
    database, view = split_name(spark, name)
    spec = json.loads(catalog.properties_of(catalog.describe(spark, database, view))[catalog.INCREMENTAL])
    return spark.table(quoted(database, spec["log"]))


def drop_incremental(spark: SparkSession, name: str) -> None:
    drop_object(spark, *split_name(spark, name))
