"""Zone maps: for every file of a storage table the least and greatest value and the NULLs of some columns.

The map is a small table beside the storage table. It is made from the files themselves, and an append adds only its own
files. A read asks it which files can hold rows that meet its filters, and opens no others.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.operators.partitions import HIDDEN_COLUMN
from stowage.session import properties_clause, quoted, scratch_dir, written
from stowage.sources import catalog

SUFFIX = "__zones"
ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)


def map_of(storage: str) -> str:
    return storage + SUFFIX


def zones(files: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``(file, rows, zones)``, a struct of ``(low, high, nulls)`` for each column; reads these columns only."""
    per_column = [
        F.struct(F.min(F.col(quoted(c))).alias("low"), F.max(F.col(quoted(c))).alias("high"), F.count_if(F.col(quoted(c)).isNull()).alias("nulls")).alias(c)
        for c in columns
    ]
    file = F.col("_metadata.file_path").alias("file")
    return files.groupBy(file).agg(F.count(F.lit(1)).alias("rows"), F.struct(*per_column).alias("zones"))


def write_map(spark: SparkSession, database: str, storage: str, of: str, columns: Iterable[str]) -> None:
    """Make the zone map of a storage table."""
    columns = [c for c in columns if isinstance(spark.table(quoted(database, storage)).schema[c].dataType, ORDERED)]
    if not columns:
        return
    found = zones(spark.table(quoted(database, storage)), columns)
    target = quoted(database, map_of(storage))
    found.write.saveAsTable(target)
    spark.sql(f"ALTER TABLE {target} SET TBLPROPERTIES {properties_clause(catalog.stored({catalog.STORAGE_OF: of}))}")


def has_map(spark: SparkSession, database: str, storage: str) -> bool:
    return spark.catalog.tableExists(quoted(database, map_of(storage)))


def plain_path(file: str) -> str:
    """A file's path as Spark takes it; local ones are told by one slash or by three."""
    return re.sub(r"^file:/+", "file:/", unquote(file))


def files_of(table: DataFrame) -> list[str]:
    """The files that a table has now."""
    return sorted(map(plain_path, table.inputFiles()))


def extend_map(spark: SparkSession, database: str, storage: str) -> None:
    """Add the files that an append has put into the storage table; files that are in the map are not read again."""
    if not has_map(spark, database, storage):
        return
    table, known = spark.table(quoted(database, storage)), spark.table(quoted(database, map_of(storage)))
    seen = {plain_path(r.file) for r in known.select("file").collect()}
    fresh = [f for f in map(plain_path, table.inputFiles()) if f not in seen]
    if fresh:
        zones(_of_files(spark, table, fresh), known.schema["zones"].dataType.names).write.insertInto(quoted(database, map_of(storage)))


def _of_files(spark: SparkSession, table: DataFrame, files: list[str]) -> DataFrame:
    base = files[0].split(f"/{HIDDEN_COLUMN}=")[0]
    return spark.read.schema(table.schema).option("basePath", base).parquet(*files)


def shrink_map(spark: SparkSession, database: str, storage: str, dropped: Iterable[str]) -> None:
    """Take the files of dropped partitions out of the map."""
    if not has_map(spark, database, storage):
        return
    known, part = spark.table(quoted(database, map_of(storage))), F.regexp_extract("file", f"/{HIDDEN_COLUMN}=([^/]*)/", 1)
    left = written(known.where(~part.isin(list(dropped))), f"{scratch_dir(spark, 'zones')}/left")
    left.write.insertInto(quoted(database, map_of(storage)), overwrite=True)


def may_match(zone: Column, operator: str, value: object, kind: T.DataType) -> Column:
    """Whether a file with this zone can hold a row for which ``column operator value`` is true."""
    low, high = zone["low"], zone["high"]
    given = lambda v: F.lit(v).cast(kind)
    if operator == "in":
        inside = [(low <= given(v)) & (high >= given(v)) for v in value]
        return F.coalesce(*[F.when(c, F.lit(True)) for c in inside], F.lit(False)) if inside else F.lit(False)
    if operator == "between":
        return F.coalesce((high >= given(value[0])) & (low <= given(value[1])), F.lit(False))
    right = given(value)
    tests = {
        "=": (low <= right) & (high >= right), ">": high > right, ">=": high >= right, "<": low < right, "<=": low <= right,
    }
    return F.coalesce(tests[operator], F.lit(False))


def matching_files(spark: SparkSession, database: str, storage: str, filters: Iterable[tuple[str, str, object]]) -> list[str] | None:
    """The files of a storage table that can hold rows which meet all of ``filters``; None if no file is ruled out."""
    if not has_map(spark, database, storage):
        return None
    known = spark.table(quoted(database, map_of(storage)))
    fields = {f.name.lower(): f for f in known.schema["zones"].dataType}
    condition, used = F.lit(True), False
    for name, operator, value in filters:
        field = fields.get(name.lower())
        if field is not None:
            condition, used = condition & may_match(F.col("zones")[field.name], operator, value, field.dataType["low"].dataType), True
    if not used:
        return None
    marked = [(plain_path(r.file), r.may) for r in known.select("file", condition.alias("may")).collect()]
    return None if all(may for _, may in marked) else [file for file, may in marked if may]


def read_files(spark: SparkSession, database: str, storage: str, files: list[str]) -> DataFrame:
    """The rows of some files of a storage table."""
    table = spark.table(quoted(database, storage))
    return _of_files(spark, table, files) if files else table.limit(0)
