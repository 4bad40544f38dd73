"""File formats and codecs of archived table data.

Parquet keeps every type natively. Text formats need care: CSV has no null, no nested types
and no exact timestamps of its own, so values are encoded on the way out and cast back on the
way in. Avro needs the external spark-avro package; without it Spark's own error surfaces.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.errors import UnsupportedFormat
from stowage.session import quoted

# Codecs each format's Spark writer accepts, default first.
CODECS = {
    "parquet": ("zstd", "snappy", "gzip", "none"),
    "csv": ("gzip", "deflate", "snappy", "none"),
    "avro": ("deflate", "snappy", "zstandard", "uncompressed"),
}
DEFAULT_FORMAT = "parquet"

CSV_NULL = "\\N"
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "encoding": "UTF-8",
    "nullValue": CSV_NULL,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}
# Gzip and multi-line CSV files cannot be split, so each file is kept small enough for one task.
CSV_RECORDS_PER_FILE = 1_000_000

_CSV_REFUSED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType, T.DayTimeIntervalType,
                T.YearMonthIntervalType, T.CalendarIntervalType)


@dataclass(frozen=True)
class FileFormat:
    name: str
    codec: str

    @property
    def is_text(self) -> bool:
        return self.name == "csv"

    @property
    def stores_datetime_as_text(self) -> bool:
        return self.name in ("csv", "avro")


def resolve_format(table: str, options: Mapping[str, object]) -> FileFormat:
    """Format and codec of one table: its own mapping entry, else the general option, else the default."""

    def pick(option: str) -> str | None:
        value = (options.get(option + "_mapping") or {}).get(table) or options.get(option)
        return value.lower() if value else None

    name = pick("table_data_archive_format") or DEFAULT_FORMAT
    if name not in CODECS:
        raise UnsupportedFormat(f"unknown format {name!r} for table {table}; known: {', '.join(CODECS)}")
    codec = pick("table_data_archive_compression") or CODECS[name][0]
    if name == "avro" and codec == "zstd":
        codec = "zstandard"
    if codec not in CODECS[name]:
        raise UnsupportedFormat(f"{name} cannot be written with {codec}; choose one of {', '.join(CODECS[name])}")
    return FileFormat(name, codec)


def check_storable(schema: T.StructType, fmt: FileFormat) -> None:
    """Refuse early what the format cannot hold."""
    if fmt.is_text:
        refused = [f.name for f in schema if isinstance(f.dataType, _CSV_REFUSED)]
        if refused:
            raise UnsupportedFormat(f"csv cannot hold column(s) {', '.join(refused)}; archive as parquet")


def has_datetime(data_type: T.DataType) -> bool:
    """Does the type hold a zone-less timestamp at any depth?"""
    return data_type != _datetime_as(data_type, T.StringType())


def _datetime_as(data_type: T.DataType, replacement: T.DataType) -> T.DataType:
    if isinstance(data_type, T.TimestampNTZType):
        return replacement
    if isinstance(data_type, T.StructType):
        return T.StructType(
            [T.StructField(f.name, _datetime_as(f.dataType, replacement), f.nullable, f.metadata) for f in data_type]
        )
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_datetime_as(data_type.elementType, replacement), data_type.containsNull)
    if isinstance(data_type, T.MapType):
        return T.MapType(
            _datetime_as(data_type.keyType, replacement),
            _datetime_as(data_type.valueType, replacement),
            data_type.valueContainsNull,
        )
    return data_type


def stored_schema(schema: T.StructType, fmt: FileFormat, keep: tuple[str, ...] = ()) -> T.StructType:
    """The schema as it lies in the files: DATETIME columns of csv and avro are text.

    ``keep`` names partition columns, which lie in directory names and not in the files.
    """
    if not fmt.stores_datetime_as_text:
        return schema
    fields = []
    for field in schema:
        stored = field.dataType
        if field.name not in keep:
            stored = _datetime_as(stored, T.StringType())
            # Dates go as csv text too: the cast covers every year, the csv date parser does not.
            if fmt.is_text and isinstance(stored, T.DateType):
                stored = T.StringType()
        fields.append(T.StructField(field.name, stored, True, field.metadata))
    return T.StructType(fields)


def _escape_text(column: Column) -> Column:
    # A text starting with a backslash gets another one, so no value can look like the null marker.
    return F.when(column.startswith("\\"), F.concat(F.lit("\\"), column)).otherwise(column)


def _unescape_text(column: Column) -> Column:
    return F.when(column.startswith("\\\\"), F.substring(column, 2, 2**31 - 1)).otherwise(column)


def encode(df: DataFrame, fmt: FileFormat, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns as they are written; ``keep`` names partition columns, which stay out of the files."""
    if not fmt.stores_datetime_as_text:
        return df
    stored = stored_schema(df.schema, fmt, keep)
    columns = []
    for live, kept in zip(df.schema, stored, strict=True):
        column = F.col(quoted(live.name))
        if live.name not in keep:
            if live.dataType != kept.dataType:
                column = column.cast(kept.dataType)
            elif fmt.is_text and isinstance(live.dataType, T.StringType):
                column = _escape_text(column)
        columns.append(column.alias(live.name))
    return df.select(columns)


def decode(df: DataFrame, schema: T.StructType, fmt: FileFormat, keep: tuple[str, ...] = ()) -> DataFrame:
    """Undo :func:`encode`: one projection casts text back and restores column order."""
    if not fmt.stores_datetime_as_text:
        return df
    stored = stored_schema(schema, fmt, keep)
    columns = []
    for live, kept in zip(schema, stored, strict=True):
        column = F.col(quoted(live.name))
        if live.name not in keep:
            if live.dataType != kept.dataType:
                column = column.cast(live.dataType)
            elif fmt.is_text and isinstance(live.dataType, T.StringType):
                column = _unescape_text(column)
        columns.append(column.alias(live.name))
    return df.select(columns)


def has_line_break(df: DataFrame, fmt: FileFormat, keep: tuple[str, ...] = ()) -> Column:
    """Aggregate telling whether any text holds a line break, so that restore can split the files if none does."""
    found = F.lit(False)
    if fmt.is_text:
        for field in df.schema:
            if isinstance(field.dataType, T.StringType) and field.name not in keep:
                column = F.col(quoted(field.name))
                found = found | F.coalesce(column.contains("\n") | column.contains("\r"), F.lit(False))
    return F.coalesce(F.max(found), F.lit(False))


def writer(df: DataFrame, fmt: FileFormat, partition_columns: tuple[str, ...] = (), records_per_file: int | None = None):
    out = df.write.format(fmt.name).option("compression", fmt.codec)
    if fmt.is_text:
        out = out.options(**CSV_OPTIONS)
        records_per_file = records_per_file or CSV_RECORDS_PER_FILE
    if records_per_file:
        out = out.option("maxRecordsPerFile", records_per_file)
    if partition_columns:
        out = out.partitionBy(*partition_columns)
    return out


def reader(spark: SparkSession, fmt: FileFormat, schema: T.StructType | None, multi_line: bool = True):
    """A reader with the stored schema, or one that infers it from the files when none was kept."""
    source = spark.read.format(fmt.name)
    if fmt.is_text:
        source = source.options(**CSV_OPTIONS).option("mode", "FAILFAST").option("multiLine", multi_line)
        if schema is None:
            source = source.option("inferSchema", True)
    return source.schema(schema) if schema is not None else source
