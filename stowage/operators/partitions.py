"""Partitioning by time unit, integer range or plain columns; retention; pruning bounds.

Time and range partitioning add a derived column that readers never see. Time values are
computed without the session time zone: zone-less timestamps by their own calendar fields,
instants by their UTC day or hour.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.errors import PartitionFilterRequired, StowageError
from stowage.session import quoted

HIDDEN_COLUMN = "stowage_part"
TIME_UNITS = ("HOUR", "DAY", "MONTH", "YEAR")
EPOCH = datetime.date(1970, 1, 1)
MILLIS_PER_HOUR = 3_600_000
MILLIS_PER_DAY = 24 * MILLIS_PER_HOUR

Filter = tuple[str, str, object]


@dataclass(frozen=True)
class PartitionConfig:
    """TIME needs ``field`` and ``unit``, RANGE needs ``field`` and ``range`` (start, end, interval),
    COLUMNS lists existing columns that are themselves the partition key."""

    category: str
    field: str | None = None
    unit: str | None = None
    expiration_ms: int = 0
    require_filter: bool = False
    range: Sequence[int] | None = None
    columns: Sequence[str] = ()

    def __post_init__(self) -> None:
        if self.category == "TIME":
            if not self.field or (self.unit or "").upper() not in TIME_UNITS:
                raise StowageError(f"time partitioning needs a field and one of the units {', '.join(TIME_UNITS)}")
        elif self.category == "RANGE":
            if not self.field or not self.range or len(self.range) != 3 or self.range[2] <= 0:
                raise StowageError("range partitioning needs a field and (start, end, interval > 0)")
        elif self.category == "COLUMNS":
            if not self.columns:
                raise StowageError("column partitioning needs at least one column")
        else:
            raise StowageError(f"unknown partition category {self.category!r}")

    @property
    def is_derived(self) -> bool:
        return self.category != "COLUMNS"

    @property
    def physical_columns(self) -> tuple[str, ...]:
        return (HIDDEN_COLUMN,) if self.is_derived else tuple(self.columns)

    def to_dict(self) -> dict:
        values = asdict(self)
        return {**values, "range": list(self.range) if self.range else None, "columns": list(self.columns)}

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @classmethod
    def from_json(cls, text: str) -> PartitionConfig:
        return cls.from_dict(json.loads(text))

    @classmethod
    def from_dict(cls, values: dict | None) -> PartitionConfig | None:
        if not values:
            return None
        values = dict(values)
        values["columns"] = tuple(values.get("columns") or ())
        values["range"] = tuple(values["range"]) if values.get("range") else None
        values["expiration_ms"] = values.get("expiration_ms") or 0
        values["require_filter"] = bool(values.get("require_filter"))
        return cls(**values)


def time_partition(field_name: str, unit: str, expiration_ms: int = 0, require_filter: bool = False) -> PartitionConfig:
    return PartitionConfig("TIME", field_name, unit.upper(), expiration_ms, require_filter)


def range_partition(field_name: str, start: int, end: int, interval: int, require_filter: bool = False) -> PartitionConfig:
    return PartitionConfig("RANGE", field_name, None, 0, require_filter, (start, end, interval))


def column_partition(*columns: str) -> PartitionConfig:
    return PartitionConfig("COLUMNS", columns=columns)


def partition_value(column: Column, data_type: T.DataType, config: PartitionConfig) -> Column:
    """The derived partition value of ``column``: a date, hours since 1970, or the start of its range."""
    if config.category == "RANGE":
        start, end, interval = config.range
        x = column.cast("bigint")
        return F.when((x >= start) & (x < end), x - F.pmod(x - F.lit(start), F.lit(interval))).cast("bigint")
    if isinstance(data_type, T.TimestampType):
        seconds = F.unix_seconds(column)
        hours = F.floor(seconds / 3600).cast("bigint")
        day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    elif isinstance(data_type, T.TimestampNTZType):
        day = column.cast("date")
        hours = F.unix_date(day).cast("bigint") * 24 + F.hour(column)
    elif isinstance(data_type, T.DateType):
        day = column
        hours = F.unix_date(day).cast("bigint") * 24
    else:
        raise StowageError(f"cannot partition by {config.unit} of {config.field}: not a date or timestamp")
    if config.unit == "HOUR":
        return hours
    return day if config.unit == "DAY" else F.trunc(day, config.unit)


def add_partition_column(df: DataFrame, config: PartitionConfig) -> DataFrame:
    """Append the derived partition column."""
    return df.withColumn(
        HIDDEN_COLUMN, partition_value(F.col(quoted(config.field)), df.schema[config.field].dataType, config)
    )


def cluster_for_write(df: DataFrame, config: PartitionConfig) -> DataFrame:
    """Bring rows of one partition together before a partitioned write.

    A rebalance, not a repartition: adaptive execution joins small partitions and cuts a hot one
    into several tasks, so a partition with most of the rows does not end up in one task.
    """
    return df.hint("rebalance", *[F.col(quoted(name)) for name in config.physical_columns])


def sorted_for_write(df: DataFrame, config: PartitionConfig) -> DataFrame:
    """Sort each task's rows by partition and partition field.

    The statistics of files and row groups then span little of the field, so any predicate on it, also one in plain SQL
    over the view, skips most of what it does not want.
    """
    if not config.is_derived:
        return df
    return df.sortWithinPartitions(HIDDEN_COLUMN, F.col(quoted(config.field)))


def retention_predicate(config: PartitionConfig, as_of: datetime.datetime | None) -> Column | None:
    """Partitions that have not expired at ``as_of``; rows without a partition never expire."""
    if not config.expiration_ms or config.expiration_ms <= 0 or as_of is None or config.category != "TIME":
        return None
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    oldest = as_of - datetime.timedelta(milliseconds=config.expiration_ms)
    part = F.col(HIDDEN_COLUMN)
    if config.unit == "HOUR":
        hours = -(-(oldest - datetime.datetime(1970, 1, 1)) // datetime.timedelta(hours=1))
        return part.isNull() | (part >= F.lit(hours).cast("bigint"))
    # A partition starts at midnight, so one starting on the bound's own day has expired unless the bound is midnight.
    first = oldest.date() if oldest.time() == datetime.time() else oldest.date() + datetime.timedelta(days=1)
    return part.isNull() | (part >= F.lit(first))


def filter_predicate(filters: Iterable[Filter], schema: T.StructType, config: PartitionConfig | None) -> Column | None:
    """Conjunction of ``(column, operator, value)`` filters.

    A filter on the partition field is matched by one on the derived column, because Spark cannot
    know that the two are related and would otherwise read every partition.
    """
    predicate = None
    for name, operator, value in filters:
        data_type = schema[name].dataType
        one = _compare(F.col(quoted(name)), operator, value, data_type)
        if config is not None and config.is_derived and name.lower() == config.field.lower():
            bound = _partition_bound(operator, value, data_type, config)
            if bound is not None:
                one = bound & one
        predicate = one if predicate is None else predicate & one
    return predicate


def _literal(value: object, data_type: T.DataType) -> Column:
    return F.lit(value).cast(data_type)


def _compare(column: Column, operator: str, value: object, data_type: T.DataType) -> Column:
    if operator == "in":
        return column.isin([_literal(v, data_type) for v in value])
    if operator == "between":
        low, high = value
        return column.between(_literal(low, data_type), _literal(high, data_type))
    right = _literal(value, data_type)
    comparisons = {
        "=": lambda: column == right,
        ">": lambda: column > right,
        ">=": lambda: column >= right,
        "<": lambda: column < right,
        "<=": lambda: column <= right,
    }
    if operator not in comparisons:
        raise StowageError(f"unknown filter operator {operator!r}")
    return comparisons[operator]()


def _partition_bound(operator: str, value: object, data_type: T.DataType, config: PartitionConfig) -> Column | None:
    part = F.col(HIDDEN_COLUMN)
    if operator == "between":
        low = _partition_bound(">=", value[0], data_type, config)
        high = _partition_bound("<=", value[1], data_type, config)
        return high if low is None else low if high is None else low & high

    if config.category == "TIME":
        def derived(v: object) -> Column:
            return partition_value(_literal(v, data_type), data_type, config)

        if operator == "in":
            return part.isin([derived(v) for v in value])
        if operator == "=":
            return part == derived(value)
        return part >= derived(value) if operator in (">", ">=") else part <= derived(value)

    start, end, interval = config.range

    def bucket(v: int) -> int | None:
        return v - (v - start) % interval if start <= v < end else None

    if operator in ("=", "in"):
        buckets = [bucket(int(v)) for v in (value if operator == "in" else [value])]
        inside = part.isin([F.lit(b).cast("bigint") for b in buckets if b is not None])
        return inside | part.isNull() if None in buckets else inside
    value = int(value)
    # Values outside the range share the NULL partition, so it stays unless the bound shuts them out.
    if operator in (">", ">="):
        return None if value < start else part.isNull() if value >= end else part.isNull() | (part >= bucket(value))
    return None if value >= end else part.isNull() if value < start else part.isNull() | (part <= bucket(value))


def names_column(df: DataFrame, predicate: Column, name: str) -> bool:
    """Whether a predicate over ``df`` needs the column ``name``, as Spark's own analysis tells."""
    df.where(predicate)
    others = T.StructType([f for f in df.schema if f.name.lower() != name.lower()])
    try:
        df.sparkSession.createDataFrame([], others).where(predicate)
    except AnalysisException:
        return True
    return False


def touched_partitions(storage: DataFrame, predicate: Column) -> Column:
    """A condition on the derived column for the partitions in which some row meets ``predicate``.

    Any predicate will do: the partitions are found by a scan of the columns that it reads and no others. The driver gets
    one value for each partition.
    """
    found = [r[0] for r in storage.where(predicate).select(HIDDEN_COLUMN).distinct().collect()]
    part = F.col(HIDDEN_COLUMN)
    inside = part.isin([F.lit(v).cast(storage.schema[HIDDEN_COLUMN].dataType) for v in found if v is not None])
    return inside | part.isNull() if None in found else inside


def require_partition_filter(name: str, config: PartitionConfig, filtered: set[str]) -> None:
    """Raise unless a filter names the partition field of a table that demands it."""
    if config.require_filter and (config.field or "").lower() not in {f.lower() for f in filtered}:
        raise PartitionFilterRequired(f"{name} may only be read with a filter on {config.field}")
