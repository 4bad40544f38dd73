"""Session helpers: scratch locations and database switching."""

from __future__ import annotations

import contextlib
import gc
import threading
import time
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_CURRENT_DATABASE = threading.RLock()



def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused directory for intermediate tables.

    On a cluster this must be the shared folder named by ``spark.checkpoint.dir``; only a
    local session may fall back to its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/stowage/{label}-{uuid.uuid4().hex}"


def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A DataFrame of a few driver rows, such as names of objects.

    Handed over as one Arrow table, which Spark keeps as a local relation: no Python worker starts,
    and a large cluster does not run a task per core for a handful of rows.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    table = pa.Table.from_pylist(
        [{f.name: _arrow_value(v, f.dataType) for f, v in zip(schema, row, strict=True)} for row in rows],
        to_arrow_schema(schema),
    )
    return spark.createDataFrame(table, schema)


def _arrow_value(value: object, data_type: T.DataType) -> object:
    """Arrow takes maps as pairs and structs as dicts."""
    if value is None:
        return None
    if isinstance(data_type, T.MapType):
        return list(value.items())
    if isinstance(data_type, T.StructType):
        fields = value.items() if isinstance(value, dict) else zip(data_type.names, value, strict=True)
        return {name: _arrow_value(v, data_type[name].dataType) for name, v in fields}
    if isinstance(data_type, T.ArrayType):
        return [_arrow_value(v, data_type.elementType) for v in value]
    return value


# For work that costs some 0.2 ms a row: about half a minute for a task.
ROWS_PER_TASK = 100_000


def spread(df: DataFrame, *keys: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Deal the rows of ``df`` by ``keys`` over at least as many tasks as there are cores, each of about ``rows_per_task`` rows at most.

    For work that costs far more per row than moving and counting the rows. The number of splits tells nothing: a file of
    few row groups has empty ones, and splits are as large as a file allows. ``keys`` should be nearly unique.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows_per_task)), *keys)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a parquet table and read it back, which cuts its lineage for good.

    Unlike cached blocks the files survive the loss of an executor, and later steps cannot pull the
    work that made them into their own plans again.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: So many seconds after Python let go of a plan the JVM has done so too.
RELEASED_S = 1.3


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables below a :func:`scratch_dir` that nothing will read again.

    Spark keeps the shuffle files of finished plans until the driver collects its garbage, which a driver with room to
    spare puts off for long, so that is asked for as well, once the JVM has been told which plans Python has let go: that
    is done by a thread of its own that looks for them once a second.
    """
    for path in paths:
        if "/stowage/" not in path:
            raise ValueError(f"{path} is no scratch folder")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()
    time.sleep(RELEASED_S)
    spark._jvm.System.gc()


_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CHANGED: dict[tuple[int, str], list[str | None]] = {}
_CHANGED_LOCK = threading.Lock()


@contextlib.contextmanager
def _changed(spark: SparkSession, setting: str, value: str | None) -> Iterator[None]:
    """Give a setting a value, or leave it if that is None; threads share it, so the last block to end puts the previous value back."""
    key = (id(spark._jsparkSession), setting)
    with _CHANGED_LOCK:
        users = _CHANGED.setdefault(key, [])
        users.append(users[0] if users else spark.conf.get(setting, None))
        if value is not None:
            spark.conf.set(setting, value)
    try:
        yield
    finally:
        with _CHANGED_LOCK:
            previous = users.pop()
            if not users:
                del _CHANGED[key]
                if previous is None:
                    spark.conf.unset(setting)
                else:
                    spark.conf.set(setting, previous)


def batches_of(spark: SparkSession, size: int) -> contextlib.AbstractContextManager[None]:
    """Jobs run inside the block hand Python Arrow batches of about ``size`` bytes at most; a smaller limit of the session stays."""
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_ARROW_BYTES))
    return _changed(spark, _ARROW_BYTES, None if 0 < limit <= size else f"{size}b")


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Spark removes the shuffle files of each job run inside the block when it ends, whether or not its driver collects garbage."""
    return _changed(spark, _DROP_SHUFFLES, "true")


@contextlib.contextmanager
def using_database(spark: SparkSession, database: str) -> Iterator[None]:
    """Make ``database`` current inside the block and put the previous one back afterwards.

    The current database belongs to the session, which threads share, so only one block runs at a time.
    Keep it to the analysis of a statement and let data be written outside of it.
    """
    with _CURRENT_DATABASE:
        previous = spark.catalog.currentDatabase()
        spark.catalog.setCurrentDatabase(database)
        try:
            yield
        finally:
            spark.catalog.setCurrentDatabase(previous)


def quoted(*parts: str) -> str:
    """A backtick-quoted, dot-joined identifier."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def literal(text: str) -> str:
    """A SQL string literal holding ``text`` unchanged."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def properties_clause(properties: dict[str, str]) -> str:
    """``('k' = 'v', ...)`` as used by TBLPROPERTIES and DBPROPERTIES."""
    return "(" + ", ".join(f"{literal(k)} = {literal(str(v))}" for k, v in sorted(properties.items())) + ")"
