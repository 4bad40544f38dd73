"""SQL functions, Python functions and named scripts.

SQL functions live in Spark's own catalog. Spark has no place for scripts and Python sources, so a
small append-only table in the database keeps them; the newest row of a name counts.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.errors import ObjectExists, StowageError
from stowage.session import literal, quoted, small_frame, using_database
from stowage.sources.catalog import ROUTINES
from stowage.sources.manifest import ARGUMENTS, fields

ROUTINE_SCHEMA = fields(
    name=T.StringType(), routine_type=T.StringType(), language=T.StringType(), body=T.StringType(), arguments=ARGUMENTS,
    return_type=T.StringType(), description=T.StringType(), imported_libraries=T.ArrayType(T.StringType()),
    version=T.LongType(),
)


def create_function(spark: SparkSession, database: str, name: str, arguments_sql: str, return_type: str, body: str,
                    description: str | None = None, overwrite: bool = False) -> None:
    """Create a SQL scalar function; names in its body resolve in ``database``."""
    if function_exists(spark, database, name):
        if not overwrite:
            raise ObjectExists(f"function {database}.{name} exists")
        spark.sql(f"DROP FUNCTION {quoted(database, name)}")
    comment = f"COMMENT {literal(description)}" if description else ""
    with using_database(spark, database):
        spark.sql(
            f"CREATE FUNCTION {quoted(database, name)} ({arguments_sql}) RETURNS {return_type} {comment} "
            f"RETURN {body}"
        )


def function_exists(spark: SparkSession, database: str, name: str) -> bool:
    return any(
        row[0].rpartition(".")[2].strip("`").lower() == name.lower() and "." in row[0]
        for row in spark.sql(f"SHOW USER FUNCTIONS IN {quoted(database)}").collect()
    )


# What a parameter list is read by: a literal, a bracket, a comma, or a stretch of other text.
_PARAMETER_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|[(<\[]|[)>\]]|,|[^'()<>\[\],]+", re.DOTALL)


def _split_parameters(text: str) -> list[str]:
    """Cut at the commas that lie in no bracket, however deep brackets go."""
    pieces, depth = [""], 0
    for token in _PARAMETER_TOKEN.findall(text):
        if token == "," and not depth:
            pieces.append("")
            continue
        depth += (token in "(<[") - (token in ")>]")
        pieces[-1] += token
    return pieces


def drop_functions(spark: SparkSession, database: str) -> None:
    """Drop the functions of a database, which dropping the database itself would leave cached in the session."""
    for (name,) in spark.sql(f"SHOW USER FUNCTIONS IN {quoted(database)}").collect():
        if "." in name:
            spark.sql(f"DROP FUNCTION IF EXISTS {quoted(database, name.rpartition('.')[2].strip('`'))}")


def arguments_of(arguments_sql: str) -> list[dict]:
    """Argument names and types from the text of a parameter list; defaults and comments are left out."""
    arguments = []
    for piece in _split_parameters(arguments_sql):
        declared = re.split(r"\s+(?:DEFAULT|COMMENT)\s+", piece.strip(), maxsplit=1, flags=re.IGNORECASE)[0]
        if declared:
            name, _, data_type = declared.partition(" ")
            arguments.append({"name": name.strip("`"), "type": data_type.strip().lower()})
    return arguments


def _store(spark: SparkSession, database: str, row: Mapping[str, object], overwrite: bool) -> None:
    table = quoted(database, ROUTINES)
    if not spark.catalog.tableExists(table):
        spark.catalog.createTable(table, source="json", schema=ROUTINE_SCHEMA)
    elif not overwrite and read_routines(spark, database).filter(F.col("name") == row["name"]).take(1):
        raise ObjectExists(f"routine {database}.{row['name']} exists")
    values = {**row, "version": time.time_ns()}
    small_frame(spark, [tuple(values.get(n) for n in ROUTINE_SCHEMA.names)], ROUTINE_SCHEMA).write.insertInto(table)


def read_routines(spark: SparkSession, database: str) -> DataFrame:
    """The current scripts and Python functions of a database."""
    table = quoted(database, ROUTINES)
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], ROUTINE_SCHEMA)
    newest = spark.table(table).groupBy("name").agg(
        F.max_by(F.struct(*[n for n in ROUTINE_SCHEMA.names if n != "name"]), "version").alias("r")
    )
    return newest.select("name", "r.*")


def create_script(spark: SparkSession, database: str, name: str, body: str, arguments: Iterable[Mapping[str, str]] = (),
                  description: str | None = None, overwrite: bool = False) -> None:
    """Keep a SQL script ``BEGIN … END`` under a name; arguments appear in it as ``:name``."""
    _store(
        spark, database,
        {"name": name, "routine_type": "PROCEDURE", "language": "SQL", "body": body,
         "arguments": [(a["name"], a["type"]) for a in arguments], "description": description,
         "imported_libraries": []},
        overwrite,
    )


def create_code_function(spark: SparkSession, database: str, name: str, body: str, return_type: str,
                         arguments: Iterable[Mapping[str, str]] = (), language: str = "PYTHON",
                         description: str | None = None, imported_libraries: Iterable[str] = (),
                         overwrite: bool = False) -> None:
    """Keep the source of a function in another language."""
    _store(
        spark, database,
        {"name": name, "routine_type": "SCALAR_FUNCTION", "language": language.upper(), "body": body,
         "arguments": [(a["name"], a["type"]) for a in arguments], "return_type": return_type,
         "description": description, "imported_libraries": list(imported_libraries)},
        overwrite,
    )


def run_script(spark: SparkSession, name: str, **arguments: object) -> DataFrame:
    """Run a kept script; names in it resolve in its database, and arguments are cast to their types."""
    database, _, script = name.rpartition(".")
    database = database or spark.catalog.currentDatabase()
    row = read_routines(spark, database).filter((F.col("name") == script) & (F.col("routine_type") == "PROCEDURE")).first()
    if row is None:
        raise StowageError(f"no script {database}.{script}")
    declared = {a["name"]: a["type"] for a in row.arguments or []}
    if set(declared) != set(arguments):
        raise StowageError(f"script {script} takes ({', '.join(declared)}), given ({', '.join(arguments)})")
    values = {}
    if arguments:
        values = spark.range(1).select([F.lit(v).cast(declared[k]).alias(k) for k, v in arguments.items()]).first().asDict()
    with using_database(spark, database):
        return spark.sql(row.body, args=values)


def register_code_functions(spark: SparkSession, database: str, allow_code: bool = False) -> list[str]:
    """Register a database's Python functions in this session as vectorised UDFs.

    The source is executed, so nothing happens unless ``allow_code`` is given. It must define a
    function of the routine's name that maps pandas Series to a pandas Series.
    """
    if not allow_code:
        return []
    names = []
    for row in read_routines(spark, database).filter("language = 'PYTHON'").collect():
        scope: dict[str, object] = {}
        exec(compile(row.body, row.name, "exec"), scope)  # noqa: S102 - asked for by the caller
        spark.udf.register(row.name, F.pandas_udf(scope[row.name], row.return_type))
        names.append(row.name)
    return names
