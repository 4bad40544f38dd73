"""Reading object definitions from the session catalog."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.errors import StowageError
from stowage.session import quoted, small_frame

# Table properties the library keeps for itself; every other property is a label.
RESERVED = "stowage."
KIND = RESERVED + "kind"
STORAGE = RESERVED + "storage"
STORAGE_OF = RESERVED + "storage_of"
KEPT_FROM = RESERVED + "kept_from"
PREVIOUS = RESERVED + "previous"
REPLACES = RESERVED + "replaces"
PARTITION = RESERVED + "partition"
REQUIRED = RESERVED + "required"
QUERY = RESERVED + "query"
NAMESPACE = RESERVED + "namespace"
ENABLE_REFRESH = RESERVED + "enable_refresh"
REFRESH_INTERVAL = RESERVED + "refresh_interval_seconds"
INCREMENTAL = RESERVED + "incremental"
REFRESHED_AT = RESERVED + "refreshed_at"
LABELS = RESERVED + "labels"

# Fixed value: what Spark shows in place of a property whose key or value looks like a secret or an address.
REDACTED = "*********(redacted)"

ROUTINES = "stowage_routines"


def describe(spark: SparkSession, database: str, name: str) -> dict:
    """``DESCRIBE TABLE EXTENDED … AS JSON`` as a dict."""
    return json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(database, name)} AS JSON").first()[0])


def _encoded(text: str) -> str:
    return text.encode().hex()


def _decoded(text: str) -> str:
    return bytes.fromhex(text).decode()


def stored(properties: Mapping[str, str]) -> dict[str, str]:
    """Properties as they are put on an object.

    Spark hides values in which it sees a secret or an address, so the library's own are kept as hexadecimal digits, and
    labels once more in the same way beside their readable form.
    """
    labels = {k: str(v) for k, v in properties.items() if not k.startswith(RESERVED)}
    own = {k: _encoded(str(v)) for k, v in properties.items() if k.startswith(RESERVED)}
    if labels:
        own[LABELS] = _encoded(json.dumps(labels))
    return {**labels, **own}


def visible(values: Mapping[str, str], what: str) -> dict[str, str]:
    """``values``, or an error that names the keys which Spark does not show."""
    hidden = sorted(k for k, v in values.items() if v == REDACTED)
    if hidden:
        raise StowageError(f"Spark hides the value of {what} {', '.join(hidden)}")
    return dict(values)


def properties_of(description: dict) -> dict[str, str]:
    """Properties as they were given to :func:`stored`; labels set by other means may be hidden."""
    found = dict(description.get("table_properties") or {})
    labels = json.loads(_decoded(found.pop(LABELS, "7b7d")))
    for key, value in found.items():
        if key.startswith(RESERVED):
            found[key] = _decoded(value)
        elif value == REDACTED:
            found[key] = labels.get(key, value)
    return found


def labels_of(description: dict) -> dict[str, str]:
    labels = {k: v for k, v in properties_of(description).items() if not k.startswith(RESERVED)}
    return visible(labels, "label")


def options_of(description: dict) -> dict[str, str]:
    """Reader options of an external table."""
    return visible(description.get("storage_properties") or {}, "option")


def _data_type(described: dict) -> T.DataType:
    kind = described["name"]
    if kind == "struct":
        return T.StructType([_field(f) for f in described["fields"]])
    if kind == "array":
        return T.ArrayType(_data_type(described["element_type"]), described.get("element_nullable", True))
    if kind == "map":
        key, value = _data_type(described["key_type"]), _data_type(described["value_type"])
        return T.MapType(key, value, described.get("value_nullable", True))
    if kind == "decimal":
        return T.DecimalType(described["precision"], described["scale"])
    length = f"({described['length']})" if "length" in described else ""
    return T.StructType.fromDDL(f"c {kind}{length}")["c"].dataType


def _field(described: dict) -> T.StructField:
    metadata = {"comment": described["comment"]} if described.get("comment") else {}
    return T.StructField(described["name"], _data_type(described["type"]), described.get("nullable", True), metadata)


def schema_of(description: dict) -> T.StructType:
    """Columns as the catalog keeps them, without analysing the object."""
    return T.StructType([_field(c) for c in description["columns"]])


def required_of(properties: dict[str, str]) -> list[str]:
    """Columns that must not be NULL."""
    return json.loads(properties.get(REQUIRED, "[]"))


def describe_database(spark: SparkSession, database: str) -> dict:
    """Comment, location and properties of a database."""
    rows = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE DATABASE EXTENDED {quoted(database)}").collect()}
    labels = {}
    text = rows.get("Properties") or ""
    kept = re.search(rf"\({re.escape(LABELS)},([0-9a-f]*)\)", text)
    if kept:
        labels = json.loads(_decoded(kept[1]))
    elif text.startswith("(("):
        # Labels set by plain SQL are only shown as one text.
        for pair in text[2:-2].split("), ("):
            key, _, value = pair.partition(",")
            labels[key.strip()] = value.strip()
        visible(labels, "label")
    return {"description": rows.get("Comment") or None, "location": rows.get("Location"), "labels": labels}


def describe_function(spark: SparkSession, database: str, name: str) -> dict:
    """Definition of a SQL function, from the JSON in its usage text."""
    for row in spark.sql(f"DESCRIBE FUNCTION EXTENDED {quoted(database, name)}").collect():
        text = row[0]
        if text.startswith("Usage: {"):
            values = json.loads(text[len("Usage: "):])
            parts = int(values.get("catalogAndNamespace.numParts", 0))
            return {
                "body": values.get("sqlFunction.expression"),
                "arguments_sql": values.get("sqlFunction.inputParam") or "",
                "return_type": values.get("sqlFunction.returnType"),
                "description": values.get("sqlFunction.comment"),
                "is_table_function": values.get("sqlFunction.isTableFunc") == "true",
                "namespace": ".".join(values[f"catalogAndNamespace.part.{i}"] for i in range(parts)),
            }
    return {}


def list_objects(spark: SparkSession, database: str) -> DataFrame:
    """Everything in a database, one row per object, before routing.

    The catalog lists on the driver; the list is as long as the number of objects, not their data.
    """
    rows = []
    for table in spark.catalog.listTables(database):
        if table.isTemporary or table.name == ROUTINES:
            continue
        found = describe(spark, database, table.name)
        properties = properties_of(found)
        if STORAGE_OF not in properties:
            rows.append((table.name, found.get("type"), properties.get(KIND), None))
    for (function,) in spark.sql(f"SHOW USER FUNCTIONS IN {quoted(database)}").collect():
        name = function.rpartition(".")[2].strip("`")
        if "." in function:
            found = describe_function(spark, database, name)
            kind = "TABLE_FUNCTION" if found.get("is_table_function") else "SCALAR_FUNCTION" if found else "OTHER_FUNCTION"
            rows.append((name, kind, None, "SQL"))
    if spark.catalog.tableExists(f"{quoted(database)}.{ROUTINES}"):
        from stowage.functions.routines import read_routines

        rows += [(r.name, r.routine_type, None, r.language) for r in read_routines(spark, database).collect()]
    return small_frame(spark, rows, "name string, object_type string, marker string, language string")


def kind_of(object_type: Column, marker: Column) -> Column:
    """Route an object by its catalog type and the kind it was created as."""
    return (
        F.when(marker.isNotNull(), marker)
        .when(object_type == "MANAGED", "table")
        .when(object_type == "EXTERNAL", "external_table")
        .when(object_type == "VIEW", "view")
        .when(object_type == "SCALAR_FUNCTION", "function")
        .when(object_type == "PROCEDURE", "stored_procedure")
        .otherwise("unsupported")
    )


def inventory(spark: SparkSession, database: str) -> DataFrame:
    """All objects of a database with their kind; what cannot be archived is kept as ``unsupported``."""
    return list_objects(spark, database).withColumn("kind", kind_of(F.col("object_type"), F.col("marker")))
