"""Column attributes: mode, description, default expression, nested fields, and schema JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.session import quoted

DEFAULT_KEYS = ("CURRENT_DEFAULT", "EXISTS_DEFAULT")


#: Stands for the elements of an array, or the values of a map, in a path.
ELEMENT = "[]"
Path = tuple[str, ...]


def to_json(schema: T.StructType, required: Iterable[str | Sequence[str]] = ()) -> str:
    """Schema JSON in which REQUIRED columns and nested fields are marked not nullable.

    Spark's file tables report every column as nullable, hence the explicit list: names of columns, or paths of nested
    fields as :func:`required_columns` gives them.
    """
    wanted = {_path(r) for r in required}
    return T.StructType([_marked(f, (), wanted) for f in schema]).json()


def _path(name: str | Sequence[str]) -> Path:
    return (name.lower(),) if isinstance(name, str) else tuple(part.lower() for part in name)


def _marked(field: T.StructField, above: Path, wanted: set[Path]) -> T.StructField:
    path = (*above, field.name.lower())
    return T.StructField(field.name, _marked_type(field.dataType, path, wanted), path not in wanted, field.metadata)


def _marked_type(kind: T.DataType, path: Path, wanted: set[Path]) -> T.DataType:
    inner = (*path, ELEMENT)
    if isinstance(kind, T.StructType):
        return T.StructType([_marked(f, path, wanted) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_marked_type(kind.elementType, inner, wanted), inner not in wanted)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _marked_type(kind.valueType, inner, wanted), inner not in wanted)
    return kind


def relaxed(kind: T.DataType) -> T.DataType:
    """The type without any REQUIRED in it."""
    return _marked_type(kind, (), set())


def from_json(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def required_columns(schema: T.StructType) -> list[str | list[str]]:
    """What must not be NULL: names of columns, and paths of nested fields, elements and map values."""
    found: list[str | list[str]] = [f.name for f in schema if not f.nullable]
    return found + [list(path) for f in schema for path in _required_within(f.dataType, (f.name,))]


def _required_within(kind: T.DataType, path: Path) -> list[Path]:
    found: list[Path] = []
    if isinstance(kind, T.StructType):
        for field in kind:
            own = (*path, field.name)
            found += [own] * (not field.nullable) + _required_within(field.dataType, own)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        own, inner = (*path, ELEMENT), kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        filled = not (kind.containsNull if isinstance(kind, T.ArrayType) else kind.valueContainsNull)
        found += [own] * filled + _required_within(inner, own)
    return found


def first_missing(column: Column, kind: T.DataType, required: bool, path: str) -> Column | None:
    """The path of a NULL where none may be, or NULL; None if there is nothing to check."""
    checks = [F.when(column.isNull(), F.lit(path))] if required else []
    if isinstance(kind, T.StructType):
        inner = [first_missing(column.getField(f.name), f.dataType, not f.nullable, f"{path}.{f.name}") for f in kind]
        checks += [F.when(column.isNotNull(), c) for c in inner if c is not None]
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        is_map = isinstance(kind, T.MapType)
        of, filled = (kind.valueType, not kind.valueContainsNull) if is_map else (kind.elementType, not kind.containsNull)
        if filled or _required_within(of, ()):
            elements = F.map_values(column) if is_map else column
            missing = F.transform(elements, lambda x: first_missing(x, of, filled, f"{path}{ELEMENT}"))
            checks.append(F.get(F.filter(missing, lambda p: p.isNotNull()), 0))
    return F.coalesce(*checks) if checks else None


def column_rows(schema: T.StructType, prefix: str = "") -> list[dict]:
    """One row per column and nested field, for the manifest."""
    rows = []
    for field in schema:
        inner = field.dataType
        repeated = isinstance(inner, T.ArrayType)
        if repeated:
            inner = inner.elementType
        rows.append(
            {
                "name": prefix + field.name,
                "type": inner.simpleString(),
                "mode": "REPEATED" if repeated else "NULLABLE" if field.nullable else "REQUIRED",
                "description": field.metadata.get("comment"),
                "default_expression": field.metadata.get("CURRENT_DEFAULT"),
            }
        )
        if isinstance(inner, T.StructType):
            rows.extend(column_rows(inner, prefix + field.name + "."))
    return rows


def with_attributes(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` in order, cast to their types and carrying their metadata.

    A NULL where ``schema`` allows none, at any depth, fails the job that writes the result and is named by its path, so the
    check costs no extra pass and nothing is committed. A required field of a struct that is itself NULL is not missed.
    """
    return df.select([_attributed(field) for field in schema])


def _attributed(field: T.StructField) -> Column:
    given, kind = F.col(quoted(field.name)), relaxed(field.dataType)
    column = given.cast(kind)
    missing = first_missing(column, field.dataType, not field.nullable, field.name)
    if missing is not None:
        refused = F.raise_error(F.concat(F.lit("required column "), missing, F.lit(" holds NULL"))).cast(kind)
        column = F.when(missing.isNotNull(), refused).otherwise(column)
    return column.alias(field.name, metadata=field.metadata or {})


def annotate(schema: T.StructType, required: Iterable[str | Sequence[str]] = (), descriptions: dict[str, str] | None = None,
             defaults: dict[str, str] | None = None) -> T.StructType:
    """The schema with column attributes set; ``required`` holds names of columns or paths of nested fields."""
    wanted = {_path(r) for r in required}
    fields = []
    for field in schema:
        metadata = dict(field.metadata or {})
        if descriptions and field.name in descriptions:
            metadata["comment"] = descriptions[field.name]
        if defaults and field.name in defaults:
            metadata.update(dict.fromkeys(DEFAULT_KEYS, defaults[field.name]))
        marked = _marked(field, (), wanted)
        fields.append(T.StructField(field.name, marked.dataType, marked.nullable, metadata))
    return T.StructType(fields)
