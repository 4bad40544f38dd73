import pytest

from stowage.operators.tables import load_table, read_snapshot, snapshot_table, write_table
from stowage.sources import catalog, schemas
from stowage.sources.formats import FileFormat

DDL = "id bigint, who struct<name: string, tags: array<string>>, lines array<struct<part: bigint, price: double>>, more map<string, struct<v: int>>"
REQUIRED = ["id", ["who", "name"], ["who", "tags", "[]"], ["lines", "[]", "part"], ["more", "[]", "v"]]
GOOD = [(1, ("a", ["x"]), [(1, None), (2, 2.0)], {"k": (1,)}), (2, None, None, None), (3, ("b", None), [], {})]
BAD = {
    "id": (None, None, None, None), "who.name": (4, (None, []), None, None), r"who.tags\[\]": (4, ("a", ["x", None]), None, None),
    r"lines\[\].part": (4, None, [(1, 1.0), (None, 1.0)], None), r"more\[\].v": (4, None, None, {"k": (None,)}),
}


@pytest.fixture
def schema(spark):
    return schemas.annotate(spark.createDataFrame([], DDL).schema, REQUIRED)


def test_paths_survive_a_round_trip(spark, schema):
    assert schemas.required_columns(schema) == REQUIRED
    assert schemas.from_json(schemas.to_json(schemas.from_json(schemas.to_json(schema)), REQUIRED)) == schema
    assert schemas.required_columns(schemas.from_json(schemas.to_json(schema))) == []
    modes = {r["name"]: r["mode"] for r in schemas.column_rows(schema)}
    assert modes["id"] == modes["who.name"] == modes["lines.part"] == "REQUIRED" and modes["who"] == modes["lines.price"] == "NULLABLE"


def test_good_rows_are_written_and_loaded(spark, database, schema, tmp_path):
    rows = spark.createDataFrame(GOOD, DDL)
    write_table(spark, f"{database}.t", rows, schema=schema)
    kept = catalog.required_of(catalog.properties_of(catalog.describe(spark, database, "t")))
    assert kept == REQUIRED
    fmt = FileFormat("parquet", "zstd")
    snapshot_table(spark.table(f"{database}.t"), str(tmp_path / "s"), fmt)
    load_table(spark, f"{database}.u", str(tmp_path / "s"), fmt, schema)
    assert sorted(map(str, spark.table(f"{database}.u").collect())) == sorted(map(str, rows.collect()))
    assert read_snapshot(spark, str(tmp_path / "s"), fmt, schema).count() == 3


@pytest.mark.parametrize("path", BAD)
def test_a_null_is_named_by_its_path(spark, database, schema, tmp_path, path):
    rows = spark.createDataFrame([*GOOD, BAD[path]], DDL)
    with pytest.raises(Exception, match=f"required column {path} holds NULL"):
        write_table(spark, f"{database}.first", rows, schema=schema)
    assert not spark.catalog.tableExists(f"{database}.first")
    fmt = FileFormat("parquet", "zstd")
    snapshot_table(rows, str(tmp_path / "s"), fmt)
    with pytest.raises(Exception, match=f"required column {path} holds NULL"):
        load_table(spark, f"{database}.second", str(tmp_path / "s"), fmt, schema)
    write_table(spark, f"{database}.t", spark.createDataFrame(GOOD, DDL), schema=schema)
    with pytest.raises(Exception, match=f"required column {path} holds NULL"):
        write_table(spark, f"{database}.t", rows, mode="append")
    assert spark.table(f"{database}.t").count() == 3
