import datetime

import pytest
from conftest import same_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.errors import UnsupportedFormat
from stowage.operators.tables import read_snapshot, snapshot_table
from stowage.sources import formats
from stowage.sources.formats import FileFormat, resolve_format


def test_mapping_goes_before_the_general_option():
    options = {
        "table_data_archive_format": "csv",
        "table_data_archive_format_mapping": {"a": "PARQUET"},
        "table_data_archive_compression_mapping": {"a": "Snappy"},
    }
    assert resolve_format("a", options) == FileFormat("parquet", "snappy")
    assert resolve_format("b", options) == FileFormat("csv", "gzip")
    assert resolve_format("c", {}) == FileFormat("parquet", "zstd")


@pytest.mark.parametrize(
    "options",
    [
        {"table_data_archive_format": "xls"},
        {"table_data_archive_compression": "deflate"},
        {"table_data_archive_format": "csv", "table_data_archive_compression": "zstd"},
    ],
)
def test_unknown_formats_and_codecs_are_refused(options):
    with pytest.raises(UnsupportedFormat):
        resolve_format("t", options)


def test_csv_refuses_nested_columns(spark, tmp_path):
    df = spark.range(1).select(F.array("id").alias("a"), F.lit(1).alias("b"))
    with pytest.raises(UnsupportedFormat, match="a"):
        snapshot_table(df, str(tmp_path / "x"), FileFormat("csv", "none"))


def awkward(spark):
    texts = [None, "", "\\N", "\\\\N", "\\", '\\"', " padded ", '"quoted" , text', "a\nb", "a\r\nb\rc", "\r", "\n", "#c",
             '"', '""', ",", "é x\x00y", "NULL", "null", "\t"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "i int, t string").select(
        "*",
        F.expr("timestamp_micros((i - 10) * 10000000000000001L)").alias("instant"),
        F.expr("CASE WHEN i > 0 THEN timestamp_ntz'1970-01-01 00:00:00.000001' + make_dt_interval(i * 200000, 0, 0, 0.5) END").alias("local"),
        F.expr("timestamp_ntz'9999-12-31 23:59:59.999999'").alias("last"),
        F.expr("date'0001-01-01' + i * 200000").alias("day"),
        F.expr("CAST(i / 3 AS FLOAT)").alias("f"),
        F.expr("CASE i WHEN 0 THEN double('Infinity') WHEN 1 THEN double('-Infinity') WHEN 2 THEN double('NaN') ELSE i / 7 END").alias("d"),
        F.expr("CAST(i / 7 AS DECIMAL(38, 9))").alias("dec"),
        F.expr("i % 2 = 0").alias("flag"),
    )


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize(
    "fmt", [FileFormat(n, c) for n in ("parquet", "csv") for c in formats.CODECS[n]], ids=lambda f: f"{f.name}-{f.codec}"
)
def test_every_value_survives(spark, tmp_path, fmt, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = awkward(spark).repartition(3)
        seen = snapshot_table(df, str(tmp_path / "x"), fmt)
        back = read_snapshot(spark, str(tmp_path / "x"), fmt, df.schema, multi_line=seen["multi_line"])
        assert seen["rows"] == 20
        assert seen["multi_line"] is (fmt.name == "csv")
        assert back.schema.simpleString() == df.schema.simpleString()
        assert same_rows(df, back)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_files_without_line_breaks_stay_splittable(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("t"))
    assert snapshot_table(df, str(tmp_path / "x"), FileFormat("csv", "none"))["multi_line"] is False


def test_nested_values_survive_parquet(spark, tmp_path):
    schema = "id bigint, s struct<a: bigint, b: struct<c: string, d: array<struct<e: double>>>>, m map<string, int>"
    df = spark.createDataFrame([(1, (2, ("x", [(1.5,), (None,)])), {"k": 1}), (2, None, None)], schema)
    fmt = FileFormat("parquet", "zstd")
    snapshot_table(df, str(tmp_path / "x"), fmt)
    back = read_snapshot(spark, str(tmp_path / "x"), fmt, df.schema)
    assert back.orderBy("id").collect() == df.orderBy("id").collect()


def test_datetimes_at_any_depth_become_text_for_row_formats():
    schema = T.StructType.fromDDL("a timestamp_ntz, b struct<c: array<timestamp_ntz>, d: timestamp>, e date")
    stored = formats.stored_schema(schema, FileFormat("avro", "deflate"))
    assert stored.simpleString() == "struct<a:string,b:struct<c:array<string>,d:timestamp>,e:date>"
    assert formats.has_datetime(schema)
    assert not formats.has_datetime(T.StructType.fromDDL("a timestamp, b string"))


def test_nested_datetime_text_is_cast_back_in_one_projection(spark):
    fmt = FileFormat("avro", "deflate")
    moment = datetime.datetime(2024, 3, 10, 2, 30, 0, 5)
    df = spark.createDataFrame([(1, ([moment],))], "x int, b struct<c: array<timestamp_ntz>>")
    encoded = formats.encode(df, fmt)
    assert encoded.schema["b"].dataType.simpleString() == "struct<c:array<string>>"
    assert formats.decode(encoded, df.schema, fmt).collect() == df.collect()
