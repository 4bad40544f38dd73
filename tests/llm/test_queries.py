import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stowage.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_registered():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == list(queries.queries()) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_matches_duckdb(spark, duck, name):
    found, expected = queries.queries()[name](spark, SF_DIR), duck.sql(queries.oracle_sql()[name])
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    in_order = lambda rows: sorted(rows, key=str)
    assert in_order(map(tuple, found.select(columns).collect())) == in_order(expected.select(*columns).fetchall())


@pytest.mark.parametrize("name", ["op1_simhash", "op2_merge_dropout", "op5_shards", "op7_quality", "op8_token_records", "op10_near_dedup"])
def test_a_row_for_each_document(spark, name):
    found = queries.queries()[name](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert found.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty() and found.count() == docs.count()


def test_chat_query(spark):
    rows = {r.conv_id: r for r in queries.op9_chat(spark, SF_DIR).collect()}
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    assert set(rows) == {-7} | {r.conv_id for r in turns.select("conv_id").distinct().collect()}
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == 26


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    now, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF_DIR)
        assert after.columns == docs.columns
        if name != "mix":
            assert after.exceptAll(now).isEmpty()
        now = spark.createDataFrame(after.collect(), docs.schema)
        sizes.append(now.count())
    assert docs.count() >= sizes[0] >= sizes[1] >= sizes[2] > 0
    folded = [r.t for r in now.selectExpr("lower(text) AS t").distinct().collect()]
    assert len(folded) == now.select("doc_id").distinct().count()
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.count() == sizes[3] and found.where("text_sha256 <> decoded_sha256").isEmpty()
