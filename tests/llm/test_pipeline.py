"""Each stage on odd rows: nulls, repeated rows, shared ids, empty tables, clashing names and long texts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF_DIR = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


ROWS = [
    (1, words(1, 40), "en", "a", 1), (1, words(1, 40), "en", "a", 1), (1, words(2, 40), "en", "a", 1), (2, None, "en", None, None), (3, "", None, "b", 0),
    (None, words(3, 30), "de", "b", 5), (None, words(3, 30), "de", "b", 5), (None, words(4, 30), "de", None, 5), (4, words(5, 9000), None, "a", 6), (5, words(1, 40).upper(), "en", "c", 7),
]


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", STAGES)
def test_empty_tables(spark, docs, name):
    found = STAGES[name](spark, docs.limit(0), SF_DIR)
    assert found.collect() == [] and (name == "encode" or found.columns == docs.columns)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_clashing_names_pass_through(spark, docs, name):
    clash = docs
    for column in ("key", "kept", "digest", "component", "_mix_id", "_mix_times", "text_md5", "size", "rep"):
        clash = clash.withColumn(column, F.lit("mine"))
    found = STAGES[name](spark, clash, SF_DIR)
    assert found.columns == clash.columns
    assert {tuple(r)[5:] for r in found.collect()} <= {("mine",) * 9}


def test_quality_decides_by_text(spark, docs):
    bad = "De " * 400
    good = [r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select(*docs.columns).collect()]
    rows = [tuple(r) for r in good] + [(good[0].doc_id, bad, good[0].lang, "z", 1), (None, bad, "de", "z", 1), (None, good[1].text, good[1].lang, "z", 1)]
    verdicts = rows_of(STAGES["quality"](spark, spark.createDataFrame(rows, SCHEMA), SF_DIR))
    assert not any("De De De" in r for r in verdicts)
    assert all(verdicts.count(r) <= rows_of(spark.createDataFrame(rows, SCHEMA)).count(r) for r in set(verdicts))


def test_exact_dedup_keeps_one_row_of_each_text(spark, docs):
    found = STAGES["exact_dedup"](spark, docs, SF_DIR).collect()
    texts = [(r.text or "").lower() for r in found]
    assert len(texts) == len(set(texts)) == len({(r[1] or "").lower() for r in ROWS})
    assert {r.doc_id for r in found if (r.text or "").lower() == words(1, 40)} == {5}


def test_near_dedup_keeps_a_row_of_each_group(spark, docs):
    found = STAGES["near_dedup"](spark, docs.where("doc_id IS NOT NULL").where(F.coalesce("text", F.lit("")) != words(2, 40)).dropDuplicates(), SF_DIR).collect()
    assert {r.doc_id for r in found} == {1, 2, 3, 4}
    alone = STAGES["near_dedup"](spark, docs.where("doc_id IS NULL"), SF_DIR)
    assert alone.count() == 3


def test_mix_repeats_whole_rows(spark, docs):
    found = STAGES["mix"](spark, docs, SF_DIR)
    assert set(rows_of(found)) <= set(rows_of(docs))


def test_encode_gives_a_row_for_each(spark, docs):
    found = STAGES["encode"](spark, docs, SF_DIR)
    assert found.where("text_sha256 <> decoded_sha256").isEmpty()
    assert sorted(map(str, (r.doc_id for r in found.collect()))) == sorted(str(r[0]) for r in ROWS)
