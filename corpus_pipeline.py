"""From raw documents to token ids, in five stages.

Each stage takes what the one before it kept, and its decisions take effect. All but the last give back the columns of
the documents; the results of a stage are written as Parquet and read again before the next one starts. An empty input gives
no rows at any stage, and other columns than doc_id, text, lang and source pass through the first four, whatever their names.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import exact_dedup, merge_dropout, minhash, mixing, quality
from stowage.llm.queries import PIECE_MODEL
from stowage.session import scratch_dir, written


def _with_rows(docs: DataFrame, kept: DataFrame, **keys: Column) -> DataFrame:
    """Rows of ``docs`` that have a row in ``kept``, as they are; ``keys`` says how each of its columns comes from ``docs``.

    Keys are compared null-safe, so of rows that share an id, or have none, only those that were kept come back.
    """
    named = {name: f"_{name}_{uuid.uuid4().hex}" for name in keys}
    kept = kept.select(*[F.col(name).alias(alias) for name, alias in named.items()]).distinct()
    same = [value.eqNullSafe(kept[named[name]]) for name, value in keys.items()]
    return docs.join(kept, functools.reduce(Column.__and__, same), "left_semi")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier keeps, told apart by id, text and language; null and empty texts go."""
    verdict = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    digest = F.md5(F.coalesce(docs["text"], F.lit("")))
    return _with_rows(docs, verdict.where("kept"), doc_id=docs["doc_id"], text_md5=digest, lang=docs["lang"].cast("string"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts the one with the largest id; of rows that repeat both, one."""
    index = exact_dedup.DigestIndex.create(spark)
    verdict = written(exact_dedup.deduplicate(index, docs), f"{scratch_dir(spark, 'pipeline')}/copies")
    index.drop()
    digest = exact_dedup.text_digest(docs["text"])
    keys = {"doc_id": docs["doc_id"], "text_sha256": digest}
    again = verdict.where("kept").groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if again.isEmpty():
        return _with_rows(docs, verdict.where("kept"), **keys)
    once = verdict.where("kept").join(again, (verdict["doc_id"].eqNullSafe(again["doc_id"])) & (verdict["text_sha256"] == again["text_sha256"]), "left_anti")
    column = f"_digest_{uuid.uuid4().hex}"
    few = _with_rows(docs, again, **keys).withColumn(column, digest).dropDuplicates(["doc_id", column]).drop(column)
    return _with_rows(docs, once, **keys).unionByName(few)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; rows that share an id are one document, rows without id all stay."""
    return _with_rows(docs, minhash.near_duplicates(docs).where("kept"), doc_id=docs["doc_id"])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; see :func:`stowage.llm.mixing.mixed_documents`."""
    return mixing.mixed_documents(docs, seed=4)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row; a null text is empty. See :func:`stowage.llm.merge_dropout.encode_documents`."""
    return merge_dropout.encode_documents(docs, PIECE_MODEL, seed=2)


STAGES = (
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mix", mixed),
    ("encode", encoded),
)

#: The first stage's model and the last stage's merges cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{scratch}/{name}")
        docs = spark.read.parquet(f"{scratch}/{name}")
    return docs
