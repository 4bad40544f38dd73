"""Exact dedup against a persistent index of digests.

The index is a table bucketed and sorted by digest. New rows are reduced to one row for each digest before anything is
shuffled by it, so a text that fills a third of the table travels as one row for each task. The distinct digests meet
the index in a sort-merge anti join, in which the index is neither shuffled nor sorted, and the new ones are appended.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import scratch_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_BUCKETS = 64


def text_digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes after lower-casing A-Z and nothing else; a null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


@dataclass(frozen=True)
class DigestIndex:
    """A table ``(digest, keep_id)``: every digest seen so far and the row that stands for it.

    One writer at a time: two sessions that add at once may both append the same digest. An add that failed while it
    appended left nothing behind, as the table's files are committed together.
    """

    spark: SparkSession
    table: str
    buckets: int = DEFAULT_BUCKETS

    @classmethod
    def create(cls, spark: SparkSession, table: str | None = None, buckets: int = DEFAULT_BUCKETS) -> DigestIndex:
        """A new, empty index. Choose ``buckets`` for the size that the index will reach."""
        table = table or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {table} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )
        return cls(spark, table, buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """Rows of ``digests(digest, ...)`` whose digest the index does not hold."""
        return digests.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame) -> None:
        """Add ``fresh(digest, keep_id)``, whose digests must be new to the index; each bucket gets one file.

        Rows are dealt by their bucket, so a bucket is whole in one task however many tasks there are. There are more tasks
        than buckets, as that puts two buckets into one task less often.
        """
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        fresh.select("digest", "keep_id").repartition(4 * self.buckets, bucket).write.insertInto(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def deduplicate(index: DigestIndex, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``; adds them to ``index``.

    Of equal texts in ``docs`` the row with the largest id stays, unless the index holds the text already: then none
    stays and ``keep_id`` is the id in the index. ``group_size`` counts the rows of ``docs``. Null and empty texts are
    equal. A null id is smaller than any other; if all ids of a group are null, ``keep_id`` is null and its rows stay.
    Rows that repeat the id that stays are all kept. Other columns are ignored, whatever their names. An empty
    input gives no rows and leaves the index as it was.
    """
    spark = docs.sparkSession
    scratch = scratch_dir(spark, "exact-dedup")
    seen = written(
        docs.select(F.col(id_column).alias("doc_id"), text_digest(F.col(text_column)).alias("digest")), f"{scratch}/digests"
    )
    groups = seen.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, f"{scratch}/groups")
    fresh = written(index.unseen(groups).select("digest", "keep_id"), f"{scratch}/fresh")
    index.append(fresh)
    known = index.rows().select("digest", F.col("keep_id").alias("index_id"))
    is_new = fresh.select("digest", F.lit(True).alias("is_new"))
    verdict = groups.drop("keep_id").join(known.hint("merge"), "digest").join(is_new, "digest", "left")
    # Written, so that the join below deals both sides anew and adaptive execution can split a frequent digest.
    verdict = written(verdict, f"{scratch}/verdict")
    return seen.join(verdict, "digest").select(
        "doc_id",
        F.col("index_id").alias("keep_id"),
        "group_size",
        (F.coalesce("is_new", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("index_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
