"""Mixing sources to target weights, to the word.

Every document gets a hash-random key. Within its source the keys are cut into ranges, the ranges' totals are summed,
and every range sorts its own rows and adds up their words: a distributed prefix sum. A source gives as many whole
epochs as its budget holds, and then the documents whose prefix sum lies below what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.prefix import random_key, running_totals
from stowage.session import scratch_dir, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source_key, source_size, target)`` for ``sizes(source_key, source, source_size)``, one row for each source.

    ``weights`` are dealt to the sources by code point, null last, and repeat. All sources share ``share_percent`` of
    the words of all by weight. A target stops at ``max_epochs`` times its source's size, and what is over is shared
    again by weight until none is above: with the sources sorted by (limit / weight), those up to some place are at
    their limit and the others share the rest, which window sums over the sources find at once.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_place") % len(weights)) + 1)
    ranked = sizes.withColumn("_place", (F.row_number().over(ordered) - 1).cast("int")).withColumn("_weight", weight.cast("bigint"))
    ranked = ranked.withColumn("_limit", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("_limit") / F.col("_weight"), "_place")
    everywhere = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everywhere) * share_percent - 100 * F.coalesce(F.sum("_limit").over(before), F.lit(0))
    ranked = ranked.withColumn("_level", left / (100 * F.sum("_weight").over(onward)))
    # Past the first source that stays below its limit the level only falls, so the largest such level holds.
    level = F.max(F.when(F.col("_level") <= F.col("_limit") / F.col("_weight"), F.col("_level"))).over(everywhere)
    target = F.least(F.col("_limit").cast("double"), F.col("_weight") * F.coalesce(level, F.lit(float("inf"))))
    return ranked.select("source_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT,
        max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, before, budget)``, one row for each row of ``docs``.

    ``taken`` counts the words that the mix takes of the document, repeats included. It is ``size`` for each whole
    epoch, plus the part of the document below the source's cut, so a source's ``taken`` add up to its target rounded
    to a word; only the document on the cut is taken in part. A null text has no words. Null is a source of its own.
    Repeated rows count each; rows with equal keys are ordered by id and size, and rows that are equal in both are
    alike. Other columns are ignored. An empty input gives no rows. The result depends on rows and seed alone.
    """
    scratch = scratch_dir(docs.sparkSession, "mixing")
    source = F.col("source").cast("string")
    sized = written(
        docs.select(
            "doc_id",
            source.alias("source"),
            F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("source_key"),
            word_count(F.col("text")).alias("size"),
            random_key("doc_id", seed).alias("key"),
        ),
        f"{scratch}/sized",
    )
    totals = written(
        sized.groupBy("source_key").agg(
            F.max("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")
        ),
        f"{scratch}/totals",
    )
    rows = totals.agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    targets = source_targets(totals, weights, share_percent, max_epochs)
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    targets = targets.select(
        "source_key", "source_size", "target", budget.alias("budget"), epochs.cast("bigint").alias("epochs")
    )
    summed = running_totals(sized.drop("source"), ["source_key"], "key", ["doc_id", "size"], "size", rows)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return summed.join(targets, "source_key").select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"),
        "before", "budget",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix repeats them, with all their columns: a document once for each time that it is taken.

    Texts stay whole, so the document on a source's cut is taken if at least half of it lies below; a document without
    words is taken once for each whole epoch. Rows are told apart by ``doc_id``: rows that share an id are taken as often
    as the one of them that is taken most. Rows without id belong together in the same way.
    """
    mixed = mix(docs, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(
        F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(1)
    )
    key, taken = (f"_{name}_{uuid.uuid4().hex}" for name in ("key", "times"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    counts = mixed.groupBy(id_text.alias(key)).agg(F.max(times.cast("int")).alias(taken)).where(F.col(taken) > 0)
    columns = [F.col(quote(c)) for c in docs.columns]
    repeated = docs.withColumn(key, id_text).join(counts, key)
    return repeated.withColumn(taken, F.explode(F.sequence(F.lit(1), F.col(taken)))).select(*columns)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
