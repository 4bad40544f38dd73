"""Running totals over a distributed order, without one task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY_BITS = 60
ROWS_PER_RANGE = 512


def random_key(column: Column | str, seed: int = 0) -> Column:
    """A uniform number below ``2 ** KEY_BITS`` that depends on the value and the seed alone."""
    column = F.col(column) if isinstance(column, str) else column
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null")))
    return digest_key(F.md5(text))


def digest_key(hex_digest: Column) -> Column:
    """The first ``KEY_BITS`` bits of a hexadecimal digest."""
    return F.conv(F.substring(hex_digest, 1, KEY_BITS // 4), 16, 10).cast("bigint")


def range_bits(rows: int) -> int:
    """How many leading bits of the key name a range, so that a range of ``rows`` rows in all stays small."""
    return max(6, min(30, (max(rows, 1) // ROWS_PER_RANGE).bit_length()))


def running_totals(df: DataFrame, group: Sequence[str], key: str, ties: Sequence[str], value: str, rows: int,
                   into: str = "before") -> DataFrame:
    """Add ``into``: the sum of ``value`` over the earlier rows of the group, in the order of ``key`` and ``ties``.

    ``key`` must come from :func:`random_key` or :func:`digest_key`. It is uniform, so its ranges hold about equally
    many rows, also those of a group with a third of all rows. The ranges' totals are summed first (one row for each
    range) and every range then sorts and sums its own rows. ``group`` must not hold nulls.
    """
    piece = "_range"
    df = df.withColumn(piece, F.shiftright(F.col(key), KEY_BITS - range_bits(rows)))
    keys = [*group, piece]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, keys)
        .withColumn(into, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop(piece, "_start")
    )
