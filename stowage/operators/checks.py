"""Suites of data checks, each a count of violating rows.

Row-level checks of one table share a single aggregate over a single scan. Checks across rows or
tables aggregate before they shuffle, so a value that fills a third of a table travels as one row
per task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.errors import StowageError
from stowage.operators.views import create_materialized_view
from stowage.plans.jobs import error_text
from stowage.session import quoted, small_frame

PASS, FAIL, ERROR, NOT_RUN = "PASS", "FAIL", "ERROR", "NOT_RUN"
RESULT_SCHEMA = "check string, target string, status string, violations bigint, message string"

ROW_KINDS = ("not_null", "accepted_values", "predicate")
SET_KINDS = ("unique", "relationship", "same_content")


@dataclass(frozen=True)
class Check:
    """One check.

    ``kind`` is one of ``not_null`` (columns), ``accepted_values`` (columns[0], values), ``predicate``
    (sql, true for good rows), ``unique`` (columns), ``relationship`` (columns, to, to_columns) and
    ``same_content`` (to). ``table`` and ``to`` name a table or a source of the run.
    """

    name: str
    kind: str
    table: str
    columns: tuple[str, ...] = ()
    values: tuple = ()
    sql: str | None = None
    to: str | None = None
    to_columns: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    target: str | None = None


def select_checks(checks: Iterable[Check], tags: Iterable[str] | None = None, target: str | None = None) -> list[Check]:
    """Checks carrying any of ``tags`` and meant for ``target``; a check without a target fits every one."""
    wanted = set(tags or ())
    return [
        c for c in checks if (not wanted or wanted & set(c.tags)) and (target is None or c.target in (None, target))
    ]


def count_violations(condition: Column) -> Column:
    """Rows for which ``condition`` is not true."""
    return F.count_if(~F.coalesce(condition, F.lit(False)))


def row_condition(check: Check) -> Column:
    """What holds for a good row, with NULL meaning it does not."""
    if check.kind == "not_null":
        return _all(F.col(quoted(c)).isNotNull() for c in check.columns)
    if check.kind == "accepted_values":
        # A missing value is not_null's business.
        column = F.col(quoted(check.columns[0]))
        return column.isNull() | column.isin(list(check.values))
    if not check.sql:
        raise StowageError(f"check {check.name} needs sql")
    return F.expr(check.sql)


def _all(conditions: Iterable[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def duplicate_rows(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Values that occur more than once, with their number of rows; rows with a NULL do not count."""
    columns = list(columns)
    present = df.filter(_all(F.col(quoted(c)).isNotNull() for c in columns))
    return present.groupBy([F.col(quoted(c)) for c in columns]).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def orphan_rows(df: DataFrame, columns: Iterable[str], parent: DataFrame, parent_columns: Iterable[str]) -> DataFrame:
    """Values without a parent, with their number of rows; rows with a NULL have no parent to look for.

    Child rows are counted per value first, so the join sees each value once however often it occurs.
    """
    columns, parent_columns = list(columns), list(parent_columns)
    values = (
        df.filter(_all(F.col(quoted(c)).isNotNull() for c in columns))
        .groupBy([F.col(quoted(c)) for c in columns])
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # Distinct, because the right side of an anti join is not split: a parent key may fill a third of the table.
    keys = parent.select([F.col(quoted(p)).alias(f"__{i}") for i, p in enumerate(parent_columns)]).distinct()
    matches = [F.col(quoted(c)) == F.col(f"__{i}") for i, c in enumerate(columns)]
    return values.join(keys, matches, "left_anti")


COARSE_BITS, FINE_BITS = 12, 12
FIRST, SECOND = 1, 2


def row_hash(columns: Iterable[tuple[Column, T.DataType]], seed: int) -> Column:
    """A 64-bit hash of values of any type that tells NULL from every value, at any depth; equal values hash alike."""
    parts = [F.lit(seed)]
    for column, kind in columns:
        if isinstance(kind, T.StructType):
            hashed = row_hash([(column.getField(f.name), f.dataType) for f in kind], seed)
        elif isinstance(kind, T.ArrayType):
            elements = F.transform(column, lambda x, kind=kind: row_hash([(x, kind.elementType)], seed))
            hashed = F.xxhash64(F.size(column), elements)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            hashed = column + F.lit(0.0)
        else:
            hashed = column
        parts += [column.isNull(), hashed]
    return F.xxhash64(*parts)


def _hashed(df: DataFrame, sign: int) -> DataFrame:
    columns = [(F.col(quoted(f.name)), f.dataType) for f in df.schema]
    first, second = (row_hash(columns, seed) for seed in (FIRST, SECOND))
    return df.select(F.struct(*[c for c, _ in columns]).alias("row"), F.lit(sign).alias("sign"), first.alias("first"), second.alias("second"))


def _unequal(rows: DataFrame, *buckets: Column) -> DataFrame:
    """Buckets in which the multisets of both sides differ, from the sums of two hashes of each row and the rows' number.

    The halves of a hash are summed apart, as whole numbers that cannot overflow below 2^31 rows in a bucket.
    """
    halves = {f"{c}_{half}": F.sum(of(F.col(c)) * F.col("sign")) for c in ("first", "second") for half, of in
              (("high", lambda x: F.shiftright(x, 32)), ("low", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))))}
    found = rows.groupBy(*buckets).agg(F.sum("sign").alias("rows"), *[total.alias(name) for name, total in halves.items()])
    return found.where(" OR ".join(f"{name} <> 0" for name in ("rows", *halves)))


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that occur a different number of times on both sides: ``left_rows`` and ``right_rows`` per row.

    Both sides are reduced to sums of row hashes in 4,096 buckets, so tables that are equal shuffle nothing but these. Only
    rows in buckets that differ are looked at again, in 4,096 finer buckets each, and only rows in finer buckets that differ
    are compared themselves. Unequal tables that agree in both 64-bit sums of a bucket are not told apart.
    """
    if [f.dataType for f in left.schema] != [f.dataType for f in right.schema] or left.columns != right.columns:
        raise StowageError("tables with different columns cannot be compared")
    rows = _hashed(left, 1).unionAll(_hashed(right, -1))
    coarse = F.col("first").bitwiseAND((1 << COARSE_BITS) - 1)
    fine = F.shiftright("first", COARSE_BITS).bitwiseAND((1 << FINE_BITS) - 1)
    differ = [r.coarse for r in _unequal(rows, coarse.alias("coarse")).select("coarse").collect()]
    some = rows.where(coarse.isin(differ)) if differ else rows.limit(0)
    keyed = some.select("row", "sign", "first", "second", coarse.alias("coarse"), fine.alias("fine"))
    wrong = _unequal(keyed, F.col("coarse"), F.col("fine")).select("coarse", "fine")
    # Equal rows share a bucket, so they are grouped where the join has put them, without another shuffle.
    found = keyed.join(wrong, ["coarse", "fine"], "left_semi").groupBy("coarse", "fine", "row").agg(
        F.count_if(F.col("sign") == 1).alias("left_rows"), F.count_if(F.col("sign") == -1).alias("right_rows")
    )
    return found.where("left_rows <> right_rows").select("row.*", "left_rows", "right_rows")


def run_checks(
    spark: SparkSession,
    checks: Iterable[Check],
    *,
    continue_on_failure: bool = False,
    tags: Iterable[str] | None = None,
    target: str | None = None,
    variables: Mapping[str, object] | None = None,
    sources: Mapping[str, str] | None = None,
    models: Mapping[str, str] | None = None,
) -> DataFrame:
    """Run checks and return ``(check, target, status, violations, message)`` rows.

    ``variables`` fill named markers such as ``:limit`` in predicates. ``sources`` maps the table
    names of checks to other tables. ``models`` are queries materialised under their name first.
    Without ``continue_on_failure`` the tables after the first failing one are not looked at.
    """
    selected = select_checks(checks, tags, target)
    sources = dict(sources or {})
    results: dict[str, tuple] = {}
    repeated = sorted(name for name, n in Counter(c.name for c in selected).items() if n > 1)
    if repeated:
        raise StowageError(f"several checks are called {', '.join(repeated)}")
    broken: dict[str, str] = {}
    for name, query in (models or {}).items():
        try:
            create_materialized_view(spark, sources.get(name, name), query, overwrite=True)
        except Exception as error:  # noqa: BLE001 - reported as a row for each of its checks
            broken[name] = error_text(error)

    def put(check: Check, status: str, violations: int | None = None, message: str | None = None) -> None:
        results[check.name] = (check.name, check.table, status, violations, message)

    def stopped() -> bool:
        return not continue_on_failure and any(r[2] in (FAIL, ERROR) for r in results.values())

    def attempt(group: list[Check], work: Callable[[], list[int]]) -> None:
        try:
            counts = work()
        except Exception as error:  # noqa: BLE001 - reported as a row
            # One bad check must not hide the others of its table.
            if len(group) > 1:
                for check in group:
                    attempt([check], lambda check=check: _row_counts(spark, [check], sources, variables))
                return
            put(group[0], ERROR, None, error_text(error))
            return
        for check, violations in zip(group, counts, strict=True):
            put(check, FAIL if violations else PASS, violations,
                f"{violations} violating row(s)" if violations else None)

    by_table: dict[str, list[Check]] = {}
    for check in selected:
        failed = [broken[t] for t in (check.table, check.to) if t in broken]
        if failed:
            put(check, ERROR, None, failed[0])
        elif check.kind in ROW_KINDS:
            by_table.setdefault(check.table, []).append(check)
        elif check.kind not in SET_KINDS:
            put(check, ERROR, None, f"unknown check kind {check.kind!r}")
    for group in by_table.values():
        if not stopped():
            attempt(group, lambda group=group: _row_counts(spark, group, sources, variables))
    for check in selected:
        if check.kind in SET_KINDS and check.name not in results and not stopped():
            attempt([check], lambda check=check: [_set_count(spark, check, sources)])
    for check in selected:
        if check.name not in results:
            put(check, NOT_RUN)
    return small_frame(spark, [results[c.name] for c in selected], RESULT_SCHEMA)


def _row_counts(spark: SparkSession, group: list[Check], sources: Mapping[str, str],
                variables: Mapping[str, object] | None) -> list[int]:
    df = spark.table(sources.get(group[0].table, group[0].table))
    counts = []
    for i, check in enumerate(group):
        if check.kind == "predicate" and variables:
            # Named markers are bound by the SQL parser, so the predicate becomes a column first.
            flag = f"__check_{i}"
            df = spark.sql(
                f"SELECT *, ({check.sql}) AS {flag} FROM {{df}}", args=_used(check.sql or "", variables), df=df
            )
            counts.append(count_violations(F.col(flag)).alias(str(i)))
        else:
            counts.append(count_violations(row_condition(check)).alias(str(i)))
    return list(df.agg(*counts).first())


def _used(sql: str, variables: Mapping[str, object]) -> dict[str, object]:
    return {k: v for k, v in variables.items() if f":{k}" in sql}


def _set_count(spark: SparkSession, check: Check, sources: Mapping[str, str]) -> int:
    df = spark.table(sources.get(check.table, check.table))
    if check.kind == "unique":
        found = duplicate_rows(df, check.columns).agg(F.sum("rows").alias("n"))
    else:
        other = spark.table(sources.get(check.to, check.to))
        if check.kind == "relationship":
            found = orphan_rows(df, check.columns, other, check.to_columns or check.columns).agg(F.sum("rows").alias("n"))
        else:
            found = differing_rows(df, other).agg(F.sum(F.abs(F.col("left_rows") - F.col("right_rows"))).alias("n"))
    return found.first().n or 0
