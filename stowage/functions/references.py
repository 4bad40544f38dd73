"""Table and function references in SQL text, over DataFrames of statements.

A statement is cut into tokens by one regular expression and read by array functions, all inside
the JVM and one row at a time, so any number of statements needs no shuffle. This is no parser:
it knows where table names may stand (after FROM, JOIN, INTO and commas of a FROM list) and leaves
everything else to Spark, which analyses the statement anyway when it is run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space and comments before a token. Then, alternatives in order: raw, triple-quoted and plain string literals, a
# dotted chain of names, number, any other character, the end of the text.
_NAME = r"(?:`(?:[^`]|``)+`|[\p{L}_][\p{L}\p{N}_$]*)"
_NEXT_NAME = r"(?:`(?:[^`]|``)+`|[\p{L}\p{N}_$]+)"
_GAP = r"(?:\s+|--[^\n]*|(?s:/\*.*?\*/))*+"
_TOKEN = (
    r"(?s:[rR]?'''.*?''')"
    r'|(?s:[rR]?""".*?""")'
    r"|[rR]'[^']*'"
    r'|[rR]"[^"]*"'
    r"|'[^'\\]*+(?:(?:\\(?s:.)|'')[^'\\]*+)*+'"
    r'|"[^"\\]*+(?:(?:\\(?s:.)|"")[^"\\]*+)*+"'
    rf"|{_NAME}(?:\.{_NEXT_NAME})*"
    r"|[0-9][\w.]*"
    r"|(?s:.)"
    r"|\z"
)
TOKEN_PATTERN = f"{_GAP}(?:{_TOKEN})"
NAME_START = r"^(?![rR]['\"])(?:`|[\p{L}_])"

# Keywords after which a FROM list is over.
ENDS_FROM_LIST = ("WHERE", "GROUP", "HAVING", "ORDER", "SORT", "CLUSTER", "DISTRIBUTE", "LIMIT", "OFFSET", "WINDOW",
                  "QUALIFY", "UNION", "INTERSECT", "EXCEPT", "MINUS", "SELECT", "VALUES", "SET", "WHEN")
# Functions whose arguments may hold the word FROM.
FROM_ARGUMENT_FUNCTIONS = ("EXTRACT", "TRIM", "SUBSTRING", "SUBSTR", "OVERLAY", "POSITION")
# Keywords that may stand before a parenthesis without being a call.
NOT_A_CALL = ("AND", "OR", "NOT", "IN", "AS", "ON", "USING", "VALUES", "SELECT", "FROM", "WHERE", "HAVING", "BY", "OVER",
              "FILTER", "WITHIN", "EXISTS", "CASE", "WHEN", "THEN", "ELSE", "JOIN", "UNION", "ALL", "ANY", "SOME",
              "INTERSECT", "EXCEPT", "DISTINCT", "PIVOT", "UNPIVOT", "FOR", "SETS", "CUBE", "ROLLUP", "LATERAL",
              "BETWEEN", "LIKE", "RLIKE", "IS", "TABLESAMPLE", "WITH", "TABLE", "RETURN", "IF", "PARTITION", "LIMIT")

# Words before TABLE, VIEW or the like in a statement that names the object.
DEFINING = ("CREATE", "REPLACE", "TEMP", "TEMPORARY", "EXTERNAL", "MATERIALIZED", "DROP", "ALTER", "TRUNCATE", "REFRESH",
            "DESCRIBE", "DESC", "ANALYZE", "CACHE", "UNCACHE", "REPAIR", "COMMENT", "ON")
OBJECTS = ("TABLE", "VIEW", "FUNCTION", "PROCEDURE")
# Where a statement begins, besides the start of the text.
STATEMENT_STARTS = ("", ";", "BEGIN", "THEN", "ELSE", "DO")
# Where a query begins that may be just ``TABLE name``.
QUERY_STARTS = (*STATEMENT_STARTS, "(", "AS", "UNION", "ALL", "INTERSECT", "EXCEPT", "MINUS")

# Words that may stand between a keyword and the name it announces.
PASSED_OVER = ("LATERAL", "ONLY", "RECURSIVE", "IF", "NOT", "EXISTS", "EXTENDED", "FORMATTED", "LAZY")
# Words and marks that change how the text after them is read; none of them is a name itself.
STEERING = ("(", ")", ",", ";", "FROM", "JOIN", "INTO", "OVERWRITE", "UPDATE", "MERGE", "USING", "WITH", "DESCRIBE", "DESC",
            "LIKE", "CLONE", "COPY", "TO", *OBJECTS, *PASSED_OVER, *ENDS_FROM_LIST)
# What stands right before a table or CTE name.
BEFORE_NAMES = ("FROM", "JOIN", "INTO", "OVERWRITE", "UPDATE", "MERGE", "USING", "WITH", ",", "(", "DESCRIBE", "DESC", "LIKE", "CLONE",
                "COPY", "TO", *OBJECTS, *PASSED_OVER)

# States of one parenthesis level while reading a statement.
_OUTSIDE, _EXPECT, _AFTER, _ARGUMENT, _WITH, _CTE = "N", "E", "A", "X", "W", "C"
# A name is defined, changed or dropped here; it has been.
_DEFINES, _DEFINED = "D", "F"


def tokens(sql: Column) -> Column:
    """The tokens of a statement, each with the white space and comments before it; joined together it is the statement again."""
    return F.regexp_extract_all(sql, F.lit(TOKEN_PATTERN), F.lit(0))


def plain_name(token: Column) -> Column:
    """A dotted name without its backticks; a doubled one stands for itself."""
    single = F.replace(F.replace(token, F.lit("``"), F.lit("\0")), F.lit("`"), F.lit(""))
    return F.replace(single, F.lit("\0"), F.lit("`"))


# The same for an expression in SQL text.
_PLAIN = "replace(replace(replace({0}, '``', char(0)), '`', ''), char(0), '`')"


def _words(words: Iterable[str]) -> str:
    return ", ".join(f"'{word}'" for word in words)


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


# Written as SQL, because one parsed expression is built far faster than hundreds of column calls.
# Lambdas are interpreted for every token, so they are kept short, and what most tokens need is asked first.

# The token of a piece ``p`` without the white space and comments before it.
_BARE = rf"""
transform(__pieces, p -> IF(
  contains(p, '--') OR contains(p, '/*'),
  regexp_replace(p, '^{_GAP.replace(chr(92), chr(92) * 2)}', ''),
  ltrim('\t\n\u000B\u000C\r ', p)))
"""

# Tokens the reading of a statement depends on, by their positions: the marks and words that steer it, names in places
# where a table or CTE may stand, and names that are called.
_SIGNIFICANT = f"""
transform(
  filter(
    sequence(0, size(__words) - 1),
    i -> get(__words, i) IN ({_words(STEERING)})
      OR (get(__words, i - 1) IN ({_words(BEFORE_NAMES)}) OR get(__words, i + 1) = '(') AND get(__words, i) RLIKE '{_quoted(NAME_START)}'),
  i -> named_struct(
    'at', i,
    'word', get(__words, i),
    'steers', get(__words, i) IN ({_words(STEERING)}),
    'ends', get(__words, i) IN ({_words(ENDS_FROM_LIST)})))
"""


def _state(top: str, below: str = "s.below", tables: str = "s.tables", ctes: str = "s.ctes") -> str:
    return f"named_struct('top', {top}, 'below', {below}, 'tables', {tables}, 'ctes', {ctes})"


# The words beside a part ``t``.
_BEFORE, _AFTER_IT = "coalesce(get(__words, t.at - 1), '')", "coalesce(get(__words, t.at + 1), '')"
# Names the object last spoken of before ``t``.
_OBJECT = f"coalesce(try_element_at(filter(__parts, p -> p.at < t.at AND p.word IN ({_words(OBJECTS)})), -1).word, '')"
# ``s`` is the state: ``top`` is the state of the innermost parenthesis level, ``below`` those around it.
_READ = f"""
aggregate(
  __parts,
  {_state(f"'{_OUTSIDE}'", "''", "CAST(array() AS ARRAY<INT>)", "CAST(array() AS ARRAY<STRING>)")},
  (s, t) -> CASE
    -- A name before a parenthesis is a table function, except for the column list of an INSERT.
    WHEN NOT t.steers THEN CASE s.top
      WHEN '{_OUTSIDE}' THEN s
      WHEN '{_EXPECT}' THEN {_state(f"'{_AFTER}'", tables=f"IF({_AFTER_IT} <> '(' OR {_BEFORE} IN ('INTO', 'TABLE', 'OVERWRITE'), array_append(s.tables, t.at), s.tables)")}
      WHEN '{_DEFINES}' THEN {_state(f"'{_DEFINED}'", tables=f"IF({_AFTER_IT} <> '(' OR {_OBJECT} <> 'FUNCTION', array_append(s.tables, t.at), s.tables)")}
      WHEN '{_WITH}' THEN {_state(f"'{_CTE}'", ctes=f"array_append(s.ctes, lower({_PLAIN.format('get(__tokens, t.at)')}))")}
      ELSE s END
    WHEN t.ends THEN IF(s.top IN ('{_OUTSIDE}', '{_ARGUMENT}'), s, {_state(f"'{_OUTSIDE}'")})
    WHEN t.word = ',' THEN CASE s.top
      WHEN '{_AFTER}' THEN {_state(f"'{_EXPECT}'")}
      WHEN '{_CTE}' THEN {_state(f"'{_WITH}'")}
      ELSE s END
    WHEN t.word = '(' THEN {_state(f"""CASE
      WHEN {_BEFORE} IN ({_words(FROM_ARGUMENT_FUNCTIONS)}) THEN '{_ARGUMENT}'
      WHEN s.top = '{_EXPECT}' THEN '{_EXPECT}'
      ELSE '{_OUTSIDE}' END""", f"s.below || IF(s.top = '{_EXPECT}', '{_AFTER}', s.top)")}
    WHEN t.word = ')' THEN {_state("IF(s.below = '', s.top, right(s.below, 1))", "left(s.below, length(s.below) - 1)")}
    WHEN t.word = ';' THEN {_state(f"'{_OUTSIDE}'", "''")}
    ELSE {_state(f"""CASE
      WHEN t.word = 'FROM' THEN IF(s.top = '{_ARGUMENT}' OR {_BEFORE} = 'DISTINCT', s.top, '{_EXPECT}')
      WHEN t.word IN ('JOIN', 'INTO') THEN '{_EXPECT}'
      WHEN t.word = 'OVERWRITE' THEN IF({_BEFORE} = 'INSERT', '{_EXPECT}', s.top)
      WHEN t.word = 'UPDATE' THEN IF({_BEFORE} IN ({_words(STATEMENT_STARTS)}), '{_EXPECT}', s.top)
      WHEN t.word = 'MERGE' THEN IF({_BEFORE} IN ({_words(STATEMENT_STARTS)}), '{_EXPECT}', s.top)
      WHEN t.word IN ('DESCRIBE', 'DESC') THEN IF({_BEFORE} IN ({_words(STATEMENT_STARTS)}), '{_DEFINES}', s.top)
      WHEN t.word IN ({_words(OBJECTS)}) THEN CASE
        WHEN {_BEFORE} IN ({_words(DEFINING)}) AND s.top NOT IN ('{_EXPECT}', '{_AFTER}') THEN '{_DEFINES}'
        WHEN t.word = 'TABLE' AND {_BEFORE} IN ({_words(QUERY_STARTS)}) AND {_AFTER_IT} <> '(' THEN '{_EXPECT}'
        WHEN t.word = 'VIEW' THEN '{_OUTSIDE}'
        ELSE s.top END
      WHEN t.word IN ('LIKE', 'CLONE', 'COPY') THEN IF(s.top = '{_DEFINED}', '{_DEFINES}', s.top)
      WHEN t.word = 'TO' THEN IF(s.top = '{_DEFINED}' AND {_BEFORE} = 'RENAME', '{_DEFINES}', s.top)
      WHEN t.word = 'USING' THEN IF(s.top = '{_AFTER}' AND {_AFTER_IT} <> '(', '{_EXPECT}', s.top)
      WHEN t.word = 'WITH' THEN IF(s.top IN ('{_OUTSIDE}', '{_EXPECT}'), '{_WITH}', s.top)
      ELSE s.top END""")}
    END
)
"""


def _analysed(df: DataFrame, sql_col: str) -> DataFrame:
    """Add ``__pieces``, ``__tokens``, ``__words``, ``__parts``, ``__read`` and ``__named`` columns, checking that no text was lost."""
    sql = F.col(sql_col)
    df = df.withColumn("__pieces", tokens(sql))
    df = df.withColumn(
        "__pieces",
        F.when(F.array_join("__pieces", "") == sql, F.col("__pieces")).when(
            sql.isNotNull(), F.raise_error(F.lit("statement could not be cut into tokens"))
        ),
    )
    df = df.withColumn("__tokens", F.expr(_BARE))
    df = df.withColumn("__words", F.transform("__tokens", F.upper))
    # Operators, numbers and literals change nothing in how a statement is read.
    df = df.withColumn("__parts", F.expr(_SIGNIFICANT))
    # A fold over the tokens; collects positions of table references, and CTE names.
    df = df.withColumn("__read", F.expr(_READ))
    # Where a table name stands, bare hyphens belong to it.
    df = df.withColumn("__spans", F.expr(_SPANS))
    df = df.withColumns({name: F.expr(_JOINED.format(name)) for name in ("__pieces", "__tokens")})
    named = F.transform(F.col("__read")["tables"], lambda at: F.struct(at.alias("at"), plain_name(F.get(F.col("__tokens"), at)).alias("name")))
    tables = F.filter(named, lambda t: _not_a_cte(t["name"], F.col("__read")["ctes"]))
    return df.withColumn("__named", tables).drop("__spans")


# For each table name that a hyphen follows, its position and that of the last token which belongs to it.
_SPANS = r"""
transform(
  filter(__read.tables, at -> get(__pieces, at + 1) = '-'),
  at -> named_struct('at', at, 'last', at + aggregate(
    slice(__pieces, at + 2, size(__pieces)),
    named_struct('n', 0, 'whole', 0, 'on', true),
    (s, x) -> named_struct(
      'n', s.n + 1,
      'whole', IF(s.on AND s.n % 2 = 1 AND x RLIKE '^[`\\p{L}\\p{N}_]', s.n + 1, s.whole),
      'on', s.on AND IF(s.n % 2 = 0, x = '-', x RLIKE '^[`\\p{L}\\p{N}_]')),
    s -> s.whole)))
"""
_JOINED = """
IF(size(__spans) = 0, {0}, transform({0}, (x, i) -> CASE
  WHEN exists(__spans, s -> s.at = i)
    THEN array_join(slice({0}, i + 1, filter(__spans, s -> s.at = i)[0].last - i + 1), '')
  WHEN exists(__spans, s -> s.at < i AND i <= s.last) THEN ''
  ELSE x END))
"""


def _not_a_cte(name: Column, ctes: Column) -> Column:
    return ~F.array_contains(ctes, F.lower(name))


def _calls(read: Column) -> Column:
    """Positions of names used as functions."""
    return F.filter(
        F.transform(F.filter("__parts", lambda p: ~p["steers"] & (F.get(F.col("__words"), p["at"] + 1) == "(")), lambda p: p["at"]),
        lambda at: ~F.get(F.col("__words"), at).isin(*NOT_A_CALL)
        & ~F.array_contains(read["tables"], at)
        & _not_a_cte(F.get(F.col("__tokens"), at), read["ctes"]),
    )


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop("__pieces", "__tokens", "__words", "__parts", "__read", "__named")


def with_references(df: DataFrame, sql_col: str, tables_col: str = "tables", functions_col: str = "functions") -> DataFrame:
    """Add the distinct table names and function names of each statement as two arrays."""
    read = F.col("__read")
    tables = F.transform("__named", lambda t: t["name"])
    calls = F.transform(_calls(read), lambda at: plain_name(F.get(F.col("__tokens"), at)))
    return _drop_helpers(
        _analysed(df, sql_col)
        .withColumn(tables_col, F.array_distinct(tables))
        .withColumn(functions_col, F.array_distinct(calls))
    )


def _exploded(df: DataFrame, sql_col: str, names_col: str) -> DataFrame:
    # The outer form, filtered afterwards: for the inner one Spark would push a "size > 0" test below
    # the projections and read every statement several times.
    return (
        with_references(df, sql_col, "__tables", "__functions")
        .withColumn("reference", F.explode_outer(names_col))
        .filter(F.col("reference").isNotNull())
        .drop("__tables", "__functions")
    )


def table_references(df: DataFrame, sql_col: str) -> DataFrame:
    """One row per statement and table it names; CTE names are left out, 1-, 2- and 3-part names kept."""
    return _exploded(df, sql_col, "__tables")


def function_references(df: DataFrame, sql_col: str, known: DataFrame | None = None) -> DataFrame:
    """One row per statement and function it calls; with ``known(name)``, only calls to those names."""
    found = _exploded(df, sql_col, "__functions")
    if known is None:
        return found
    return found.join(known, F.lower(found["reference"]) == F.lower(known["name"]), "left_semi")


def qualify(name: Column, project: str | Column, dataset: str | Column) -> Column:
    """A full ``project.dataset.name``: three parts are kept, missing ones are filled in."""
    project = F.lit(project) if isinstance(project, str) else project
    dataset = F.lit(dataset) if isinstance(dataset, str) else dataset
    size = F.size(F.split(name, r"\."))
    return (
        F.when(size == 2, F.concat_ws(".", project, name))
        .when(size == 1, F.concat_ws(".", project, dataset, name))
        .otherwise(name)
    )


def relocation_mapping(source_project: str, source_dataset: str, target_project: str, target_dataset: str,
                       extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Dataset names to replace: the caller's entries, then the source, if the target differs from it.

    The caller's mapping is copied, not changed.
    """
    mapping = dict(extra or {})
    if (source_project, source_dataset) != (target_project, target_dataset):
        mapping[f"{source_project}.{source_dataset}"] = f"{target_project}.{target_dataset}"
        mapping[source_dataset] = target_dataset
    return mapping


def _lookup(mapping: Mapping[str, str]) -> Column:
    entries = []
    for key, value in mapping.items():
        quoted_value = ".".join(p if p.isidentifier() else f"`{p}`" for p in value.replace("`", "").split("."))
        entries += [F.lit(key.replace("`", "").lower()), F.lit(quoted_value)]
    if not entries:
        return F.lit(None).cast("map<string, string>")
    return F.create_map(*entries)


# The new text of the piece ``p`` at position ``i``. ``n`` holds the parts of its name. Most pieces are no table, no call and
# do not begin with a table name, and stay. What is asked of every piece is used twice, or Spark would compute it anew for each of them.
_REPLACED = r"""
transform(__pieces, (p, i) -> IF(
  NOT (array_contains(__at, i) OR array_contains(__calls, i)
    OR contains(get(__tokens, i), '.') AND get(__tokens, i) RLIKE '__name_start'
      AND exists(__names, name -> startswith(lower(__plain(t)), name || '.'))),
  p,
  left(p, length(p) - length(get(__tokens, i))) || transform(
    array(split(__plain(t), '\\.')),
    n -> coalesce(
      CASE
        WHEN array_contains(__at, i) THEN coalesce(
          __whole[lower(array_join(n, '.'))],
          __datasets[lower(array_join(slice(n, 1, size(n) - 1), '.'))] || __tail(n, size(n) - 1))
        WHEN array_contains(__calls, i) THEN
          __datasets[lower(array_join(slice(n, 1, size(n) - 1), '.'))] || __tail(n, size(n) - 1)
        WHEN size(n) > 1 THEN try_element_at(
          filter(
            transform(sequence(1, size(n) - 1), k -> IF(
              array_contains(__names, lower(array_join(slice(n, 1, k), '.'))) AND size(__names) > 0,
              coalesce(
                __whole[lower(array_join(slice(n, 1, k), '.'))],
                __datasets[lower(array_join(slice(n, 1, k - 1), '.'))] || __tail(slice(n, 1, k), k - 1)
              ) || __tail(n, k),
              NULL)),
            x -> x IS NOT NULL),
          -1)
      END,
      get(__tokens, i))
  )[0]
))
"""
# The rest of a name after its first ``count`` parts, quoted where it needs to be.
_TAIL = (
    r"aggregate(slice({parts}, {count} + 1, size({parts})), '', "
    r"(a, p) -> a || '.' || IF(p RLIKE '^[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*$', p, concat('`', replace(p, '`', '``'), '`')))"
)
_REPLACED = re.sub(
    r"__tail\(((?:slice\([^()]*\)|n)), ((?:size\(n\)|k)(?: - 1)?)\)",
    lambda m: _TAIL.format(parts=m[1], count=m[2]),
    _REPLACED,
).replace("__plain(t)", _PLAIN.format("get(__tokens, i)")).replace("__name_start", _quoted(NAME_START))


def rewrite_references(
    df: DataFrame,
    sql_col: str,
    mapping: Mapping[str, str],
    table_mapping: Mapping[str, str] | None = None,
) -> DataFrame:
    """Replace references in a column of statements.

    ``mapping`` holds dataset names (``project.dataset`` or ``dataset``): it applies to table names and
    called functions that have exactly one more part than the key. ``table_mapping`` holds whole
    table names. Every name is looked up once, so no replacement is replaced again. Column names
    qualified by a full table name follow that table. String literals, comments, aliases and names
    that merely contain a key stay as they are. Names compare without regard to case.
    """
    df = _analysed(df, sql_col)
    df = df.withColumns(
        {
            "__calls": _calls(F.col("__read")),
            "__at": F.transform("__named", lambda t: t["at"]),
            "__names": F.transform("__named", lambda t: F.lower(t["name"])),
            "__datasets": _lookup(mapping),
            "__whole": _lookup(table_mapping or {}),
        }
    )
    df = df.withColumn(sql_col, F.array_join(F.expr(_REPLACED), ""))
    return _drop_helpers(df).drop("__calls", "__at", "__names", "__datasets", "__whole")
