"""Merkle manifests of a table by successive rollups of nested structs.

A row's leaf is the SHA-256 of its fields. Within a group (a source) the leaves have ranks; the digits of a rank to base 16 are
columns, and grouping them away one after another nests the structs of 16 children in that of their parent, whose digest is
the SHA-256 of theirs. Three digits make a block of at most 4,096 nodes, one shuffle each; the blocks' digests are the nodes
of the next round, until a group has one node left. The groups' roots are then the leaves of one more tree.

Going back, a block meets what its own node has above it (brought together by grouping, as both have the same key), and
three levels of explode give each node of the block its own proof, with no join. No row holds more than a block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.session import scratch_dir, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGIT_BITS, DIGITS = 4, 3
HEX = 64
PROOF = "array<struct<before: string, after: string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to with the siblings of ``proof``."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, level by level, left to right."""
    return F.concat_ws("", F.transform(proof, lambda step: F.concat(step["before"], step["after"])))


def ranked(nodes: DataFrame, order: Sequence[Column], scratch: str) -> DataFrame:
    """``nodes(grp, ...)`` with ``rank`` (from 0 within ``grp``, in ``order``) and ``levels`` of the group's tree.

    Rows are dealt by ranges of group and order, so a group with a third of all rows is many ranges. What a range's
    rows of a group have before them is summed over one row for each group and range.
    """
    keys = [F.col("grp").asc_nulls_first(), *order]
    placed = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed, f"{scratch}/placed")
    part = F.shiftright("place", 33)
    runs = placed.groupBy("grp", part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("grp")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum("n").over(whole)
    levels = sum((size > F.lit(1 << DIGIT_BITS * k)).cast("int") for k in range(15))
    shifts = runs.select(
        F.col("grp").alias("of_grp"), "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        levels.alias("levels"),
    )
    met = placed.join(shifts, placed["grp"].eqNullSafe(shifts["of_grp"]) & (part == shifts["part"]))
    return met.select(*nodes.columns, (F.col("place") + F.col("shift")).alias("rank"), "levels")


def _digit(k: int) -> Column:
    return F.shiftright("rank", DIGIT_BITS * k).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int")


def blocks(nodes: DataFrame, base: int) -> DataFrame:
    """``(grp, levels, block, digest, run, kids)`` from ``nodes(grp, levels, rank, digest, item)`` above ``base`` levels.

    ``run`` are the digests of the children one after another, ``kids`` their structs. A level that the group's tree
    does not have passes its only node on as it is.
    """
    block = F.shiftright("rank", DIGIT_BITS * DIGITS)
    now = nodes.select("grp", "levels", block.alias("block"), *[_digit(k).alias(f"d{k}") for k in range(DIGITS)], "digest", "item")
    now = now.repartition("grp", "block")
    inner = ["digest", "item"]
    for k in range(DIGITS):
        left = [f"d{i}" for i in range(k + 1, DIGITS)]
        kid = F.struct(F.col(f"d{k}").alias("at"), *inner)
        now = now.groupBy("grp", "levels", "block", *left).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        now = now.withColumn("run", F.concat_ws("", F.col("kids.digest")))
        hashed = F.when(F.col("levels") > base + k, F.sha2("run", 256)).otherwise(F.col("run"))
        now = now.withColumn("digest", hashed)
        inner = ["digest", "run", "kids"]
    return now.select("grp", "levels", "block", *inner)


def rollup(nodes: DataFrame, scratch: str) -> list[DataFrame]:
    """Tables of blocks from the leaves up; in the last each group has one row, whose digest is its root."""
    tables = []
    while True:
        base = DIGITS * len(tables)
        tables.append(written(blocks(nodes, base), f"{scratch}/level-{base}"))
        last = tables[-1].agg(F.max("block")).first()[0]
        if not last:
            return tables
        nodes = tables[-1].select("grp", "levels", F.col("block").alias("rank"), "digest", F.col("block").alias("item"))


ABOVE = ("proof", "subroot", "root")


def proofs(table: DataFrame, base: int, above: DataFrame) -> DataFrame:
    """``(grp, item, digest, proof, subroot, root)`` for every node of a table of blocks.

    ``above(grp, block, proof, subroot, root)`` says what each block has above it; both are grouped together by their key.
    """
    own, upper = ("levels", "run", "kids"), ABOVE
    kinds = dict(above.dtypes) | dict(table.dtypes)
    rows = [
        frame.select("grp", "block", *[F.col(c) if c in frame.columns else F.lit(None).cast(kinds[c]).alias(c) for c in (*own, *upper)])
        for frame in (table, above)
    ]
    now = rows[0].unionByName(rows[1]).groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in (*own, *upper)])

    def step(level: int, run: Column, at: Column) -> Column:
        before, after = run.substr(F.lit(1), at * HEX), run.substr((at + 1) * HEX + 1, F.length(run))
        rest = F.struct(before.alias("before"), after.alias("after"))
        return F.when(F.col("levels") > base + level, F.array(rest)).otherwise(F.array().cast(PROOF))

    for k in reversed(range(1, DIGITS)):
        opened = now.select("grp", "levels", *upper, F.col("run").alias("over"), F.inline("kids"))
        now = opened.select(
            "grp", "levels", F.concat(step(k, F.col("over"), F.col("at")), F.col("proof")).alias("proof"), "subroot", "root", "run", "kids"
        )
    given = F.transform("kids", lambda kid: F.struct(
        kid["item"].alias("item"), kid["digest"].alias("digest"), F.concat(step(0, F.col("run"), kid["at"]), F.col("proof")).alias("proof"),
    ))
    return now.select("grp", "subroot", "root", F.inline(given)).select("grp", "item", "digest", *upper)


def _descend(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    for number in reversed(range(len(tables))):
        found = proofs(tables[number], DIGITS * number, above)
        above = found.select("grp", F.col("item").alias("block"), *ABOVE) if number else found
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id",
             carry: Mapping[str, Column] | None = None) -> DataFrame:
    """``(doc_id, source, leaf, subroot, root, proof)`` and the columns of ``carry``, one row for each row of ``docs``.

    ``proof`` is an array of ``(before, after)``, the siblings' digests left and right of the row's own path, from its leaf up
    to ``root``; :func:`fold` leads the leaf back to it. Rows of a group ascend by ``order``, nulls first, and rows that are
    equal in it by their leaf; repeated rows are leaves of their own. Null is a group of its own and comes first, the others
    ascend by their UTF-8 bytes. A null field is told from an empty one. A row alone has no siblings and is the root
    itself. ``carry`` gives expressions over ``docs`` that go along. Other columns are ignored, whatever their
    names; an empty input gives no rows.
    """
    scratch, carry = scratch_dir(docs.sparkSession, "merkle"), dict(carry or {})
    columns = [docs[f"`{f}`"] for f in fields]
    item = F.struct(docs[order].alias("key"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())])
    leaves = docs.select(docs[group].cast("string").alias("grp"), leaf_digest(columns).alias("digest"), item.alias("item"))
    # Written first, as dealing by ranges reads its input twice.
    leaves = ranked(written(leaves, f"{scratch}/digests"), [F.col("item.key").asc_nulls_first(), F.col("digest")], f"{scratch}/leaves")
    tables = rollup(leaves, f"{scratch}/leaves")
    roots = tables[-1].select(F.lit(0).alias("grp"), "digest", F.struct(F.col("grp").alias("key")).alias("item"))
    roots = ranked(roots, [F.col("item.key").asc_nulls_first()], f"{scratch}/roots")
    upper = rollup(roots, f"{scratch}/roots")
    top = upper[-1].select("grp", "block", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    groups = _descend(upper, top)
    groups = groups.select(F.col("item.key").alias("grp"), F.lit(0).cast("bigint").alias("block"), "proof", F.col("digest").alias("subroot"), "root")
    found = _descend(tables, written(groups, f"{scratch}/groups"))
    return found.select(
        F.col("item.key").alias(order), F.col("grp").alias(group), F.col("digest").alias("leaf"), "subroot", "root", "proof",
        *[F.col(f"item.c{i}").alias(name) for i, name in enumerate(carry)],
    )


def tamper(docs: DataFrame, every: int = 5) -> Column:
    """The text, with A-Z in lower case where ``every`` divides the CRC-32 of the decimal ``doc_id``."""
    marked = F.crc32(docs["doc_id"].cast("string").cast("binary")) % every == 0
    lowered = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(marked, lowered).otherwise(docs["text"])


def verification(docs: DataFrame, every: int = 5) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``: the manifest, held against rows of which some
    are tampered with (see :func:`tamper`). A row without id is never tampered with."""
    changed = leaf_digest([tamper(docs, every) if f == "text" else docs[f] for f in FIELDS])
    found = manifest(docs, carry={"seen_leaf": changed})
    folded = fold(F.col("seen_leaf"), F.col("proof"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
