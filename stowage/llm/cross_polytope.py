"""Near duplicates of vectors by cross-polytope hashing.

A vector is rotated at random (three rounds of random signs and a fast Hadamard transform); its hash is the axis, with sign,
to which it is then closest. Two such hashes make the code of one table. A vector is at *home* in the bucket of its code and
*visits* the buckets that come next, those for which it gives up the least. Pairs of which at least one is at home in a
bucket are candidates, and each is verified there by its cosine in double precision.

Equal vectors are one class and go on as one row. A bucket is dealt into blocks of bounded size, and every two of its blocks
meet in a group of their own, so a bucket with a third of all rows is many tasks. Groups give back counts and a forest of
links and no pairs; a pair that meets in several buckets counts in the first of them, which both codes tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.components import components
from stowage.session import scratch_dir, written

LEAST, TABLES, HASHES, PROBES, ROUNDS, SEED = 0.93, 6, 2, 2, 3, 13
BLOCK = 2048
ROWS = 256


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (their width a power of two) after a round for each row of ``signs``."""
    n, width = x.shape
    for sign in signs:
        x, half = x * sign, 1
        while half < width:
            x = x.reshape(n, width // (2 * half), 2, half)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
            half *= 2
    return x


def codes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """For every row of ``x`` and table the home bucket and then ``probes`` others; shape ``(rows, tables, 1 + probes)``."""
    n, size = x.shape
    width = max(2, 1 << (size - 1).bit_length())
    x = x / np.linalg.norm(x, axis=1)[:, None]
    padded = np.zeros((n, width))
    padded[:, :size] = x
    out = np.zeros((n, tables, 1 + probes), np.int64)
    near = min(width, probes + 1)
    for table in range(tables):
        axes, losses = [], []
        for part in range(HASHES):
            signs = np.random.default_rng((seed, table, part, width)).choice((-1.0, 1.0), (ROUNDS, width))
            turned = rotated(padded, signs)
            size_of = np.abs(turned)
            best = np.argpartition(-size_of, near - 1, axis=1)[:, :near] if near < width else np.tile(np.arange(width), (n, 1))
            height = np.take_along_axis(size_of, best, 1)
            order = np.lexsort((best, -height), axis=1)
            best, height = np.take_along_axis(best, order, 1), np.take_along_axis(height, order, 1)
            axes.append(2 * best + (np.take_along_axis(turned, best, 1) < 0))
            losses.append(height[:, :1] - height)
        home = axes[0][:, 0] * (2 * width) + axes[1][:, 0]
        others = np.concatenate((axes[0][:, 1:] * (2 * width) + axes[1][:, :1], axes[0][:, :1] * (2 * width) + axes[1][:, 1:]), axis=1)
        loss = np.concatenate((losses[0][:, 1:], losses[1][:, 1:]), axis=1)
        chosen = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, table, 0] = home
        out[:, table, 1:] = np.take_along_axis(others, chosen, 1)
    return out


def by_width(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and values (doubles, nulls as NaN) of the vectors of each width; null and empty vectors are left out."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == width)
        yield rows, values[starts[rows][:, None] + np.arange(width)]


SEEN = "vec_id bigint, label bigint, width int, vector binary"


def valid_vectors(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, width, vector)``, one row for each row; the doubles of a vector that can have links are put in bytes,
    any other vector is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, widths = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int32)
            named = (batch.column(0).is_valid().to_numpy(zero_copy_only=False)) & (batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            for at, values in by_width(batch.column(2)):
                good = named[at] & np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
                widths[at] = values.shape[1]
                for row, value in zip(at[good].tolist(), values[good], strict=True):
                    data[row] = value.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(widths), pa.array(data, pa.binary())], ["vec_id", "label", "width", "vector"])

    return rows.select("vec_id", "label", "vector").mapInArrow(run, SEEN)


def _matrix(vectors: pa.Array) -> np.ndarray:
    data = b"".join(vectors.to_pylist())
    found = np.frombuffer(data, np.float64).reshape(len(vectors), -1)
    # A power of two changes no cosine, and no square overflows or vanishes.
    return np.ldexp(found, -np.frexp(np.abs(found).max(axis=1))[1][:, None]) if len(found) else found


def coded(classes: DataFrame, tables: int, probes: int) -> DataFrame:
    """``(rep, codes)``: all buckets of each class, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                widths = piece.column(1).to_numpy()
                for width in np.unique(widths).tolist():
                    part = piece.filter(pa.array(widths == width))
                    found = codes(_matrix(part.column(2)), tables, probes)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in found], pa.binary())], ["rep", "codes"])

    return classes.select("rep", "width", "vector").mapInArrow(run, "rep bigint, codes binary")


def _entries(hashed: DataFrame, tables: int, probes: int) -> DataFrame:
    """``(tab, code, rep, home)``: each bucket that a class is at home in or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = tables * (1 + probes)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            n = batch.num_rows
            arrays = [
                np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n), found,
                np.repeat(batch.column(0).to_numpy(), each), np.tile(np.arange(each, dtype=np.int32) % (1 + probes) == 0, n),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["tab", "code", "rep", "home"])

    return hashed.mapInArrow(run, "tab int, code bigint, rep bigint, home boolean")


def _counted_here(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that meet in this bucket first: in no earlier table, and in no smaller bucket of this one."""
    none = np.int64(2**62)
    for t in range(table + 1):
        a, b = codes[i, t], codes[j, t]
        met_a = np.where((a[:, :1] == b).any(axis=1), a[:, 0], none)
        met_b = np.where((b[:, :1] == a).any(axis=1), b[:, 0], none)
        first = np.minimum(met_a, met_b)
        stay = first == (none if t < table else bucket)
        i, j = i[stay], j[stay]
    return i, j


def _linked(group: dict, least: float, table: int, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the members of each link that counts in this group, some rows at a time."""
    u, norm, home, side = group["u"], group["norm"], group["home"], group["side"]
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    for start in range(0, len(left), ROWS):
        some = left[start : start + ROWS]
        close = (u[some] @ u[right].T) / (norm[some][:, None] * norm[right][None, :]) >= least
        close &= home[some][:, None] | home[right][None, :]
        if not side.any():
            close &= some[:, None] < right[None, :]
        i, j = np.nonzero(close)
        i, j = _counted_here(group["codes"], some[i], right[j], table, bucket)
        if len(i):
            yield i, j


def _forest(n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest number reachable from each of ``n`` members over links."""
    label = np.arange(n)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    while True:
        least = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        # What a member's label stands for may have got a smaller one, too.
        np.minimum.at(now, label[i], least)
        np.minimum.at(now, label[j], least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


PARTS = "rep bigint, linked bigint, other bigint"


def verified(met: DataFrame, least: float, tables: int, probes: int) -> DataFrame:
    """``(rep, linked, other)``: how many vectors a class is linked with in one group, and a member of its tree there.

    ``met(label, width, tab, code, low, high, side, rep, home, copies, vector, codes)`` with the rows of a group together.
    """

    def finish(rows: pa.Table) -> list[tuple[np.ndarray, ...]]:
        reps = rows.column("rep").to_numpy()
        u = _matrix(rows.column("vector").combine_chunks())
        group = {
            "u": u, "norm": np.sqrt(np.einsum("ij,ij->i", u, u)), "home": rows.column("home").to_numpy(zero_copy_only=False).astype(bool),
            "side": rows.column("side").to_numpy(), "codes": np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int64).reshape(len(u), tables, 1 + probes),
        }
        found = list(_linked(group, least, rows.column("tab")[0].as_py(), rows.column("code")[0].as_py()))
        if not found:
            return []
        copies, linked = rows.column("copies").to_numpy(), np.zeros(len(u), np.int64)
        for i, j in found:
            np.add.at(linked, i, copies[j])
            np.add.at(linked, j, copies[i])
        root, some = _forest(len(u), found), np.flatnonzero(linked)
        return [(reps[some], linked[some], reps[root[some]])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([rows.column(c).to_numpy() for c in ("label", "width", "tab", "code", "low", "high")], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    out += finish(rows.slice(a, b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rep", "linked", "other"])

        for batch in batches:
            for start in range(0, batch.num_rows, 2 * BLOCK):
                waiting.append(batch.slice(start, 2 * BLOCK))
                rows = pa.Table.from_batches(waiting)
                last = [rows.column(c)[-1].as_py() for c in ("label", "width", "tab", "code", "low", "high")]
                # All but the last group are whole.
                key = np.stack([rows.column(c).to_numpy() for c in ("label", "width", "tab", "code", "low", "high")], axis=1)
                cut = int(np.argmax((key == np.array(last)).all(axis=1)))
                if cut:
                    yield from done(rows.slice(0, cut))
                waiting = rows.slice(cut).combine_chunks().to_batches()
        if waiting:
            yield from done(pa.Table.from_batches(waiting))

    return met.mapInArrow(run, PARTS)


def near_vectors(rows: DataFrame, least: float = LEAST, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK,
                 id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``rows``.

    Vectors of equal, not null labels are linked if their cosine is at least ``least``. ``n_links`` counts the other rows
    linked with a row, ``component_id`` is the smallest id reachable, ``kept`` marks the row that has it. A null label, a
    vector that is null, empty or zero or holds a null, NaN or infinite component, and a null id link with nothing: no
    links, the own id, kept. Vectors of different widths are not compared. Rows that repeat id and vector are
    rows of their own, linked with each other; different vectors that share an id have one component and links of
    their own. Other columns are ignored; an empty input gives no rows. No link below ``least`` is reported; one at
    ``least`` exactly, the hardest to find, is missed with a chance of 0.002 at a width of 64 (measured).
    """
    scratch = scratch_dir(rows.sparkSession, "cross-polytope")
    named = rows.select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(label_column).cast("bigint").alias("label"), F.col(vector_column).alias("vector"),
    )
    seen = valid_vectors(named)
    key = F.sha2(F.concat(F.col("label").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("vector")), 256)
    seen = written(seen.withColumn("key", key), f"{scratch}/seen")
    classes = seen.where("key IS NOT NULL").groupBy("key", "label", "width", "vector")
    classes = written(classes.agg(F.min("vec_id").alias("own"), F.count(F.lit(1)).alias("copies")), f"{scratch}/distinct")
    # Different vectors may share an id, so a class has a number of its own.
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), f"{scratch}/classes")
    hashed = written(coded(classes, tables, probes), f"{scratch}/codes")
    parts = written(verified(_meetings(classes, hashed, tables, probes, block, scratch), least, tables, probes), f"{scratch}/links")

    ids = classes.select("rep", "own")
    edges = parts.where("rep <> other").select("rep", "other").distinct()
    edges = edges.join(ids, "rep").select(F.col("own").alias("a"), F.col("other").alias("rep")).join(ids, "rep").select("a", F.col("own").alias("b"))
    labels = components(edges.unionByName(_shared_ids(seen, classes)))
    counts = parts.groupBy("rep").agg(F.sum("linked").alias("linked"))
    verdict = classes.join(counts, "rep", "left").join(labels, F.col("own") == F.col("node"), "left")
    verdict = verdict.select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "own").alias("component"))
    # Written, so that the join deals both sides anew and adaptive execution can split a class with very many rows.
    found = seen.select("vec_id", "key").join(written(verdict, f"{scratch}/verdict"), "key", "left")
    component = F.coalesce("component", "vec_id")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _meetings(classes: DataFrame, hashed: DataFrame, tables: int, probes: int, block: int, scratch: str) -> DataFrame:
    """The rows that :func:`verified` takes: every two blocks of every bucket that can have a pair."""
    bucket = ["label", "width", "tab", "code"]
    entries = _entries(hashed, tables, probes).join(classes.select("rep", "label", "width"), "rep")
    entries = written(entries, f"{scratch}/entries")
    sizes = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("members"), F.max("home").alias("met")).where("members > 1 AND met")
    sizes = sizes.select(*bucket, F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    live = entries.join(sizes, bucket).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A block meets every other and itself; side tells in which of the two a row is, 0 where both are one.
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    live = live.select(
        *bucket, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "rep", "home",
    )
    given = classes.select("rep", "copies", "vector").join(hashed, "rep")
    pair = [*bucket, "low", "high"]
    met = live.join(written(given, f"{scratch}/given"), "rep").select(*pair, "side", "rep", "home", "copies", "vector", "codes")
    return met.repartition(*pair).sortWithinPartitions(*pair)


def _shared_ids(seen: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b)`` between the classes of different vectors that share an id, so that the id has one component."""
    several = seen.where("key IS NOT NULL").groupBy("vec_id").agg(F.min("key").alias("key"), F.max("key").alias("last")).where("key < last")
    rows = seen.join(several.select("vec_id"), "vec_id", "left_semi").join(classes.select("key", "own"), "key").select("vec_id", "own")
    least = rows.groupBy("vec_id").agg(F.min("own").alias("a"))
    return rows.join(least, "vec_id").where("own <> a").select("a", F.col("own").alias("b"))
