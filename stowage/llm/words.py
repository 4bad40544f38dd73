"""An interpolated modified Kneser-Ney model of word pairs, as rows keyed by hash.

The table grows with the text it is trained on. A text's log probability is a sum over its words and pairs, each by itself,
so that any shard of the table can add its part: a word's value is its own log probability and its weight as a context, a
pair's value is what seeing it adds to the values of its words. A pair that was never seen adds nothing; words that were
never seen share one value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.batches import column, slices
from stowage.llm.merge_dropout import mixed
from stowage.session import discard, scratch_dir, written

KEY_BITS, LOW_BITS = 40, 24
#: The pairs of so many bytes of trusted text are one shard; there are so many shards at least.
SHARD_BYTES, SHARDS = 8 << 20, 16
#: So many pairs a task adds up before it sends their counts, a run of so many bytes of text at a time.
GATHERED, RUN_BYTES = 1_500_000, 1 << 20
#: The values of pairs are made for one in so many shards at a time, which bounds what lies on disk.
ROUNDS = 2
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707345)


@dataclass(frozen=True)
class Table:
    """The model: each of ``number`` shards is a row of ``shards(shard, size, logps)``; :func:`packed` says how it is kept."""

    shards: DataFrame
    number: int

    def count(self) -> int:
        """How many words and pairs it knows."""
        return self.shards.agg(F.sum("size")).first()[0] or 0


def _shard(gram: Column, shards: int) -> Column:
    return (F.shiftright(gram.bitwiseAND((1 << LOW_BITS) - 1), 1) % shards).cast("int")


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, as ``str.split`` finds them, and how many each text has."""
    found = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    words, doc = found.flatten(), pc.list_parent_indices(found)
    some = pc.greater(pc.binary_length(words), 0)
    doc = doc.filter(some).to_numpy(zero_copy_only=False).astype(np.int64)
    return words.filter(some), np.bincount(doc, minlength=len(texts))


def word_hashes(words: pa.Array) -> np.ndarray:
    """The key of each word; the last bit of a word's key is set. Each different word is hashed once."""
    coded = words.dictionary_encode()
    known = coded.dictionary.cast(pa.large_binary()).to_pylist()
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known)) | np.uint64(1)
    return keys[coded.indices.to_numpy()]


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of text and key of each word, with marks around texts that have words, and the words of each text."""
    words, counts = split_words(texts)
    sizes = counts + 2 * (counts > 0)
    doc, ends = np.repeat(np.arange(len(texts), dtype=np.int32), sizes), np.cumsum(sizes)[counts > 0]
    keys = np.zeros(len(doc), np.uint64)
    inner = np.ones(len(doc), bool)
    inner[ends - 1] = inner[ends - sizes[counts > 0]] = False
    keys[ends - 1], keys[ends - sizes[counts > 0]] = END, BEGIN | np.uint64(1)
    keys[inner] = word_hashes(words)
    return doc, keys, counts


def pairs(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of text, first and second word, and key of each pair of neighbours; the last bit of a pair's key is not set."""
    within = doc[1:] == doc[:-1]
    first, second = keys[:-1][within], keys[1:][within]
    return doc[1:][within], first, second, pair_keys(first, second)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(first * np.uint64(0x9E3779B97F4A7C15) ^ second) & ~np.uint64(1)


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Key, first and second word and count of each different pair."""
    key, first, second, n = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.add.reduceat(n[order], start, dtype=np.int64)
    order = order[start]
    return key[start], first[order], second[order], n


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    """All arrays as one; the list is emptied, so that the whole is not held twice."""
    whole = np.concatenate(arrays)
    arrays.clear()
    return whole


def _planes(values: np.ndarray, kind: str, width: int) -> bytes:
    return values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)[:, :width].T.tobytes()


def _of_planes(raw: bytes, at: int, size: int, kind: str, width: int) -> np.ndarray:
    out = np.zeros((size, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size).T
    return out.view(kind).ravel()


def counts_packed(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> bytes:
    """Counts of pairs: their different words once, in order, then the place of each pair's words among these."""
    known, at = np.unique(np.concatenate((first, second)), return_inverse=True)
    code = at[: len(first)].astype(np.uint64) << np.uint64(32) | at[len(first) :].astype(np.uint64)
    order = np.argsort(code)
    one, two = code[order] >> np.uint64(32), code[order] & np.uint64(0xFFFFFFFF)
    return zstandard.ZstdCompressor(level=1).compress(b"".join((
        np.array([len(known), len(first)], "<u4").tobytes(), _planes(np.diff(known, prepend=np.uint64(0)), "<u8", 8),
        _planes(np.diff(one, prepend=np.uint64(0)), "<u4", 4), _planes(two, "<u4", 4), _planes(n[order], "<u4", 4),
    )))


def counts_unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different words, the place of each pair's first and second word among them, and the pair's count."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    known, size = np.frombuffer(raw, "<u4", 2).tolist()
    at = 8 + 8 * known
    one, two, n = (_of_planes(raw, at + 4 * i * size, size, "<u4", 4) for i in range(3))
    return np.cumsum(_of_planes(raw, 8, known, "<u8", 8), dtype=np.uint64), np.cumsum(one, dtype=np.int64), two.astype(np.int64), n.astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """``(shard, pairs)``: the counts of the pairs in the column ``text``, for each shard that has some, as :func:`counts_packed`.

    What is held of a pair until it is sent are its shard, words and count, 24 bytes; only one shard's pairs are sorted at a time.
    """
    held: tuple[list[np.ndarray], ...] = ([], [], [], [])

    def sent() -> pa.RecordBatch:
        shard, first, second, n = map(_joined, held)
        order = np.argsort(shard, kind="stable")
        edges = np.cumsum(np.bincount(shard, minlength=shards)).tolist()
        del shard
        some, data = [], []
        for i, (low, high) in enumerate(zip([0, *edges], edges)):
            if low < high:
                one, two, times = (x[order[low:high]] for x in (first, second, n))
                some.append(i)
                data.append(counts_packed(*_added([(pair_keys(one, two), one, two, times)])[1:]))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], ["shard", "pairs"])

    for batch in slices(batches, "text", RUN_BYTES):
        _, first, second, key = pairs(*sequences(column(batch, "text"))[:2])
        if not len(key):
            continue
        key, first, second, n = _added([(key, first, second, np.ones(len(key), np.uint32))])
        shard = placed(key, shards) >> np.uint64(KEY_BITS)
        for parts, x in zip(held, (shard.astype(np.uint32), first, second, n.astype(np.uint32)), strict=True):
            parts.append(x)
        del first, second, key, n, shard, x
        if sum(map(len, held[0])) > GATHERED:
            yield sent()
    if held[0]:
        yield sent()


def train(spark: SparkSession, texts: DataFrame, least: int = SHARDS) -> tuple[Table, float]:
    """The value of every word and pair in the column ``text``, in ``least`` shards or more, and the value of unseen words.

    A pair's shard counts it, and gives it its value, as that takes nothing else than its count and a number of each of its
    words. So pairs are dealt once, as compressed counts; what is dealt after that is one row for each word of a shard.
    """
    from stowage.llm.quality import _discount, discounts

    texts = texts.select("text").dropna()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, least, -(-size // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(batches, shards)

    def count(rows: pa.Table) -> pa.Table:
        parts: tuple[list[np.ndarray], ...] = ([], [], [])
        for data in rows.column("pairs"):
            known, one, two, n = counts_unpacked(data.as_py())
            for some, x in zip(parts, (known[one], known[two], n.astype(np.uint32)), strict=True):
                some.append(x)
        first, second, n = map(_joined, parts)
        data = counts_packed(*_added([(pair_keys(first, second), first, second, n)])[1:])
        return pa.table([rows.column("shard").slice(0, 1), pa.array([data], pa.binary())], names=["shard", "pairs"])

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in column(batch, "pairs"):
                known, one, two, n = counts_unpacked(data)
                seen = [np.bincount(one[n == i], minlength=len(known)) for i in range(1, 5)]
                after = np.bincount(one, minlength=len(known)) - sum(seen)
                total = np.bincount(one, weights=n, minlength=len(known)).astype(np.int64)
                sums = (known.view(np.int64), *seen, after, total, np.bincount(two, minlength=len(known)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums], ["word", "n1", "n2", "n3", "n4", "more", "total", "n"])

    def of_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(column(batch, "shard"), column(batch, "pairs"), strict=True):
                known = counts_unpacked(data)[0]
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(np.full(len(known), shard, np.int32))], ["word", "shard"])

    def values(left: pa.Table, right: pa.Table) -> pa.Table:
        own = right.filter(right.column("value").is_valid())
        grams, logs = [own.column("word").to_numpy().view(np.uint64)], [own.column("value").to_numpy()]
        for data in left.column("pairs").to_pylist():
            known, one, two, n = counts_unpacked(data)
            given = right.filter(right.column("value").is_null())
            order = np.argsort(given.column("word").to_numpy().view(np.uint64))
            rest, p = (given.column(c).to_numpy()[order] for c in ("rest", "p"))
            grams.append(pair_keys(known[one], known[two]))
            logs.append(np.log1p((n - np.array(pair_d)[np.minimum(n, 3) - 1]) / rest[one] / p[two]))
        shard = (left if left.num_rows else right).column("shard").slice(0, 1)
        gram = np.concatenate(grams)
        return pa.table([shard, pa.array([len(gram)]), pa.array([packed(gram, np.concatenate(logs))], pa.binary())], names=["shard", "size", "logps"])

    scratch = scratch_dir(spark, "word-pairs")
    counted = texts.mapInArrow(run, "shard int, pairs binary").groupBy("shard").applyInArrow(count, "shard int, pairs binary")
    counted = written(counted, f"{scratch}/pairs")
    discard(spark)
    sums = ("n1", "n2", "n3", "n4", "more", "total", "n")
    words = counted.mapInArrow(of_words, "word bigint, " + ", ".join(f"{c} bigint" for c in sums))
    words = written(words.groupBy("word").agg(*[F.sum(c).alias(c) for c in sums]), f"{scratch}/words")
    tally = words.agg(
        *[F.sum(f"n{i}").alias(f"pairs{i}") for i in range(1, 5)], *[F.count_if(F.col("n") == i).alias(f"words{i}") for i in range(1, 5)],
        F.count_if(F.col("n") > 0).alias("words"), F.sum("n").alias("total"),
    ).first()
    pair_d, word_d = (discounts(*[tally[f"{kind}{i}"] or 0 for i in range(1, 5)]) for kind in ("pairs", "words"))
    total = tally["total"] or 1
    unseen = (words.agg(F.sum(_discount(F.col("n"), word_d))).first()[0] or 1.0) / total / (tally["words"] + 1)
    rest = pair_d[0] * F.col("n1") + pair_d[1] * F.col("n2") + pair_d[2] * (F.col("n3") + F.col("n4") + F.col("more"))
    p = F.when(F.col("n") > 0, (F.col("n") - _discount(F.col("n"), word_d)) / total + unseen)
    known = words.select("word", rest.alias("rest"), p.alias("p"), "total")
    value = F.coalesce(F.log("p"), F.lit(0.0)) + F.when(F.col("total") > 0, F.log(F.col("rest") / F.col("total"))).otherwise(0.0)
    none = F.lit(None).cast("double")
    single = known.select(_shard(F.col("word"), shards).alias("shard"), "word", none.alias("rest"), none.alias("p"), value.alias("value"))
    shard_of, rounds = "shard int, size bigint, logps binary", []
    for i in range(ROUNDS):
        now = F.col("shard") % ROUNDS == i
        needed = counted.where(now).mapInArrow(of_shard, "word bigint, shard int").join(known, "word")
        given = needed.select("shard", "word", "rest", "p", none.alias("value")).unionByName(single.where(now))
        made = counted.where(now).groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(values, shard_of)
        made.write.parquet(f"{scratch}/model/{i}")
        rounds.append(f"{scratch}/model/{i}")
        del needed, given, made
        discard(spark)
    discard(spark, f"{scratch}/pairs", f"{scratch}/words")
    return Table(spark.read.schema(shard_of).parquet(*rounds), shards), float(np.log(unseen))


def placed(gram: np.ndarray, shards: int) -> np.ndarray:
    """Shard and key within it, in one number."""
    shard = (gram & np.uint64((1 << LOW_BITS) - 1)) >> np.uint64(1)
    word = gram & np.uint64(1)
    # The last bit of a key tells words from pairs.
    return shard % np.uint64(shards) << np.uint64(KEY_BITS) | gram >> np.uint64(LOW_BITS + 1) << np.uint64(1) | word


def vectors(texts: list[str], shards: int) -> tuple[dict[int, bytes], np.ndarray, np.ndarray]:
    """What the texts send to each shard of which they have words or pairs; their words; and the share of pairs that repeat their most frequent one."""
    doc, keys, counts = sequences(texts)
    pair_doc, *_, pair = pairs(doc, keys)
    del _
    place = np.concatenate((placed(keys, shards), placed(pair, shards)))
    del keys, pair
    doc = np.concatenate((doc, pair_doc)).astype(np.uint64)
    del pair_doc
    width = max(len(texts) - 1, 1).bit_length()
    if KEY_BITS + (shards - 1).bit_length() + width <= 64:
        place <<= np.uint64(width)
        place |= doc
        place.sort()
        np.bitwise_and(place, np.uint64((1 << width) - 1), out=doc)
        place >>= np.uint64(width)
    else:
        order = np.lexsort((doc, place))
        doc, place = doc[order], place[order]
    start = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))) if len(doc) else np.zeros(0, np.int64)
    n = np.diff(start, append=len(doc)).astype(np.uint32)
    doc, place = doc[start].astype(np.int64), place[start]
    del start
    most = np.ones(len(texts))
    two = (place & np.uint64(1) == 0) & (n > 1)
    np.maximum.at(most, doc[two], n[two].astype(float))
    edges = np.searchsorted(place, np.arange(shards + 1, dtype=np.uint64) << np.uint64(KEY_BITS)).tolist()
    keys = place & np.uint64((1 << KEY_BITS) - 1)
    packer, widths = zstandard.ZstdCompressor(level=1), [-(-int(x.max(initial=1)).bit_length() // 8) for x in (n, doc)]
    sent = {
        i: packer.compress(b"".join((
            np.array([len(texts), high - low, *widths], "<u4").tobytes(), _planes(n[low:high], "<u4", widths[0]), _planes(doc[low:high], "<u4", widths[1]),
            _planes(np.diff(keys[low:high], prepend=np.uint64(0)), "<u8", 5),
        )))
        for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True))
        if low < high
    }
    return sent, counts, (most - 1) / (counts + 1)


def packed(gram: np.ndarray, value: np.ndarray) -> bytes:
    """One shard of the table: keys in ascending order as differences, and their values, compressed plane by plane."""
    keys = placed(gram, 1)
    order = np.argsort(keys)
    planes = (_planes(np.diff(keys[order], prepend=np.uint64(0)), "<u8", 5), _planes(value[order], "<f8", 8))
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(keys)], "<u4").tobytes() + b"".join(planes))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.cumsum(_of_planes(raw, 4, size, "<u8", 5), dtype=np.uint64), _of_planes(raw, 4 + 5 * size, size, "<f8", 8)


def partial(table: tuple[np.ndarray, np.ndarray], data: bytes, unseen: float) -> bytes:
    """Over one shard, the sum of each text that has something there."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    docs, size, *widths = np.frombuffer(raw, "<u4", 4).tolist()
    n, doc = (_of_planes(raw, 16 + at * size, size, "<u4", width) for at, width in zip((0, widths[0]), widths, strict=True))
    keys = np.cumsum(_of_planes(raw, 16 + sum(widths) * size, size, "<u8", 5), dtype=np.uint64)
    known, values = table
    found = np.where(keys & np.uint64(1) == 1, unseen, 0.0)
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        found = np.where(known[at] == keys, values[at], found)
    some = np.flatnonzero(np.bincount(doc, minlength=docs))
    sums = np.bincount(doc, weights=found * n, minlength=docs)[some]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(some)], "<u4").tobytes() + some.astype("<u4").tobytes() + sums.astype("<f8").tobytes())


def add_partial(total: np.ndarray, data: bytes) -> None:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = int(np.frombuffer(raw, "<u4", 1)[0])
    total[np.frombuffer(raw, "<u4", size, 4)] += np.frombuffer(raw, "<f8", size, 4 + 4 * size)
