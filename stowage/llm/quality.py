"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

Characters are mapped to 32 classes (letters without case and accents, digits, blank, line break, kinds of marks), and the
model is of order four over these, so it knows at most 32 ** 4 = 1,048,576 n-grams whatever the corpus. It is
trained on trusted documents: tasks count n-grams, the counts are summed by Spark, and joins of each order's counts
with those of its contexts and of the next lower order give the probability of every n-gram.

That table takes 8 MB whatever the corpus, so every executor has it, and a document's perplexity is found where it is read. It
is held against a quantile of its language.

That model cannot grow, so a second one of word pairs does, keyed by hash (see :mod:`stowage.llm.words`). Scoring by it is a
sharded join: documents send each shard what they have of it, compressed, the shard's values turn that into partial sums, and
the parts of a document are added up. One of so many slices of the documents is scored at a time, so that what
they send takes a part of the disk only. A third measure catches words that are repeated over and over,
which are likely to any such model: the share of a document's word pairs that repeat its most frequent pair.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import words as word_pairs
from stowage.llm.batches import BATCH_BYTES, column, slices
from stowage.llm.members import exactly_among
from stowage.session import batches_of, discard, scratch_dir, shuffles_dropped, written

ORDER, CLASS_BITS = 4, 5
CLASSES = 1 << CLASS_BITS
GRAM_BITS = ORDER * CLASS_BITS
GRAMS = 1 << GRAM_BITS
#: Documents are scored in so many slices, one after the other.
SLICES = 6
DIGIT, BLANK, BREAK, SENTENCE, MARK, OTHER = range(26, 32)
QUANTILE, SLACK = 0.99, 1.1
#: One in so many trusted documents is left out of the model and sets the thresholds, as texts the model has seen fit it too well.
HELD_OUT = 5
#: Nats by which the mean of n symbols may lie above the threshold are this over the root of n: about two deviations.
ALLOWANCE = 3.0
#: The same for the share of repeated pairs, as one pair that comes twice is a large share of a short text.
REPEATS = 0.5
MEASURES = ("perplexity", "word_perplexity", "repeated")


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point of the first plane; letters of any script fall on the 26 letter classes."""
    table = np.full(0x10000, OTHER, np.uint8)
    for point in range(0x10000):
        char, kind = chr(point), unicodedata.category(chr(point))
        if char == "\n":
            table[point] = BREAK
        elif char.isspace():
            table[point] = BLANK
        elif kind[0] == "N":
            table[point] = DIGIT
        elif kind[0] == "L":
            base = unicodedata.normalize("NFKD", char)[0].lower()
            table[point] = ord(base) - 97 if "a" <= base <= "z" else point % 26
        elif char in ".,;:!?'\"()-":
            table[point] = SENTENCE
        elif kind[0] in "PS":
            table[point] = MARK
    return table


def grams(text: str) -> np.ndarray:
    """The code of the n-gram that ends at each character; before the text there are line breaks."""
    return all_grams([text])[0]


def all_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts one after the other, and how many each text has."""
    before = "\n" * (ORDER - 1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join([before + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _classes()[np.minimum(points, 0xFFFF)].astype(np.int32)
    codes = classes.copy()
    for i in range(1, ORDER):
        codes[i:] |= classes[:-i] << CLASS_BITS * i
    inner = np.ones(len(codes), bool)
    start = np.cumsum(sizes + len(before)) - sizes
    for i in range(1, ORDER):
        inner[start - i] = False
    return codes[inner], sizes


# -- training --------------------------------------------------------------------------------------


def gram_counts(texts: DataFrame) -> DataFrame:
    """``(gram, n)`` over the column ``text`` of all rows; each task adds up its own in an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(all_grams(column(batch, "text"))[0], minlength=GRAMS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["gram", "n"])

    counted = texts.select("text").dropna().mapInArrow(run, "gram int, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen one to four times; half a count where unknown."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), limit) for d, limit in zip(raw, (1.0, 2.0, 3.0), strict=True))


def _discount(n: Column, by_count: tuple[float, float, float]) -> Column:
    d1, d2, d3 = by_count
    return F.when(n >= 3, d3).when(n == 2, d2).when(n == 1, d1).otherwise(0.0)


def train(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """``(gram, logp)`` for all 32 ** 4 codes: the natural logarithm of the last class's probability after the others.

    The highest order counts occurrences, lower ones the different classes seen before an n-gram; each order gives what
    its discounts leave to the next lower one, the lowest to equal shares. Without any text all shares are equal.
    """
    scratch = scratch_dir(spark, "kneser-ney")
    counts = {ORDER: written(gram_counts(texts), f"{scratch}/order-{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << CLASS_BITS * order) - 1).alias("gram")
        lower = counts[order + 1].select(shorter).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counts[order] = written(lower, f"{scratch}/order-{order}")
    seen = functools.reduce(DataFrame.unionByName, [c.select(F.lit(o).alias("order"), "n") for o, c in counts.items()])
    tallies = seen.where("n <= 4").groupBy("order", "n").agg(F.count(F.lit(1)).alias("grams")).collect()
    tally = {(r["order"], r["n"]): r["grams"] for r in tallies}

    lower = spark.range(1).select(F.lit(0).alias("lower_gram"), F.lit(1.0 / CLASSES).alias("lower_p"))
    for order in range(1, ORDER + 1):
        d = discounts(*[tally.get((order, i), 0) for i in range(1, 5)])
        context = F.shiftright("gram", CLASS_BITS)
        left_over = F.sum(_discount(F.col("n"), d)) / F.sum("n")
        contexts = counts[order].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), left_over.alias("gamma"))
        every = spark.range(1 << CLASS_BITS * order).select(F.col("id").cast("int").alias("gram"))
        every = every.select(
            "gram", context.alias("context"), F.col("gram").bitwiseAND((1 << CLASS_BITS * (order - 1)) - 1).alias("lower_gram")
        )
        joined = every.join(counts[order], "gram", "left").join(contexts, "context", "left").join(lower, "lower_gram", "left")
        own = (F.coalesce("n", F.lit(0)) - _discount(F.coalesce("n", F.lit(0)), d)) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("lower_p")).otherwise(own + F.col("gamma") * F.col("lower_p"))
        if order < ORDER:
            lower = written(joined.select(F.col("gram").alias("lower_gram"), p.alias("lower_p")), f"{scratch}/p-{order}")
    model = written(joined.select("gram", F.log(p).alias("logp")), f"{scratch}/model")
    discard(spark, *(f"{scratch}/order-{o}" for o in range(1, ORDER + 1)), *(f"{scratch}/p-{o}" for o in range(1, ORDER)))
    return model


# -- scoring ---------------------------------------------------------------------------------------

#: Texts of about so many characters are scored at a time.
RUN_CHARS = 1 << 18


def log_likelihoods(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each text's log probabilities, and its length."""
    lengths, totals = np.fromiter(map(len, texts), np.int64, len(texts)), np.zeros(len(texts))
    starts = np.flatnonzero(np.diff(np.cumsum(lengths) // RUN_CHARS, prepend=-1)).tolist()
    for low, high in itertools.pairwise([*starts, len(texts)]):
        codes, sizes = all_grams(texts[low:high])
        some = np.flatnonzero(sizes)
        if len(some):
            totals[low + some] = np.add.reduceat(logp[codes], (np.cumsum(sizes) - sizes)[some])
    return totals, lengths


VECTORS = (
    "shard int, part int, seq int, vectors binary, doc_ids array<bigint>, langs array<string>, lengths array<bigint>, "
    "totals array<double>, counts array<bigint>, repeats array<double>, digests array<string>"
)
ABOUT = ("doc_ids", "langs", "lengths", "totals", "counts", "repeats", "digests")
PARTIAL = VECTORS.partition(", ")[2].replace("vectors", "sums")
SCORES = "doc_id bigint, lang string, n_symbols bigint, perplexity double, n_words bigint, word_perplexity double, repeated double, text_md5 string"


def perplexities(docs: DataFrame, model: DataFrame, words: tuple[word_pairs.Table, float] | None = None) -> DataFrame:
    """``(doc_id, lang, n_symbols, perplexity, n_words, word_perplexity, repeated, text_md5)`` of whole texts, a row for each row.

    ``words`` is what :func:`stowage.llm.words.train` gives. Without text the perplexity is null, without words or a
    model of them that of the words. The rows are written to the scratch folder.
    """
    spark = docs.sparkSession
    unseen, shards = (words[1], words[0].number) if words else (0.0, word_pairs.SHARDS)
    table = words[0].shards.select("shard", "logps") if words else spark.createDataFrame([], "shard int, logps binary")
    unknown = words is None
    logp, known = np.zeros(GRAMS), model.select("gram", "logp").toArrow()
    logp[known.column("gram").to_numpy()] = known.column("logp").to_numpy()
    logp = spark.sparkContext.broadcast(logp)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(slices(batches, "text", 1 << 21)):
            texts = [t or "" for t in column(batch, "text")]
            totals, lengths = log_likelihoods(texts, logp.value)
            of_words, counts, repeats = word_pairs.vectors(texts, shards)
            # One row says what the documents are, and so there is one even if they have no words.
            first = (part + seq) % shards
            sent = {first: of_words.pop(first, None), **of_words}
            rest = [None] * (len(sent) - 1)
            arrays = [
                pa.array(list(sent), pa.int32()),
                *(pa.array([x] * len(sent), pa.int32()) for x in (part, seq)),
                pa.array(list(sent.values()), pa.binary()),
                pa.array([column(batch, "doc_id"), *rest], pa.list_(pa.int64())),
                pa.array([column(batch, "lang"), *rest], pa.list_(pa.string())),
                pa.array([lengths.tolist(), *rest], pa.list_(pa.int64())),
                pa.array([totals.tolist(), *rest], pa.list_(pa.float64())),
                pa.array([counts.tolist(), *rest], pa.list_(pa.int64())),
                pa.array([repeats.tolist(), *rest], pa.list_(pa.float64())),
                pa.array([[hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], *rest], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["shard", "part", "seq", "vectors", *ABOUT])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        given = right.column("logps").to_pylist()
        found = word_pairs.unpacked(given[0]) if given and left.num_rows else (np.zeros(0, np.uint64), np.zeros(0))
        sums = [x and word_pairs.partial(found, x, unseen) for x in left.column("vectors").to_pylist()]
        return pa.table(
            [left.column("part"), left.column("seq"), pa.array(sums, pa.binary()), *(left.column(n) for n in ABOUT)], names=["part", "seq", "sums", *ABOUT]
        )

    def add(rows: pa.Table) -> pa.Table:
        ids, langs, lengths, totals, counts, repeats, digests = (next(x for x in rows.column(n).to_pylist() if x is not None) for n in ABOUT)
        lengths, totals, counts = np.array(lengths, np.int64), np.array(totals), np.array(counts, np.int64)
        of_words = np.zeros(len(lengths))
        for data in rows.column("sums").to_pylist():
            if data:
                word_pairs.add_partial(of_words, data)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            perplexity, word_perplexity = np.exp(-totals / lengths), np.exp(-of_words / (counts + 1))
        return pa.table(
            [
                pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(lengths), pa.array(perplexity, mask=lengths == 0),
                pa.array(counts), pa.array(word_perplexity, mask=(counts == 0) | unknown), pa.array(repeats, pa.float64()),
                pa.array(digests, pa.string()),
            ],
            names=[x.split()[0] for x in SCORES.split(", ")],
        )

    scratch, rows = scratch_dir(spark, "perplexities"), docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    # By length as well, as ids may be missing or repeat.
    place = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(SLICES))
    for i in range(SLICES):
        sent = rows.where(place == i).mapInArrow(vectors, VECTORS)
        partial = sent.groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(score, PARTIAL)
        partial.groupBy("part", "seq").applyInArrow(add, SCORES).write.parquet(f"{scratch}/{i}")
        del sent, partial
        # What the documents sent to the shards is the largest shuffle, and nothing needs it any more.
        discard(spark)
    logp.destroy()
    return spark.read.schema(SCORES).parquet(*[f"{scratch}/{i}" for i in range(SLICES)])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of documents that some label calls good and none calls bad or toxic."""
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return marks.where("doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def _scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column, DataFrame]:
    """The trusted documents' ids, which of them are held out, and all documents' :func:`perplexities`."""
    spark = docs.sparkSession
    scratch = scratch_dir(spark, "quality")
    trusted = written(trusted_ids(labels), f"{scratch}/trusted")
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(HELD_OUT)), F.lit(HELD_OUT)) == 0
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = exactly_among(texts, trusted.where(~held_out), scratch)
    model, words = train(spark, texts), word_pairs.train(spark, texts, docs.rdd.getNumPartitions())
    discard(spark, f"{scratch}/members", f"{scratch}/wrong-ids")
    return trusted, held_out, perplexities(docs, model, words)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK,
             allowance: float = ALLOWANCE) -> DataFrame:
    """``(doc_id, lang, n_symbols, perplexity, threshold, n_words, word_perplexity, word_threshold, repeated,
    repeated_threshold, kept, text_md5)``, one row for each row of ``docs(doc_id, text, lang)``.

    The perplexity by words and the share of repeated pairs have thresholds of their own, found in the same way; a document
    must pass all three. The models are trained on four fifths of the trusted documents, chosen by hash; the others set the thresholds. A
    document stays if its perplexity is at most its ``threshold``: ``slack`` times the ``quantile`` of these documents
    of its language, times ``1 + 1 / sqrt(documents)``, as a quantile of few is uncertain, and times
    ``exp(allowance / sqrt(n_symbols))``, as the mean over a short text varies more. Null is a language of its own; one
    without such documents takes the quantile of all of them, and without any the threshold is null and every text stays. Null and empty texts have no perplexity
    and do not stay: there is nothing in them to train on. Rows that share an id are judged each by itself. Other columns
    are ignored; an empty input gives no rows.
    """
    spark = docs.sparkSession
    with batches_of(spark, BATCH_BYTES), shuffles_dropped(spark):
        trusted, held_out, scores = _scored(docs, labels)
    known = scores.join(trusted.where(held_out), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    # A quantile of few documents is uncertain.
    wider = slack * (1 + 1 / F.sqrt(F.greatest(F.count(F.lit(1)), F.lit(1))))
    levels = [(F.percentile_approx(m, quantile, 10_000) * wider).alias(f"own_{m}") for m in MEASURES]
    by_language = known.groupBy(F.col("lang").alias("of_lang")).agg(*levels)
    overall = known.agg(*levels).first()
    level = {m: F.coalesce(f"own_{m}", F.lit(overall[f"own_{m}"]).cast("double")) for m in MEASURES}
    symbols, n_words = (F.sqrt(F.greatest(F.col(c), F.lit(1))) for c in ("n_symbols", "n_words"))
    thresholds = {
        "perplexity": level["perplexity"] * F.exp(allowance / symbols),
        "word_perplexity": level["word_perplexity"] * F.exp(allowance / n_words),
        "repeated": level["repeated"] + REPEATS / n_words,
    }
    fits = [F.coalesce(F.col(m) <= t, F.lit(True)) for m, t in thresholds.items()]
    return scores.join(by_language, scores["lang"].eqNullSafe(F.col("of_lang")), "left").select(
        "doc_id", "lang", "n_symbols", "perplexity", thresholds["perplexity"].alias("threshold"),
        "n_words", "word_perplexity", thresholds["word_perplexity"].alias("word_threshold"),
        "repeated", thresholds["repeated"].alias("repeated_threshold"),
        functools.reduce(Column.__and__, fits, F.col("perplexity").isNotNull()).alias("kept"), "text_md5",
    )
