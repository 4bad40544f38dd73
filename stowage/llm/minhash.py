"""Near duplicates by bottom-k sketches, with every link confirmed on full sets.

One hash function turns a document's word shingles into numbers; its *sketch* is the ``k`` smallest. Documents with equal
sets are one class and go on as one row.

Which classes to compare comes from inverted lists of the retained values. Two sets with a Jaccard similarity of 0.75 share
at least ``shared`` of the ``k`` smallest values of their union, but for a chance below one in 100,000, so they
meet on one of the ``k - shared + 1`` rarest values of each sketch and longer lists need not be kept: a passage that many
documents have in common brings together only documents which it nearly fills. A set with no more values than
``k`` is its own sketch, and its numbers hold without any chance.

Within a list every class is first compared with the list's *hub*, the class whose values are the most common: for a
group of many edited copies that is close to the text they were made from. Lists whose classes are then in one component
are done, so a large group costs its size and not its square. The classes on the others are put on lists once more,
now by the rarest members of their full sets, with their places: from the places at which two sets first meet follows
how much they can share, and nearly all pairs of edited copies that are no link are never formed.
The union of two sketches estimates their similarity and drops most candidates; the rest is
confirmed on full sets, read from the texts again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.batches import BATCH_BYTES, column, slices
from stowage.llm.components import components
from stowage.llm.members import Filter
from stowage.session import batches_of, scratch_dir, written

WORDS, PERCENT, SKETCH = 5, 75, 64
DEVIATIONS = 4.5
#: Bytes of remembered words, about; longer words are not remembered.
CACHE_BYTES, CACHED_WORD = 24_000_000, 40
HUB_ROWS = 4096
# Lower-cases A-Z; bytes.split() then cuts at exactly the characters [\x20\x09-\x0D].
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))



def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


class WordHashes:
    """64-bit hashes of words, the usual ones remembered within bounds."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0

    def of(self, found: list[bytes]) -> np.ndarray:
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        fresh = set(found).difference(self.known)
        for word in fresh:
            self.known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        for word in fresh:
            if len(word) > CACHED_WORD:
                del self.known[word]
            else:
                self.held += len(word) + 130
        return hashes


def shingle_set(text: str | None, width: int = WORDS, hashes_of: WordHashes | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of a shorter sequence of words, the one hash of the whole."""
    found = words(text or "")
    if not found:
        return np.zeros(0, np.uint64)
    hashes = (hashes_of or WordHashes()).of(found)
    size = min(width, len(hashes))
    with np.errstate(over="ignore"):
        total = np.full(len(hashes) - size + 1, size, np.uint64)
        for i in range(size):
            total = (total ^ hashes[i : len(hashes) - size + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
            total ^= total >> np.uint64(29)
        total *= np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
    return np.unique(total)


def least_shared(k: int, percent: int = PERCENT) -> int:
    """How many of ``k`` values of a union two sets of the given similarity share, but for ``DEVIATIONS`` deviations."""
    p = percent / 100
    return max(1, math.floor(k * p - DEVIATIONS * math.sqrt(k * p * (1 - p))))


SKETCHES = "doc_id bigint, n_shingles bigint, set_digest string, sketch array<bigint>"


def sketches(docs: DataFrame, k: int = SKETCH, width: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, set_digest, sketch)``: the set's size, a 128-bit digest of all of it, its ``k`` smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, width, known) for t in column(batch, "text")]
            least = [s[:k].view(np.int64) for s in sets]
            offsets = np.cumsum([0, *map(len, least)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(least))),
                ],
                ["doc_id", "n_shingles", "set_digest", "sketch"],
            )

    return _texts(docs).mapInArrow(run, SKETCHES)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))


def full_sets(docs: DataFrame, wanted: DataFrame, path: str, width: int = WORDS) -> DataFrame:
    """``(doc_id, set_digest, members)`` for the rows of ``wanted(doc_id, set_digest)``: whole sets, eight bytes a shingle.

    Other documents are left out by a filter before their sets are made. An id that several rows have stands for the
    one set that has the digest. Written to ``path``.
    """
    likely = Filter.of(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices((likely.passing(b, b.column(0)) for b in batches), "text"):
            sets = [shingle_set(t, width, known).tobytes() for t in column(batch, "text")]
            digests = pa.array(map(xxhash.xxh3_128_hexdigest, sets), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, pa.array(sets, pa.binary())], ["doc_id", "set_digest", "members"])

    sets = _texts(docs).mapInArrow(run, "doc_id bigint, set_digest string, members binary")
    found = written(sets.join(wanted, ["doc_id", "set_digest"], "left_semi").dropDuplicates(["doc_id"]), path)
    likely.close()
    return found


def retained_lists(classes: DataFrame, k: int, shared: int, scratch: str) -> DataFrame:
    """``(value, doc_id, n_shingles, weight)``: each class on the inverted lists of its rarest values.

    ``classes(doc_id, n_shingles, sketch)``. Values that one class alone has take up places among the rarest, and have no
    list. ``weight`` says how common all of the class's values are.
    """
    entries = classes.select(F.explode("sketch").alias("value"), "doc_id", "n_shingles")
    common = entries.groupBy("value").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    common = written(common, f"{scratch}/common-values")
    met = entries.join(common, "value")
    by_class = met.groupBy("doc_id", "n_shingles").agg(
        F.sort_array(F.collect_list(F.struct("classes", "value"))).alias("met"), F.sum(F.log2("classes")).alias("weight")
    )
    # At most k values a class. Those it has alone come first, being the rarest.
    size = F.least(F.col("n_shingles"), F.lit(k)).cast("int")
    places = F.greatest(F.lit(0), size - _needed(F.col("n_shingles"), k, shared) + 1 - (size - F.size("met")))
    lists = by_class.select("doc_id", "n_shingles", "weight", F.explode(F.slice("met", F.lit(1), places)).alias("m"))
    return written(lists.select("m.value", "doc_id", "n_shingles", "weight"), f"{scratch}/lists")


def _needed(size: Column, k: int, shared: int) -> Column:
    """How many retained values a class of this size shares at least with any class it is linked with.

    Sets of up to ``k`` are their own sketches: both intersection and partner are at least ``PERCENT`` of the size, but
    a partner may be larger than ``k`` and show fewer of the values in its sketch, which the second bound covers.
    """
    exact = F.floor((size * PERCENT + 99) / 100).cast("int")
    return F.when(size * 100 <= k * PERCENT, exact).otherwise(F.least(F.lit(shared), exact))


def _similar_sizes(left: Column, right: Column) -> Column:
    return (left * 100 >= right * PERCENT) & (right * 100 >= left * PERCENT)


def candidate_pairs(pairs: DataFrame, classes: DataFrame, k: int, shared: int) -> DataFrame:
    """Of ``pairs(a, b)``, those whose union sketch leaves a link possible."""
    left = classes.select(F.col("doc_id").alias("a"), F.col("sketch").alias("a_sketch"))
    right = classes.select(F.col("doc_id").alias("b"), F.col("sketch").alias("b_sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                for x, y in zip(column(piece, "a_sketch"), column(piece, "b_sketch"), strict=True):
                    x, y = np.array(x, np.int64).view(np.uint64), np.array(y, np.int64).view(np.uint64)
                    union = np.union1d(x, y)[:k]
                    both = np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)
                    needed = shared if len(union) == k else math.ceil(len(union) * PERCENT / 100)
                    keep.append(len(both) >= needed)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_sketch", "b_sketch")
    return joined.mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: str, width: int = WORDS) -> DataFrame:
    """``(a, b)`` of ``pairs(a, b)`` with ``100 * intersection >= PERCENT * union`` on full sets.

    The partners of an ``a`` stream past its set, which is sent once for every few thousand of them.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    wanted = written(classes.select("doc_id", "set_digest").join(ids, "doc_id", "left_semi"), f"{scratch}/wanted")
    sets = full_sets(docs, wanted, f"{scratch}/sets", width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hub = None, np.zeros(0, np.uint64)
        for batch in slices(batches, "members"):
            left, right = [], []
            for a, b, members in zip(*(column(batch, n) for n in ("a", "b", "members")), strict=True):
                x = np.frombuffer(members, np.uint64)
                if b is None:
                    own, hub = a, x
                    continue
                if a != own:
                    raise RuntimeError(f"the set of {a} did not come before its partners")
                both = len(np.intersect1d(x, hub, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(hub) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("parts"))
    hubs = written(hubs, f"{scratch}/hubs")
    dealt = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    partners = dealt.join(sets.select(F.col("doc_id").alias("b"), "members"), "b").select("a", "part", "b", "members")
    own = hubs.join(sets.select(F.col("doc_id").alias("a"), "members"), "a")
    own = own.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"), "members")
    met = own.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return met.select("a", "b", "members").mapInArrow(run, "a bigint, b bigint")


def hub_pairs(lists: DataFrame) -> DataFrame:
    """``(a, b)``: every class of a list with the list's hub ``a``."""
    hub = F.max_by(F.struct("doc_id", "n_shingles"), F.struct(F.round("weight", 6), -F.col("doc_id")))
    hubs = lists.groupBy("value").agg(hub.alias("hub"))
    met = lists.join(hubs, "value").where((F.col("doc_id") != F.col("hub.doc_id")) & _similar_sizes(F.col("n_shingles"), F.col("hub.n_shingles")))
    return met.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with the component of each class in ``labels(node, component)``; of one without links, itself."""
    joined = postings.join(labels, postings["doc_id"] == labels["node"], "left")
    return joined.select(*postings.columns, F.coalesce("component", "doc_id").alias("label"))


def _on_mixed_lists(labelled: DataFrame) -> DataFrame:
    """Postings on lists whose classes are not all in one component."""
    mixed = labelled.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return labelled.join(mixed.select("value"), "value", "left_semi")


def set_postings(docs: DataFrame, classes: DataFrame, open_ids: DataFrame, scratch: str, width: int) -> DataFrame:
    """``(value, doc_id, n_shingles, position)`` for the classes in ``open_ids(doc_id)``: the rarest members of full sets.

    Members are put in one order for all classes, rarest among these classes first. The overlap that a link needs is at
    least ``PERCENT`` of a set, so two linked sets share a member within the first ``n - needed + 1`` of either.
    """
    wanted = written(classes.select("doc_id", "set_digest").join(open_ids, "doc_id", "left_semi"), f"{scratch}/open")
    sets = full_sets(docs, wanted, f"{scratch}/open-sets", width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "members"):
            members = [np.frombuffer(m, np.int64) for m in column(batch, "members")]
            sizes = np.array([len(m) for m in members], np.int64)
            ids = np.repeat(np.array(column(batch, "doc_id"), np.int64), sizes)
            arrays = [pa.array(np.concatenate(members)), pa.array(ids), pa.array(np.repeat(sizes, sizes))]
            yield pa.RecordBatch.from_arrays(arrays, ["value", "doc_id", "n_shingles"])

    entries = written(sets.mapInArrow(run, "value bigint, doc_id bigint, n_shingles bigint"), f"{scratch}/members")
    common = entries.groupBy("value").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    by_class = entries.join(common, "value").groupBy("doc_id", "n_shingles").agg(
        F.sort_array(F.collect_list(F.struct("classes", "value"))).alias("met")
    )
    alone = (F.col("n_shingles") - F.size("met")).cast("int")
    spare = (F.col("n_shingles") - F.floor((F.col("n_shingles") * PERCENT + 99) / 100)).cast("int")
    first = F.slice("met", F.lit(1), F.greatest(F.lit(0), spare + 1 - alone))
    placed = by_class.select("doc_id", "n_shingles", alone.alias("alone"), F.posexplode(first).alias("place", "m"))
    placed = placed.select("m.value", "doc_id", "n_shingles", (F.col("alone") + F.col("place")).alias("position"))
    return written(placed, f"{scratch}/postings")


def _leaves_room(size: Column, position: Column, partner: Column) -> Column:
    """Whether sets that first meet at this position can still share what a link between such sizes needs."""
    return (size - position) * (100 + PERCENT) >= PERCENT * (size + partner)


def cross_pairs(postings: DataFrame, labels: DataFrame, compared: DataFrame) -> DataFrame:
    """``(a, b)``: classes of different components that meet where a link is still possible, and were not ``compared``.

    Postings too far down for any partner on their list go first, which takes most lists out as a whole.
    """
    least = postings.groupBy("value").agg(F.min("n_shingles").alias("least"))
    some = postings.join(least, "value").where(_leaves_room(F.col("n_shingles"), F.col("position"), F.col("least"))).drop("least")
    left = _on_mixed_lists(_labelled(some, labels))
    right = left.select("value", *[F.col(c).alias(f"other_{c}") for c in ("doc_id", "n_shingles", "position", "label")])
    size, other = F.col("n_shingles"), F.col("other_n_shingles")
    met = left.join(right, "value").where(
        (F.col("label") < F.col("other_label"))
        & _similar_sizes(size, other)
        & _leaves_room(size, F.col("position"), other)
        & _leaves_room(other, F.col("other_position"), size)
    )
    pairs = met.select(F.least("doc_id", "other_doc_id").alias("a"), F.greatest("doc_id", "other_doc_id").alias("b")).distinct()
    known = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, k: int = SKETCH, width: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs(doc_id, text)``.

    Documents are linked if their sets of shingles of ``width`` words have a Jaccard similarity of at least 0.75;
    ``component_id`` is the smallest id reachable over links, and ``kept`` marks the row that has it. Null, empty and
    blank texts have an empty set and are linked with nothing. Rows that share an id are one document: each
    reports its own set's size, and the set with the smallest digest is linked. Rows without id are linked with nothing and
    kept, their component is null. Other columns are ignored, an empty input gives no rows.
    """
    scratch, shared = scratch_dir(docs.sparkSession, "minhash"), least_shared(k)
    with batches_of(docs.sparkSession, BATCH_BYTES):
        rows = written(sketches(docs, k, width), f"{scratch}/sketches")
        by_id = rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min("set_digest").alias("set_digest"))
        by_id = written(by_id, f"{scratch}/documents")
        reps = written(by_id.groupBy("set_digest").agg(F.min("doc_id").alias("doc_id")), f"{scratch}/representatives")
        classes = rows.join(reps, ["doc_id", "set_digest"], "left_semi").dropDuplicates(["doc_id"])
        classes = written(classes, f"{scratch}/classes")

        lists = retained_lists(classes, k, shared, scratch)
        compared = written(hub_pairs(lists), f"{scratch}/hub-pairs")
        likely = written(candidate_pairs(compared, classes, k, shared), f"{scratch}/hub-candidates")
        links = written(confirmed(likely, classes, docs, f"{scratch}/hub"), f"{scratch}/hub-links")
        labels = components(links)
        open_ids = _on_mixed_lists(_labelled(lists.select("value", "doc_id"), labels)).select("doc_id").distinct()
        postings = set_postings(docs, classes, written(open_ids, f"{scratch}/open-ids"), scratch, width)
        rest = written(cross_pairs(postings, labels, compared), f"{scratch}/cross-pairs")
        likely = written(candidate_pairs(rest, classes, k, shared), f"{scratch}/cross-candidates")
        more = written(confirmed(likely, classes, docs, f"{scratch}/cross"), f"{scratch}/cross-links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

        verdict = reps.join(labels, reps["doc_id"] == labels["node"], "left").select(
            "set_digest", F.coalesce("component", "doc_id").alias("component")
        )
        verdict = written(verdict, f"{scratch}/verdict")
        placed = written(by_id.join(verdict, "set_digest").select("doc_id", "component"), f"{scratch}/placed")
    found = rows.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
