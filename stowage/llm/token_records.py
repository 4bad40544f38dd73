"""Token ids as length-delimited binary records, with a separate offset index.

A record is framed like this, all numbers little-endian::

    length of the data   8 bytes
    masked CRC-32 of it  4 bytes
    data                 id present (1), document id (8), bytes for an id (1), number of ids (8), the ids
    masked CRC-32 of it  4 bytes

Every task writes one file of a contiguous range of document ids and commits it by renaming, so a task that runs twice
leaves one file. The index has a row for each record with file, offset and length, for reads in any order.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.batches import column, slices

END_ID = 0
#: Bytes of remembered words, about; the memory is emptied beyond.
CACHE_BYTES = 200_000_000
JOINED = 2000
MARKS = ".,;:!?"
# Fixed value: how a byte-level vocabulary writes a blank.
BLANK = "\u0120"
# Fixed value: the constant by which the checksums of such record files are masked.
MASK_DELTA = 0xA282EAD8
LENGTH = struct.Struct("<QI")
CHECK = struct.Struct("<I")
HEAD = struct.Struct("<BqBQ")
INDEX = "part int, file string, offset bigint, length bigint, doc_id bigint, n_tokens bigint"


def masked_crc(data: bytes) -> int:
    """CRC-32, rotated and shifted, so that a checksum stored within checked data does no harm."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    data = HEAD.pack(doc_id is not None, doc_id or 0, ids.dtype.itemsize, len(ids)) + ids.tobytes()
    size = struct.pack("<Q", len(data))
    return b"".join((size, CHECK.pack(masked_crc(size)), data, CHECK.pack(masked_crc(data))))


class DamagedRecord(ValueError):
    """A record is cut short or its bytes do not fit their checksum."""


def read_frame(stream) -> tuple[int | None, np.ndarray] | None:
    """The next record of an open file, or None at its end."""
    head = stream.read(LENGTH.size)
    if not head:
        return None
    if len(head) < LENGTH.size:
        raise DamagedRecord("file ends within a record's length")
    size, check = LENGTH.unpack(head)
    if masked_crc(head[:8]) != check:
        raise DamagedRecord("length does not fit its checksum")
    data, check = stream.read(size), stream.read(CHECK.size)
    if len(data) < size or len(check) < CHECK.size:
        raise DamagedRecord("file ends within a record")
    if masked_crc(data) != CHECK.unpack(check)[0]:
        raise DamagedRecord("data does not fit its checksum")
    known, doc_id, width, count = HEAD.unpack_from(data)
    return doc_id if known else None, np.frombuffer(data, np.dtype(f"<u{width}"), count, HEAD.size)


@dataclass
class WordCache:
    """A tokenizer that remembers the ids of words.

    A byte-level tokenizer never merges over the start of a word, so a text's ids are its words' ids one after another
    as long as white space is single blanks and line breaks. Any other text, and one that holds a special token, is
    encoded whole. The words that are not known yet are encoded together, without a mark at their end, and the cache is
    emptied when it is full. New words that begin with a blank are encoded many in one text and told apart by the blank with
    which their first token begins.
    """

    tokenizer: object
    dtype: np.dtype
    by_word: bool
    specials: tuple[str, ...]
    known: dict[str, bytes]
    held: int = 0

    def __post_init__(self) -> None:
        tokens = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.begins = np.fromiter((t.startswith(BLANK) for t in tokens), bool, self.tokenizer.get_vocab_size())
        self.everything = (*self.RUNS, *self.ASCII_SPACE, *self.OTHER_SPACE, *self.specials)
        self.marks = {m: np.array(ids, self.dtype).tobytes() for m, ids in zip(MARKS, self._ids(list(MARKS)), strict=True)}

    #: Runs of white space and characters that the tokenizer may take for white space; plain searches are far
    #: faster than one regular expression.
    RUNS = ("  ", "\n\n", " \n", "\n ")
    ASCII_SPACE = tuple(map(chr, (0, 9, 11, 12, 13, *range(0x1C, 0x20))))
    OTHER_SPACE = tuple(map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))

    @classmethod
    def load(cls, path: str) -> WordCache:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        parts = json.loads(tokenizer.to_str())
        before = parts.get("pre_tokenizer") or {}
        by_word = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and not parts.get("normalizer") and not parts.get("truncation") and not parts.get("padding")
        )
        dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        return cls(tokenizer, dtype, by_word, tuple(t["content"] for t in parts.get("added_tokens", [])), {})

    def words(self, text: str) -> list[str] | None:
        """The text cut before each blank or line break; a blank is left out, a first word is marked. None: unusual."""
        unusual = (*self.RUNS, *self.ASCII_SPACE, *self.specials) if text.isascii() else self.everything
        if not self.by_word or any(s in text for s in unusual):
            return None
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\0" + words[0]
        return words

    @staticmethod
    def spelled(word: str) -> str:
        return word[1:] if word[:1] == "\0" else word if word[:1] == "\n" else " " + word

    @staticmethod
    def _stem(word: str) -> str:
        """The word without a mark at its end; marks are tokens of their own after a letter."""
        return word[:-1] if word[-1:] and word[-1] in MARKS and word[-2:-1].isalpha() else word

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        cut, get = [self.words(t) for t in texts], self.known.get
        parts = [None if words is None else list(map(get, words)) for words in cut]
        holes = [[] if found is None else [i for i, ids in enumerate(found) if ids is None] for found in parts]
        fresh = {words[i] for words, places in zip(cut, holes, strict=True) for i in places}
        stems = {word: self._stem(word) for word in fresh}
        added = self._by_word(list(set(stems.values()).difference(self.known)))
        self.known.update(added)
        for word, stem in stems.items():
            if word not in self.known:
                added[word] = self.known[word] = self.known[stem] + self.marks[word[-1]]
        self.held += sum(map(len, added)) + sum(map(len, added.values())) + 200 * len(added)
        whole = iter(self._ids([t for t, w in zip(texts, cut, strict=True) if w is None]))
        out = []
        for words, found, places in zip(cut, parts, holes, strict=True):
            if found is None:
                out.append(np.array(next(whole), self.dtype))
                continue
            for i in places:
                found[i] = self.known[words[i]]
            out.append(np.frombuffer(b"".join(found), self.dtype))
        return out

    def _by_word(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word."""
        found: dict[str, bytes] = {}
        plain = [w for w in words if w and w[0] not in "\n\0"]
        others = [w for w in words if not w or w[0] in "\n\0"]
        runs = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for run in runs:
            ids = np.array(self._ids([" " + " ".join(run)])[0], np.int64)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(run) or starts[0]:
                others += run
                continue
            data, edges = ids.astype(self.dtype).tobytes(), (starts * self.dtype.itemsize).tolist()
            found.update(zip(run, (data[a:b] for a, b in zip(edges, [*edges[1:], len(data)], strict=True)), strict=True))
        for start in range(0, len(others), JOINED):
            some = others[start : start + JOINED]
            found.update(zip(some, (np.array(i, self.dtype).tobytes() for i in self._ids([self.spelled(w) for w in some])), strict=True))
        return found

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


_CACHES: dict[str, WordCache] = {}


def cached_tokenizer(path: str) -> WordCache:
    """This worker's tokenizer for the file ``path``, which must be on every machine."""
    if path not in _CACHES:
        _CACHES[path] = WordCache.load(path)
    return _CACHES[path]


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode ``docs(doc_id, text)`` in ascending id order into record files and an index below the new folder ``path``.

    ``path`` must be a folder that every executor can reach through Arrow's file systems (a shared mount, S3, GCS, HDFS).
    Every sequence ends with ``end_id``. A null text is empty. A null id comes first; rows with equal ids are ordered by
    text. Other columns are ignored. An empty input gives an index without rows and no files.
    """
    root = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cache = TaskContext.get().partitionId(), cached_tokenizer(tokenizer_path)
        system, folder = pafs.FileSystem.from_uri(root)
        name = f"part-{part:06d}.rec"
        unfinished, offset, stream = f"{folder}/data/.{name}-{uuid.uuid4().hex}", 0, None
        end = np.array([end_id], cache.dtype)
        for batch in slices(batches, "text"):
            if stream is None:
                system.create_dir(f"{folder}/data", recursive=True)
                stream = system.open_output_stream(unfinished)
            rows = []
            for doc_id, ids in zip(column(batch, "doc_id"), cache.encode(column(batch, "text")), strict=True):
                data = frame(doc_id, np.concatenate((ids, end)))
                stream.write(data)
                rows.append((part, f"data/{name}", offset, len(data), doc_id, len(ids) + 1))
                offset += len(data)
            yield _batch(rows, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), INDEX)
        if stream is not None:
            stream.close()
            system.move(unfinished, f"{folder}/data/{name}")

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, INDEX).write.parquet(f"{root}/index")


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/index")


def read_records(index: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` for rows of the index, read in the order and partitions in which they come.

    Sort or sample the index first for a shuffled read. Neighbouring rows of one file share an open file.
    """
    root = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pafs.FileSystem.from_uri(root)
        opened, stream = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece, rows = batch.slice(start, 256), []
                for file, offset, doc_id in zip(*(column(piece, n) for n in ("file", "offset", "doc_id")), strict=True):
                    if file != opened:
                        opened, stream = file, system.open_input_file(f"{folder}/{file}")
                    stream.seek(offset)
                    found = read_frame(stream)
                    if found is None or found[0] != doc_id:
                        raise DamagedRecord(f"no record of document {doc_id} at {offset} of {file}")
                    rows.append((found[0], found[1].tolist()))
                yield _batch(rows, (pa.int64(), pa.list_(pa.int64())), "doc_id bigint, ids array<bigint>")

    return index.mapInArrow(run, "doc_id bigint, ids array<bigint>")


SUMMARY = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def summarize(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every record, read from the files from front to end.

    ``start`` counts the ids of all records before it in the order of the files. A file is one task's stream; what
    comes before a file is summed over one row for each file.
    """
    root = path.rstrip("/")
    index = read_index(spark, root)
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("records"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        system, folder = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for part, file, expected in zip(*(column(batch, n) for n in ("part", "file", "records")), strict=True):
                start, rows, count = 0, [], 0
                with system.open_input_stream(f"{folder}/{file}", buffer_size=1 << 20) as stream:
                    while (found := read_frame(stream)) is not None:
                        doc_id, ids = found
                        rows.append((part, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start, count = start + len(ids), count + 1
                        if len(rows) == 4096:
                            yield _batch(rows, kinds, SUMMARY)
                            rows = []
                if count != expected:
                    raise DamagedRecord(f"{file} has {count} records, not {expected}")
                yield _batch(rows, kinds, SUMMARY)

    tasks = max(1, index.rdd.getNumPartitions())
    read = files.repartition(tasks, "part").mapInArrow(run, SUMMARY)
    return read.join(starts, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
