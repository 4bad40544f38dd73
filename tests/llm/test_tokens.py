import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm import merge_dropout, token_records
from stowage.llm.queries import BYTE_BPE, PIECE_MODEL

ODD = ["", " ", "a", "  a  b ", "\n\nx \n y", "é▁x ▁", "\0a b", "日本語 テスト ", "x" * 200, "the " * 30, "a\tb\r\n", "<s> </s> <0x0A>", "🎉🎉 ok", "word\n",
       "\nword", "word \n", " lead", "<|endoftext|> a", "a\x1cb", "foo\n bar", "foo\n\n\nbar", "I'm you're", "a b", "x ", "a.\n!b", "▁"]
TEXTS = st.text(st.sampled_from("ab eé\n\t ▁'.9日\0 🎉th"), max_size=60)


@pytest.fixture(scope="module")
def model():
    return merge_dropout.Model(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def real(data, spark):
    return [r.text for r in data(spark, "documents").select("text").collect()]


@pytest.fixture(scope="module")
def data():
    return lambda spark, table: spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")


def test_without_dropout_ids_are_the_librarys(model, library, real):
    tool = merge_dropout.Encoder(model, 0.0)
    texts = [t for t in [*real, *ODD] if "▁" not in t]
    assert [x.tolist() for x in tool.encode(list(range(len(texts))), texts)] == library.encode(texts)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_any_text_comes_back(text):
    model = test_any_text_comes_back.__dict__.setdefault("model", merge_dropout.Model(PIECE_MODEL))
    for rate in (0.0, 0.1, 1.0):
        tool = merge_dropout.Encoder(model, rate, seed=7)
        assert tool.decode(tool.encode([3], [text])[0]) == text


def test_dropout_varies_and_repeats(model, real):
    texts = real[:40]
    one, other = merge_dropout.Encoder(model, 0.2, seed=1), merge_dropout.Encoder(model, 0.2, seed=2)
    keys = list(range(len(texts)))
    first = [x.tolist() for x in one.encode(keys, texts)]
    assert first == [x.tolist() for x in merge_dropout.Encoder(model, 0.2, seed=1).encode(keys, texts)]
    assert first != [x.tolist() for x in other.encode(keys, texts)]
    assert first != [x.tolist() for x in one.encode(keys[1:] + keys[:1], texts)]
    plain = merge_dropout.Encoder(model, 0.0).encode(keys, texts)
    assert sum(map(len, first)) > sum(map(len, plain))
    word = {tuple(one.encode([k], ["antidisestablishment"])[0].tolist()) for k in range(200)}
    assert 1 < len(word) <= 200
    assert all(len(x) == len(t) + 1 for x, t in zip(merge_dropout.Encoder(model, 1.0).encode([0], ["abc"]), ["abc"]))


def test_every_occurrence_has_its_own_draw(model, real):
    words = Counter(" the of antidisestablishment and".split() * 800)
    text = " ".join(words.elements())
    ids = merge_dropout.Encoder(model, 0.1, seed=5).encode([3], [text])[0].tolist()
    pieces, at = [], 0
    for word in words.elements():
        spelled, start = "", at
        while len(spelled) < len(word) + 1:
            spelled += model.bytes_of[ids[at]].decode()
            at += 1
        pieces.append((word, tuple(ids[start:at])))
    seen = Counter(pieces)
    assert len({x for w, x in pieces if w == "antidisestablishment"}) > 50 and len({x for w, x in pieces if w == "the"}) >= 4
    free = Counter(merge_dropout.Encoder(model, 0.1, seed=11)._agenda(" the", d) for d in merge_dropout.mixed(np.arange(1, 4001, dtype=np.uint64)).tolist())
    for ids_of, n in free.most_common(2):
        assert abs(seen["the", tuple(np.frombuffer(ids_of, np.int32).tolist())] / 800 - n / 4000) < 0.06


def test_remembered_segmentations_are_those_of_each_draw(model, real):
    texts = [*real[:60], "the and of with " * 500, " 日本語 é\0x\n" + "ab" * 60 + " \n  x" + "n" * 44]
    for rate in (0.1, 0.3, 1.0):
        tool = merge_dropout.Encoder(model, rate, seed=3)
        for part in (texts[:40], texts[20:], texts):
            keys = list(range(len(part)))
            cut = [tool.units(t) for t in part]
            draws, at = tool._draws(keys, cut), 0
            for ids, units in zip(tool.encode(keys, part), cut, strict=True):
                assert ids.tobytes() == b"".join(tool.segment([tool.spelled(u) for u in units], draws[at : at + len(units)]))
                at += len(units)


def naive(model, unit, draw, rate):
    """One unit by the definition: again and again the best candidate merge of neighbours, each skipped for good by its draw."""
    limit = min(int(rate * 2**64), 2**64 - 1)
    parts = [(i, i + 1, int(model.char_ids[ord(c)])) for i, c in enumerate(unit)]

    def mixed(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) % 2**64
        return x ^ (x >> 32)

    def skipped(left, middle, end):
        place = (left << 42) ^ (middle << 21) ^ end
        return mixed(draw ^ (place * 0x9E3779B97F4A7C15 % 2**64)) < limit

    while True:
        found = []
        for (a, b, x), (_, c, y) in zip(parts, parts[1:]):
            rank, symbol = model.merges.get(x << 20 | y, (None, None))
            if rank is not None and not skipped(a, b, c):
                found.append((rank, a, b, c, symbol))
        if not found:
            break
        _, a, _, c, symbol = min(found)
        parts = [p for p in parts if not a <= p[0] < c] + [(a, c, symbol)]
        parts.sort()
    ids = []
    for a, _, symbol in parts:
        ids += [symbol] if symbol < model.size else [model.byte_id[b] for b in unit[a].encode("utf-8", "surrogatepass")]
    return ids


@pytest.mark.parametrize("rate", [0.1, 0.5])
def test_equals_a_naive_encoder(model, real, rate):
    texts = [*real[:25], "the and of with " * 40, " 日本語 é x\n" + "ab" * 60 + " \n  x" + "n" * 44, *ODD]
    tool = merge_dropout.Encoder(model, rate, seed=9)
    cut = [tool.units(t) for t in texts]
    draws, at = tool._draws(list(range(len(texts))), cut).tolist(), 0
    for _ in range(2):
        at = 0
        for ids, units in zip(tool.encode(list(range(len(texts))), texts), cut, strict=True):
            expected = [i for k, u in enumerate(units) for i in naive(model, tool.spelled(u), draws[at + k], rate)]
            assert ids.tolist() == expected
            at += len(units)


def test_rows_and_agenda_agree(model, real):
    tool = merge_dropout.Encoder(model, 0.15, seed=3)
    units = list({" " + w for t in real[:30] for w in t.split()} | {" 日本語", " é\0x", "\n", "   ", " " + "ab" * 40})
    for draw in range(2):
        assert tool.segment(units, draw) == [tool._agenda(u, draw) for u in units]


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, None), (7, "long words " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    encoded = merge_dropout.encode_documents(docs, PIECE_MODEL)
    found = encoded.collect()
    assert len(found) == len(rows) and all(r.text_sha256 == r.decoded_sha256 and len(r.ids) == r.n_tokens for r in found)
    back = merge_dropout.decode_documents(encoded, PIECE_MODEL).collect()
    assert sorted(map(tuple, back), key=repr) == sorted([(d, t or "") for d, t in rows], key=repr)
    assert merge_dropout.encode_documents(docs.limit(0), PIECE_MODEL).count() == 0


# -- token records ---------------------------------------------------------------------------------


def test_cached_words_are_the_librarys_ids(real):
    cache = token_records.WordCache.load(BYTE_BPE)
    texts = [*real, *ODD]
    want = [e.ids for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in cache.encode(texts)] == want == [x.tolist() for x in cache.encode(texts)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab c\n\t \xa0\x1c'.,9é日s"), max_size=40))
def test_cached_words_on_any_text(text):
    cache = token_records.cached_tokenizer(BYTE_BPE)
    assert cache.encode([text])[0].tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids


def expected(rows):
    from tokenizers import Tokenizer

    tool, start, out = Tokenizer.from_file(BYTE_BPE), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (4, None), (6, "x y " * 5000), (6, "x y " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS part", "2 AS offset").repartition(4)
    path = f"file://{tmp_path}/records"
    token_records.write_records(docs, path, BYTE_BPE)
    found = token_records.summarize(spark, path).collect()
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, found), key=key) == sorted(expected(rows), key=key)
    index = token_records.read_index(spark, path)
    shuffled = token_records.read_records(index.orderBy("length"), path).collect()
    assert sorted((r.doc_id is not None, r.doc_id, len(r.ids)) for r in shuffled if r.doc_id is not None) == sorted(
        (True, d, n) for d, _, n, _ in expected(rows) if d is not None
    )


def test_empty_table(spark, tmp_path):
    path = f"{tmp_path}/records"
    token_records.write_records(spark.createDataFrame([], "doc_id bigint, text string"), path, BYTE_BPE)
    assert token_records.summarize(spark, path).count() == 0


def test_damage_is_found(tmp_path):
    good = token_records.frame(7, np.array([1, 2, 70_000], "<u4"))
    (tmp_path / "x").write_bytes(good)
    with open(tmp_path / "x", "rb") as f:
        doc_id, ids = token_records.read_frame(f)
        assert (doc_id, ids.tolist(), token_records.read_frame(f)) == (7, [1, 2, 70_000], None)
    rng = random.Random(1)
    for _ in range(50):
        bad = bytearray(good)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        for data in (bytes(bad), good[: rng.randrange(1, len(good))]):
            (tmp_path / "x").write_bytes(data)
            with open(tmp_path / "x", "rb") as f, pytest.raises(token_records.DamagedRecord):
                token_records.read_frame(f)


def test_masked_checksum():
    crc = zlib.crc32(b"abc")
    assert token_records.masked_crc(b"abc") == ((crc >> 15 | crc << 17) & 0xFFFFFFFF) + 0xA282EAD8 & 0xFFFFFFFF
    assert struct.unpack("<Q", token_records.frame(None, np.zeros(0, "<u2"))[:8])[0] == 18
