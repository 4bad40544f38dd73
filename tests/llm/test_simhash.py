import hashlib
import random

from stowage.llm import simhash

SCHEMA = "doc_id bigint, text string"


def naive(text):
    """The same votes, bit by bit."""
    import xxhash

    words = text.split()
    if not words:
        return 0
    mask = 2**64 - 1
    hashes = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
    pairs = hashes if len(words) == 1 else [(a * 3 + (b ^ 0x9E3779B97F4A7C15)) & mask for a, b in zip(hashes, hashes[1:])]
    votes = [0] * 64
    for x in pairs:
        for _ in range(2):
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & mask
        x ^= x >> 32
        for bit in range(64):
            votes[bit] += 1 if x >> (63 - bit) & 1 else -1
    return sum(1 << (63 - bit) for bit in range(64) if votes[bit] > 0)


def test_fingerprint_is_the_weighted_vote():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 400, 40_000):
        text = " ".join(rng.choice(("the", "of", "é", *map(str, range(n)))) for _ in range(n))
        assert simhash.fingerprint(text) == naive(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        prints = [f"{simhash.fingerprint(t):016x}" for t in (text, changed, following)]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), *prints))
    return sorted(out, key=repr)


def test_edited_texts(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**6), " ".join(rng.choice("abcé日🎉") for _ in range(rng.randrange(60)))) for _ in range(200)]
    rows += [(5, None), (5, "tie"), (None, "no id"), (7, ""), (10**7, "long é" * 100_000), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "'x' AS kind").repartition(5)
    found = simhash.edited_fingerprints(docs).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")) for r in found), key=repr) == brute(rows)


def test_one_row_and_none(spark):
    found = simhash.edited_fingerprints(spark.createDataFrame([(1, "abcd")], SCHEMA)).collect()
    assert [tuple(r) for r in found] == [tuple(found[0])] and found[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert simhash.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    for radius, blocks in ((3, 5), (0, 2), (5, 8)):
        every = spark.createDataFrame([(f"{p:016x}",) for p in prints] * 2 + [(None,)], "fingerprint string")
        asked = spark.createDataFrame([(f"{p:016x}",) for p in prints[::3]], "fingerprint string")
        found = simhash.search(asked, every, radius, blocks).collect()
        expected = {(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a in prints[::3] for b in prints if (a ^ b).bit_count() <= radius}
        assert len(found) == len(expected) and set(map(tuple, found)) == expected


def test_fingerprints_and_likeness(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], SCHEMA)
    found = {r.doc_id: r.fingerprint for r in simhash.fingerprints(docs).collect()}
    assert found[1] == found[2] == f"{simhash.fingerprint('a b c'):016x}" and found[3] == "0" * 16
    pair = spark.createDataFrame([("f" * 16, "f" * 15 + "0")], "a string, b string")
    assert pair.select(simhash.likeness(pair.a, pair.b)).first()[0] == 60 / 64
