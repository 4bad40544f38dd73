import itertools
import math
import random
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stowage.llm import quality, words
from stowage.session import batches_of, shuffles_dropped


def naive_model(texts):
    """Interpolated modified Kneser-Ney over classes, straight from its definition."""
    order, bits = quality.ORDER, quality.CLASS_BITS
    counts = {order: Counter(g for t in texts for g in quality.grams(t).tolist())}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g & ((1 << bits * k) - 1) for g in counts[k + 1])
    cut = {k: quality.discounts(*[sum(1 for n in c.values() if n == i) for i in range(1, 5)]) for k, c in counts.items()}
    context = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            context[k][g >> bits].append(n)

    def p(k, gram):
        if k == 0:
            return 1 / quality.CLASSES
        lower = p(k - 1, gram & ((1 << bits * (k - 1)) - 1))
        seen = context[k].get(gram >> bits)
        if not seen:
            return lower
        d = lambda n: cut[k][min(n, 3) - 1] if n else 0.0
        n = counts[k].get(gram, 0)
        return (n - d(n)) / sum(seen) + sum(map(d, seen)) / sum(seen) * lower

    return lambda gram: p(order, gram)


WORDS = ["the", "of", "été", "straße", "Wort", "3.5", "and,", "ok!"]


def texts(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_model_and_perplexity_equal_the_definition(spark):
    rng = random.Random(1)
    trained = texts(rng, 40)
    model = quality.train(spark, spark.createDataFrame([(t,) for t in trained] + [(None,)], "text string"))
    logp = {r.gram: r.logp for r in model.collect()}
    naive = naive_model(trained)
    some = [*quality.grams(trained[0]).tolist(), *(rng.randrange(quality.GRAMS) for _ in range(300))]
    assert len(logp) == quality.GRAMS and all(logp[g] == pytest.approx(math.log(naive(g))) for g in some)
    for _ in range(5):
        base = rng.randrange(quality.GRAMS) & ~(quality.CLASSES - 1)
        assert sum(math.exp(logp[base + i]) for i in range(quality.CLASSES)) == pytest.approx(1)

    docs = [(i, "en", t) for i, t in enumerate([*texts(rng, 30), "", None, "a" * 3000, "%%% @@" * 200])] + [(0, "en", "again"), (None, None, "no id")]
    scored = quality.perplexities(spark.createDataFrame(docs, "doc_id bigint, lang string, text string").selectExpr("*", "1 AS shard", "2 AS seq"), model).collect()
    expected = []
    for doc_id, lang, text in docs:
        codes = quality.grams(text or "").tolist()
        expected.append((doc_id, lang, len(codes), math.exp(-sum(logp[g] for g in codes) / len(codes)) if codes else None))
    key = lambda r: (str(r[0]), r[2])
    for a, b in zip(sorted(map(tuple, scored), key=key), sorted(expected, key=key), strict=True):
        assert a[:3] == b[:3] and (a[3] == pytest.approx(b[3]) if b[3] is not None else a[3] is None)


def test_word_model_equals_the_definition_and_grows(spark):
    rng = random.Random(2)
    trained = texts(rng, 40)
    table = lambda ts: words.train(spark, spark.createDataFrame([(t,) for t in ts] + [(None,), (" ",)], "text string"))
    pairs, unseen = table(trained)
    count = Counter(p for t in trained for p in itertools.pairwise(["<", *t.split(), ">"]))
    after = Counter(b for _, b in count)
    cut = [quality.discounts(*[sum(1 for n in c.values() if n == i) for i in range(1, 5)]) for c in (after, count)]
    d = lambda n, by: by[min(n, 3) - 1] if n else 0.0

    def p(a, b):
        total = sum(after.values())
        low = (after[b] - d(after[b], cut[0])) / total + sum(d(n, cut[0]) for n in after.values()) / total / (len(after) + 1)
        of = [n for (x, _), n in count.items() if x == a]
        return (count[a, b] - d(count[a, b], cut[1])) / sum(of) + sum(d(n, cut[1]) for n in of) / sum(of) * low if of else low

    docs = [(i, "en", t) for i, t in enumerate([*texts(rng, 20), "", " ", None, "the unseen word of", "the " * 50])]
    model = quality.train(spark, spark.createDataFrame([("the",)], "text string"))
    scored = quality.perplexities(spark.createDataFrame(docs, "doc_id bigint, lang string, text string").repartition(3), model, (pairs, unseen)).collect()
    assert len(scored) == len(docs)
    for r in scored:
        split = (docs[r.doc_id][2] or "").split()
        logs = [math.log(p(a, b)) for a, b in itertools.pairwise(["<", *split, ">"])]
        assert r.n_words == len(split) and r.word_perplexity == (pytest.approx(math.exp(-sum(logs) / len(logs))) if split else None)
    assert next(r.repeated for r in scored if r.doc_id == len(docs) - 1) == pytest.approx(48 / 51)
    more = [f"{t} w{i} v{i}" for i, t in enumerate(trained * 3)]
    assert table(more)[0].count() > pairs.count() + 3 * 3 * len(trained)


def test_repeated_words_do_not_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    some = [(-1, "De " * 400, "de"), (-2, "asga " * 60, "es"), (-3, "the and " * 200, "en")]
    verdict = quality.classify(docs.select("doc_id", "text", "lang").union(spark.createDataFrame(some, "doc_id bigint, text string, lang string")), labels)
    assert [r.kept for r in verdict.where("doc_id < 0").collect()] == [False] * 3


def test_discounts_without_counts():
    assert quality.discounts(0, 0, 0, 0) == (0.5, 0.5, 0.5)
    assert all(0 < d <= i for i, d in enumerate(quality.discounts(100, 40, 20, 10), 1))


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trained = labels.where("doc_id % 2 = 0")
    verdict = quality.classify(docs, trained)
    marks = labels.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = verdict.join(marks, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert verdict.count() == docs.count()
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_languages_labels_and_empty(spark):
    schema, marks = "doc_id bigint, text string, lang string", "doc_id bigint, quality int, toxic int"
    rows = [(i, "the of and ok the of", "en") for i in range(20)] + [(50, "the of and", None), (51, "the of", "xx"), (52, "", "en"), (53, None, "en"), (54, "%#@%$#^%" * 300, "xx")]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS own", "2 AS kept")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(1, 0, 0), (2, 1, 1), (None, 1, 0), (3, 1, None)], marks)
    assert {r.doc_id for r in quality.trusted_ids(labels).collect()} == {0, *range(3, 20)}
    kept = {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    assert len(kept) == len(rows) and all(kept[i] for i in [*range(20), 50, 51]) and not any(kept[i] for i in (52, 53, 54))
    without = quality.classify(docs, labels.limit(0)).collect()
    assert all(r.kept == bool(r.n_symbols) and r.threshold is None for r in without)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_only_shards_that_have_something_get_a_row():
    sent, counts, _ = words.vectors(["one two", "", "two"], 1000)
    assert 0 < len(sent) <= 3 + 4 + 2 and counts.tolist() == [2, 0, 1]
    assert len(words.partial(words.unpacked(words.packed(*[words.np.zeros(0, t) for t in ("u8", "f8")])), next(iter(sent.values())), -1.0)) < 60


def test_words_are_those_of_split():
    some = ["", " ", " a  b\n", "\u3000x\u00a0y\x1cz\u200b", "été\t\u2028ok"]
    found, counts = words.split_words(some)
    assert found.to_pylist() == [w for t in some for w in t.split()] and counts.tolist() == [len(t.split()) for t in some]


def test_counts_of_pairs_come_back():
    _, keys, _ = words.sequences(["a b a b", "b a", "c"])
    first, second, n = keys[:-1], keys[1:], words.np.arange(1, len(keys))
    key, one, two, total = words._added([(words.pair_keys(first, second), first, second, n)])
    known, i, j, m = words.counts_unpacked(words.counts_packed(one, two, total))
    expected = Counter()
    for a, b, k in zip(first.tolist(), second.tolist(), n.tolist(), strict=True):
        expected[a, b] += k
    assert dict(zip(zip(known[i].tolist(), known[j].tolist(), strict=True), m.tolist(), strict=True)) == expected


def traced(run):
    """What ``run`` gives, and the bytes it held at its peak."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_gathering_pairs_takes_few_bytes_a_pair():
    rng = np.random.default_rng(3)
    some = [" ".join(map(str, rng.integers(0, 1 << 30, 2000))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(some)], ["text"])
    out, peak = traced(lambda: list(words.gathered(iter([batch]), 16)))
    assert peak < 110 * 600_000
    found = Counter()
    for data in (d for b in out for d in b.column("pairs").to_pylist()):
        known, one, two, n = words.counts_unpacked(data)
        found.update(dict(zip(words.pair_keys(known[one], known[two]).tolist(), n.tolist(), strict=True)))
    assert found == Counter(words.pairs(*words.sequences(some)[:2])[3].tolist())


def test_characters_are_scored_a_few_at_a_time():
    logp, some = np.random.default_rng(3).random(quality.GRAMS), ["", *["Ab c." * 400] * 900, "", "x" * (2 * quality.RUN_CHARS), ""]
    quality._classes()
    (totals, lengths), peak = traced(lambda: quality.log_likelihoods(some, logp))
    assert lengths.tolist() == list(map(len, some)) and peak < 8 * lengths.sum()
    assert totals.tolist() == [pytest.approx(logp[quality.grams(t)].sum()) for t in some]
    assert [len(x) for x in quality.log_likelihoods([], logp)] == [0, 0]


def test_python_gets_texts_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"), F.lit("en").alias("lang"))
    with batches_of(spark, 1 << 16):
        with batches_of(spark, 1 << 20):
            pass
        got = [r.size for r in docs.mapInArrow(sizes, "size bigint").collect()]
    assert sum(got) > 400 * 5000 and max(got) < 1 << 17
    with pytest.raises(ValueError, match="x"), batches_of(spark, 1 << 16):
        raise ValueError("x")
    assert spark.conf.get(key) == before
    perplexities, keys = quality.perplexities, [key, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    monkeypatch.setattr(quality, "perplexities", lambda *a: seen.extend(map(spark.conf.get, keys)) or perplexities(*a))
    labels = spark.range(2).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.classify(docs.limit(2), labels).count() == 2
    assert seen == [f"{quality.BATCH_BYTES}b", "true"] and [spark.conf.get(k) for k in keys] == [before, "false"]


def test_shuffle_files_go_with_their_job(spark, tmp_path):
    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(f.getName().startswith("shuffle") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()))

    counted = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count()
    before = files()
    with shuffles_dropped(spark):
        counted.write.parquet(str(tmp_path / "counted"))
        assert counted.where("k < 5").count() == 5
        deadline = time.monotonic() + 20
        while files() > before and time.monotonic() < deadline:
            time.sleep(0.1)
    assert files() <= before
