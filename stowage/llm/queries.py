"""The operators as registered queries, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import (
    chat, cross_polytope, exact_dedup, hard_negatives, merge_dropout, merkle, minhash, mixing, quality, sharding, simhash, token_records, warc,
)
from stowage.session import scratch_dir, written

#: Public vocabulary files, which every machine has.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
QUERY_STEP = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts. For documents whose id is divisible by 50, the number
    of other documents whose fingerprint is within the search radius follows."""
    docs = _table(spark, sf_dir, "documents")
    found = written(simhash.edited_fingerprints(docs), f"{scratch_dir(spark, 'op1')}/fingerprints")
    queries = found.where(F.col("doc_id") % QUERY_STEP == 0)
    copies = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    near = (
        simhash.search(queries, found)
        .join(copies, "fingerprint")
        .groupBy("query")
        .agg((F.sum("copies") - 1).alias("documents_near"))
        .withColumnRenamed("query", "fingerprint")
    )
    near = queries.select("doc_id", "fingerprint").join(near, "fingerprint").select("doc_id", "documents_near")
    return found.join(near, "doc_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        simhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        simhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "documents_near",
    )


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_documents(_table(spark, sf_dir, "documents"), PIECE_MODEL, seed=2)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.records(warc.read_archive(spark, path)).drop("payload", "uri")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), seed=4).drop("before", "budget")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=16, seed=5)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(exact_dedup.DigestIndex.create(spark), _table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-records")
    token_records.write_records(_table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return token_records.summarize(spark, path)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(r"\### Assistant: </turn> ok")
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    formatted = written(chat.format_turns(chat.text_parts(turns)), f"{scratch_dir(spark, 'chat')}/turns")
    return chat.conversation_digests(formatted)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for every anchor, after every seventh label is made wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(rows, F.col("vec_id") % QUERY_STEP == 0)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verification(_table(spark, sf_dir, "documents"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash, op2_merge_dropout, op3_warc, op4_mix, op5_shards, op6_exact_dedup, op7_quality, op8_token_records,
        op9_chat, op10_near_dedup, op11_hard_negatives, op12_merkle, op13_near_vectors,
    )
    return {f.__name__: f for f in found}


_MIX = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('4:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS most, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sources),
levels AS (
  SELECT *, (150 * sum(source_size) OVER () - 100 * coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (100 * sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
targets AS (
  SELECT *, least(most::DOUBLE, weight * coalesce(max(CASE WHEN level <= most / weight THEN level END) OVER (), 'inf'::DOUBLE)) AS target FROM levels),
budgets AS (
  SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM summed s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
"""

_DEDUP = """
WITH folded AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM folded WINDOW same AS (PARTITION BY text_sha256)
"""


_WARC = """
WITH paid AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
facts AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS first_id FROM paid)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM facts
"""

_CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(regexp_replace(text, '(\\|###|</turn>|<\|)', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""


_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_TEXTS = [" || ".join(_FIELD.format(c) for c in (*merkle.FIELDS[:-1], text)) for text in ("text", "seen")]
_MERKLE = f"""
WITH RECURSIVE marked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
  FROM documents),
tampered AS (
  SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS seen FROM marked),
leaves AS (
  SELECT doc_id, source, sha256({_TEXTS[0]}) AS leaf, sha256({_TEXTS[1]}) AS seen_leaf FROM tampered),
nodes AS (
  SELECT 0 AS level, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, leaf AS digest,
    count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT level + 1, source, r // 16, sha256(string_agg(digest, '' ORDER BY r)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY level, source, r // 16, n),
roots AS (SELECT source, digest AS subroot FROM nodes WHERE n = 1),
upper AS (
  SELECT 100 AS level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, subroot AS digest, count(*) OVER () AS n FROM roots
  UNION ALL
  SELECT level + 1, r // 16, sha256(string_agg(digest, '' ORDER BY r)), (n + 15) // 16 FROM upper WHERE n > 1 GROUP BY level, r // 16, n),
steps AS (
  SELECT level, coalesce('=' || source, '') AS tree, r, n, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (SELECT level, source, r, digest, n FROM nodes UNION ALL SELECT level, '/', r, digest, n FROM upper)
  WINDOW run AS (PARTITION BY level, source, r // 16 ORDER BY r)),
places AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM roots),
walk AS (
  SELECT doc_id, leaf, coalesce('=' || l.source, '') AS tree, row_number() OVER (PARTITION BY l.source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, p.place, 0 AS level,
    '' AS proof, seen_leaf AS folded FROM leaves l JOIN places p ON l.source IS NOT DISTINCT FROM p.source
  UNION ALL
  SELECT doc_id, leaf, CASE WHEN s.n > 1 THEN w.tree ELSE '=/' END, CASE WHEN s.n > 1 THEN w.r // 16 ELSE place END, place,
    CASE WHEN s.n > 1 THEN w.level + 1 ELSE 100 END, CASE WHEN s.n > 1 THEN proof || before || after ELSE proof END,
    CASE WHEN s.n > 1 THEN sha256(before || folded || after) ELSE folded END
  FROM walk w JOIN steps s ON w.level = s.level AND w.tree = s.tree AND w.r = s.r WHERE w.level < 100 OR s.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT w.*, p.source FROM walk w JOIN places p ON w.place = p.place WHERE (w.level, 1) IN (SELECT level, n FROM upper)) w
JOIN roots o ON w.source IS NOT DISTINCT FROM o.source, (SELECT digest AS root FROM upper WHERE n = 1)
"""

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
facts AS (
  SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reached WHERE a = vec_id), vec_id)) AS component_id FROM embeddings)
SELECT vec_id, n_links::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM facts
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": _WARC, "op4_mix": _MIX, "op6_exact_dedup": _DEDUP, "op9_chat": _CHAT, "op11_hard_negatives": _NEGATIVES,
        "op12_merkle": _MERKLE, "op13_near_vectors": _VECTORS,
    }
