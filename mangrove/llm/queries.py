"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, media, mixing, packing, quality, secrets, sharding, simhash, toxicity, wordpiece
from .common import load


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat.format_chats(chat.turn_events(turns))
    return chats.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fold."""
    return load(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit(load(spark, sf_dir, "documents"), training_labels(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(load(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(load(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def pack(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(load(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.media_columns(load(spark, sf_dir, "documents"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_token_counts, op3_toxicity, op4_quality_rules, op5_mixing, op6_secret_scans, op7_packing, op8_sharding, op9_simhash, op10_media_columns)}


#: DuckDB's forms of what SQL can express.
ORACLES: dict[str, str] = {}


ORACLES["op1_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<|\[)(\||/?s>|/?INST\])', '\1\\\2', 'g') AS escaped FROM c)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(length(escaped) + length(role) + 24) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

ORACLES["op4_quality_rules"] = r"""
WITH d AS (SELECT doc_id, lang, source, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, win) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, COUNT(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(0, 8)) AS p FROM rep) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(COALESCE(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(COALESCE(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
r AS (SELECT *, LEAST(1000 * n_symbols // GREATEST(word_chars, 1), 1000) AS symbols, LEAST(1000 * n_dup_lines // GREATEST(n_lines, 1), 1000) AS dup_lines,
  LEAST(1000 * n_repeat_words // GREATEST(n_words, 1), 1000) AS repeats, CASE WHEN mean < 1000 THEN mean ELSE 1000 + 1000 * doublings + 1000 * (mean - 1000 * (1::BIGINT << doublings)) // (1000 * (1::BIGINT << doublings)) END AS mean_len,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (SELECT *, 10 * word_chars // GREATEST(n_words, 1) AS mean, length(bin(10 * word_chars // GREATEST(n_words, 1) // 1000)) - 1 AS doublings FROM b)),
l AS (SELECT lang, source, rule, bin FROM (SELECT lang, source, 'symbols' AS rule, symbols AS bin FROM r WHERE n_words > 0 UNION ALL SELECT lang, source, 'dup_lines', dup_lines FROM r WHERE n_words > 0
  UNION ALL SELECT lang, source, 'repeats', repeats FROM r WHERE n_words > 0 UNION ALL SELECT lang, source, 'mean_len', mean_len FROM r WHERE n_words > 0)),
g AS (SELECT 0 AS level, lang, source, rule, bin FROM l UNION ALL SELECT 1, lang, NULL, rule, bin FROM l UNION ALL SELECT 2, NULL, NULL, rule, bin FROM l),
q AS (SELECT level, lang, source, rule, COUNT(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM g GROUP BY level, lang, source, rule),
f AS (SELECT level, lang, source, MAX(n) AS n, CAST(GREATEST(MAX(q3 + 3 * (q3 - q1)) FILTER (rule = 'symbols'), 100) AS DOUBLE) AS hs, CAST(GREATEST(MAX(q3 + 3 * (q3 - q1)) FILTER (rule = 'dup_lines'), 300) AS DOUBLE) AS hd,
  CAST(GREATEST(MAX(q3 + 3 * (q3 - q1)) FILTER (rule = 'repeats'), 200) AS DOUBLE) AS hr, CAST(GREATEST(MAX(q3 + 3 * (q3 - q1)) FILTER (rule = 'mean_len'), 120) AS DOUBLE) AS hm, CAST(LEAST(MAX(q1 - 3 * (q3 - q1)) FILTER (rule = 'mean_len'), 15) AS DOUBLE) AS lm FROM q GROUP BY level, lang, source),
t AS (SELECT r.*, (LEAST(o.n, 100)::DOUBLE * o.hs + (100.0::DOUBLE - LEAST(o.n, 100)::DOUBLE) * ((LEAST(a.n, 100)::DOUBLE * a.hs + (100.0::DOUBLE - LEAST(a.n, 100)::DOUBLE) * e.hs) / 100.0::DOUBLE)) / 100.0::DOUBLE AS hs, (LEAST(o.n, 100)::DOUBLE * o.hd + (100.0::DOUBLE - LEAST(o.n, 100)::DOUBLE) * ((LEAST(a.n, 100)::DOUBLE * a.hd + (100.0::DOUBLE - LEAST(a.n, 100)::DOUBLE) * e.hd) / 100.0::DOUBLE)) / 100.0::DOUBLE AS hd, (LEAST(o.n, 100)::DOUBLE * o.hr + (100.0::DOUBLE - LEAST(o.n, 100)::DOUBLE) * ((LEAST(a.n, 100)::DOUBLE * a.hr + (100.0::DOUBLE - LEAST(a.n, 100)::DOUBLE) * e.hr) / 100.0::DOUBLE)) / 100.0::DOUBLE AS hr, (LEAST(o.n, 100)::DOUBLE * o.hm + (100.0::DOUBLE - LEAST(o.n, 100)::DOUBLE) * ((LEAST(a.n, 100)::DOUBLE * a.hm + (100.0::DOUBLE - LEAST(a.n, 100)::DOUBLE) * e.hm) / 100.0::DOUBLE)) / 100.0::DOUBLE AS hm, (LEAST(o.n, 100)::DOUBLE * o.lm + (100.0::DOUBLE - LEAST(o.n, 100)::DOUBLE) * ((LEAST(a.n, 100)::DOUBLE * a.lm + (100.0::DOUBLE - LEAST(a.n, 100)::DOUBLE) * e.lm) / 100.0::DOUBLE)) / 100.0::DOUBLE AS lm FROM r LEFT JOIN f o ON o.level = 0 AND o.lang IS NOT DISTINCT FROM r.lang AND o.source IS NOT DISTINCT FROM r.source
  LEFT JOIN f a ON a.level = 1 AND a.lang IS NOT DISTINCT FROM r.lang LEFT JOIN f e ON e.level = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbols <= hs AND dup_lines <= hd AND repeats <= hr AND mean_len <= hm AND mean_len >= lm AS kept FROM t
"""
