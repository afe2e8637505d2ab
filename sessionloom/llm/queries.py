"""The registered queries of the training-data operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, langid, linededup, lm, ngramjoin, packing, quality, resampling, sharding, simhash, tokenstore, toxicity, whitening

SHARD_BYTES = 256 << 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id", "n_same")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.fit_and_score(_table(spark, sf_dir, "documents"), _fold(5) != 1, public_tokenizers.path("word_bpe_49k.json"))
    scored = scored.withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (_fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), common.scratch_path(spark, "token-orc")
    tokenstore.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    found = tokenstore.digest(tokenstore.read_ids(spark, path, docs.schema["doc_id"].dataType.simpleString()))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed_lines", "text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_kept", F.array_join("failed", ",").alias("failed_rules"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "first_word", "n_words", "n_equal")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)
    return pieces.withColumnRenamed("id", "doc_id")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, _fold(3) != 1)
    found = langid.predict(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels, _fold(5) != 0)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted", "spans")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25, min_words=20, seed=7)
    return found.withColumnRenamed("id", "doc_id")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=4, scale=256).withColumnRenamed("id", "vec_id")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(_table(spark, sf_dir, "documents"), shingle_words=5, percent=80).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_lm_score, op3_token_orc, op4_line_dedup, op5_quality, op6_decontam, op7_packing, op8_langid, op9_sharding, op10_toxicity, op11_importance_resampling, op12_embedding_whitening, op13_ngram_join)}

_OP5_ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
signals AS (
  SELECT words.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         length(text) - length(replace(text, '!', '')) AS n_exclamations, len(l) AS n_lines
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id),
judged AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive, n_symbols > 0.2 * n_words AS symbols,
         n_exclamations > 0.3 * n_words AS shouting, n_dup_lines > 0.5 * n_lines AS copied_lines FROM signals),
long AS (
  SELECT coalesce(source, '') AS host, r.rule, CASE r.rule WHEN 'short' THEN short WHEN 'repetitive' THEN repetitive WHEN 'symbols' THEN symbols WHEN 'shouting' THEN shouting ELSE copied_lines END AS failed
  FROM judged, (VALUES ('short'), ('repetitive'), ('symbols'), ('shouting'), ('copied_lines')) AS r(rule)),
hosts AS (SELECT host, rule, count(*) AS n, count(*) FILTER (failed) AS k FROM long GROUP BY host, rule),
prior AS (
  SELECT rule, m, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS s
  FROM (SELECT rule, sum(k) / sum(n) AS m, var_pop(k / n) AS v FROM hosts GROUP BY rule)),
verdicts AS (SELECT host, bool_and((k + m * s) / (n + s) <= 0.5) AS host_kept FROM hosts JOIN prior USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
       NOT (short OR repetitive OR symbols OR shouting OR copied_lines) AND host_kept AS kept, host_kept,
       array_to_string(list_filter([CASE WHEN short THEN 'short' END, CASE WHEN repetitive THEN 'repetitive' END, CASE WHEN symbols THEN 'symbols' END,
                   CASE WHEN shouting THEN 'shouting' END, CASE WHEN copied_lines THEN 'copied_lines' END], lambda x: x IS NOT NULL), ',') AS failed_rules
FROM judged JOIN verdicts ON coalesce(source, '') = host
"""

_OP9_ORACLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS UBIGINT) AS BIGINT) AS hash,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents),
buckets AS (
  SELECT 0 AS depth, CAST(0 AS BIGINT) AS prefix, sum(bytes) AS total, count(*) AS n FROM docs
  UNION ALL
  SELECT b.depth + 1, d.hash >> (60 - b.depth - 1), sum(d.bytes), count(*)
  FROM buckets b JOIN docs d ON d.hash >> (60 - b.depth) = b.prefix
  WHERE b.total > {SHARD_BYTES} AND b.n > 1 AND b.depth < 60 GROUP BY 1, 2)
SELECT doc_id, CASE WHEN depth = 0 THEN '*' ELSE substr(lpad(bin(hash), 60, '0'), 1, depth) END AS shard, depth, CAST(0 AS BIGINT) AS page, bytes
FROM docs JOIN buckets ON hash >> (60 - depth) = prefix WHERE total <= {SHARD_BYTES} OR n = 1
"""

ORACLE_SQL = {"op5_quality": _OP5_ORACLE, "op9_sharding": _OP9_ORACLE}
