"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (byte_bpe, conversation_trie, embedding_dedup, hpylm, jaccard_join, langid, license_scan, order_minhash,
               packing, quality, token_alignment, token_counts, toxicity)
from .common import crc_mod


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    return (langid.predict(docs, model, keep=["doc_id"])
            .withColumn("held_out", crc_mod("doc_id", 4) == 2))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       quality.fails(quality.BASE).alias("base_failed"),
                       (~quality.fails(quality.BASE) & ~quality.fails(quality.CURRENT)).alias("kept"), "fail_bits")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir)).drop("matches")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_documents(spark, sf_dir)).drop("class_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = crc_mod("doc_id", 4) != 2
    model = toxicity.fit(docs.where(learn).select("doc_id", "text"), labels.where(learn))
    return (toxicity.score(docs, model, keep=["doc_id"], threshold=0.3)
            .withColumn("held_out", crc_mod("doc_id", 4) == 2))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model, others = hpylm.fit(docs.where(crc_mod("doc_id", 5) != 1))
    return (hpylm.score(docs, model, others, keep=["doc_id"])
            .withColumn("held_out", crc_mod("doc_id", 5) == 1))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(_documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokenizers(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                            public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation_trie.per_conversation(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(own))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_language_id, op3_quality_rules, op4_license_scan, op5_jaccard_join, op6_toxicity,
    op7_pitman_yor, op8_token_counts, op9_byte_bpe, op10_order_minhash, op11_token_alignment, op12_conversation_trie,
    op13_embedding_dedup)}

# DuckDB SQL of the queries that SQL can express on whole tables; tests hold the others to the
# tokenizer libraries, to brute force or to held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS ls
  FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, unnest(range(5)) AS v(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '\p{Lu}')) AS n_upper,
         len(regexp_extract_all(t, '!')) AS n_bangs
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (
  SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
    + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
    + 16 * (word_chars > 15 * n_words)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT
    + 64 * (10 * n_upper > 4 * word_chars)::BIGINT + 128 * (2 * n_bangs > n_words)::BIGINT)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits FROM b""",
    "op5_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i)
  WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT o.a, o.b FROM o JOIN n na ON o.a = na.doc_id JOIN n nb ON o.b = nb.doc_id WHERE 100 * o.o >= 75 * (na.n + nb.n - o.o)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.least_id, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) c ON w.doc_id = c.a""",
    "op12_conversation_trie": r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, b: list_reduce([xor(a, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda u, k: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 6 AS h
  FROM own),
c AS (
  SELECT h.conv_id, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM c, unnest(range(len(turns) + 1)) AS u(d)),
n AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids
  FROM p GROUP BY d, prefix),
k AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
s AS (
  SELECT v.d, v.prefix, count(*) FILTER (k.n_children IS NULL) AS n_leaves,
         sum(CASE WHEN u.d = 0 THEN 0 ELSE (u.n_convs - 1) * length(u.prefix[u.d].text) END)::BIGINT AS saved_tokens
  FROM n v JOIN n u ON u.d >= v.d AND u.prefix[1:v.d] = v.prefix LEFT JOIN k ON k.d = u.d AND k.prefix = u.prefix GROUP BY v.d, v.prefix)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves,
       s.saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.prefix = n.prefix LEFT JOIN k ON k.d = n.d AND k.prefix = n.prefix
LEFT JOIN n up ON up.d = n.d - 1 AND up.prefix = n.prefix[1:n.d - 1]""",
}
