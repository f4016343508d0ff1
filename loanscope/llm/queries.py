"""Registered queries of the text operators, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm import (
    byte_bpe,
    decontaminate,
    embedding_dedup,
    importance_resampling,
    line_dedup,
    mixing,
    ppm,
    simhash,
    substring_dedup,
    token_alignment,
    toxicity,
    url_filters,
    warc,
)
from loanscope.llm import pipeline as corpus
from loanscope.llm.common import crc_fold, table
from loanscope.session import staged


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id") != 0)
    return toxicity.score(docs, model).select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    marked = warc.mark_revisits(table(spark, sf_dir, "pages"))
    written = staged(warc.write_archives(marked, folder), "warc-archives")
    records = warc.read_archives(spark, folder, written)
    return records.filter(F.col("kind").isin("response", "revisit")).select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed_lines", F.octet_length("text").cast("long").alias("kept_bytes"),
                      F.sha2("text", 256).alias("kept_sha256"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = ppm.train(docs.filter(crc_fold("doc_id") != 1))
    return ppm.score(docs, model).select(
        "doc_id", (crc_fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.build(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, keep_text=False)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = token_alignment.read_tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    linked = staged(token_alignment.align_links(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizers), "alignment")
    return token_alignment.link_scores(linked, token_alignment.link_counts(linked))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_embedding_near_dedup, op2_substring_dedup, op3_decontamination, op4_toxicity, op5_simhash_near_dedup,
             op6_url_filters, op7_warc, op8_line_dedup, op9_language_model, op10_mixing,
             op11_byte_level_bpe, op12_token_alignment, op13_importance_resampling, pipeline)
    return {f.__name__: f for f in found}


SPACES = r"[\x20\x09-\x0D]+"

OP1 = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9
), reach AS (
  SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links,
  (SELECT min(m) FROM reach r WHERE r.n = v.vec_id) AS component_id,
  v.vec_id = (SELECT min(m) FROM reach r WHERE r.n = v.vec_id) AS kept
FROM v
"""

OP2 = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)
), again AS (
  SELECT doc_id, i FROM win WHERE t IN (SELECT t FROM win GROUP BY t HAVING count(*) > 1)
), gone AS (
  SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM again) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(g.ks), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(list_transform(range(1, len(w.w) + 1), lambda k: CASE WHEN list_contains(coalesce(g.ks, []), k) THEN NULL ELSE w.w[k] END), lambda x: x IS NOT NULL), ' ')) AS kept_sha256
FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id
"""

OP3 = """
WITH d AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
SELECT a.id AS doc_id, b.id AS item_id, any_value(n.n) AS n_shingles, count(*) AS n_found, count(*) / any_value(n.n) AS containment
FROM s a JOIN s b ON a.kind = 'd' AND b.kind = 'i' AND a.s = b.s JOIN n ON n.id = b.id
GROUP BY a.id, b.id HAVING count(*) >= any_value(n.n) * 0.8 - 1e-9
"""

OP7 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((((strpos('0123456789abcdef', substr(hex, (5 * i // 4 + 1)::BIGINT, 1)) - 1) * 16
    + CASE WHEN 5 * i // 4 + 2 <= 40 THEN strpos('0123456789abcdef', substr(hex, (5 * i // 4 + 2)::BIGINT, 1)) - 1 ELSE 0 END)
    >> (3 - (5 * i) % 4)::INTEGER) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM q
"""


# CRC-32 from its definition (reversed polynomial 3988292384), for each distinct word once.
OP13 = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS w FROM benchmark
), dw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w
), bw AS (SELECT w, count(*) AS n FROM b GROUP BY w
), hashed AS (
  SELECT w, xor(list_reduce(list_transform(range(0, strlen(w)), lambda i:
      (strpos('0123456789ABCDEF', substr(hex(w), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(w), 2 * i + 2, 1)) - 1),
    lambda a, x: list_reduce(range(0, 8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(a, x::BIGINT)), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS k
  FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), s AS (SELECT k, sum(n)::DOUBLE AS n FROM dw JOIN hashed USING (w) GROUP BY k
), t AS (SELECT k, sum(n)::DOUBLE AS n FROM bw JOIN hashed USING (w) GROUP BY k
), gain AS (
  SELECT w, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
    / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS g
  FROM hashed LEFT JOIN s USING (k) LEFT JOIN t USING (k)
), total AS (
  SELECT doc_id, row, sum(g) AS g FROM (SELECT doc_id, row, unnest(w) AS w FROM (SELECT *, row_number() OVER () AS row FROM d)) JOIN gain USING (w) GROUP BY doc_id, row
), weighed AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / len(w)), 0)::BIGINT AS weight
  FROM (SELECT *, row_number() OVER () AS row FROM d) d LEFT JOIN total ON total.row = d.row
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM weighed
), ranked AS (
  SELECT *, n_features >= 20 AS may, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN may AND r <= (SELECT count(*) FROM ranked WHERE may) * 10 // 100 THEN r END AS rank
FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_importance_resampling": OP13, "op1_embedding_near_dedup": OP1, "op2_substring_dedup": OP2, "op3_decontamination": OP3, "op7_warc": OP7}
