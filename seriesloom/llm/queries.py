"""One query for each operator, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, contamination, fingerprints, jaccard_join, license_scan, line_dedup, ngram_scores, quality, shard_map, token_blocks, trie_counts, turn_repair, twins, vector_codes
from .shared import shared_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    token_blocks.write_token_blocks(_read(spark, sf_dir, "documents"), path)
    return token_blocks.read_token_blocks(spark, path, digest_only=True)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(_read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents")).withColumn("n_detections", F.size("detections").cast("bigint")).drop("detections")


def op7_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.media_digests(_read(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_digests(_read(spark, sf_dir, "documents"))


def op9_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_scores.backoff_scores(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_repeated", F.round("score", 6).alias("score"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op11_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_map.shard_documents(_read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.product_codes(vector_codes.whole_vectors(_read(spark, sf_dir, "embeddings")))
    return vector_codes.with_label_error(coded, books)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_report(turn_repair.damaged(_read(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_blocks": op1_token_blocks,
        "op2_quality": op2_quality,
        "op3_decontamination": op3_decontamination,
        "op4_line_dedup": op4_line_dedup,
        "op5_trie_token_counts": op5_trie_token_counts,
        "op6_license_scan": op6_license_scan,
        "op7_media_fingerprints": op7_media_fingerprints,
        "op8_bpe_codec": op8_bpe_codec,
        "op9_ngram_scores": op9_ngram_scores,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_jump_shards": op11_jump_shards,
        "op12_vector_codes": op12_vector_codes,
        "op13_turn_repair": op13_turn_repair,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str, pattern: str) -> str:
    return f"SELECT {key}, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{pattern}'), []) AS w FROM {table}"


_ALNUM, _SPACE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

_OP3 = f"""WITH d AS ({_words("documents", "doc_id", _ALNUM)}), i AS ({_words("benchmark", "item_id", _ALNUM)}),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS t FROM i, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS k) WHERE len(w) > 0),
places AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM windows), LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS k)),
found AS (SELECT doc_id, n, k, item_id FROM places JOIN windows USING (n, t)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, k FROM found)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP9 = f"""WITH d AS ({_words("documents", "doc_id", _ALNUM)}),
p AS (SELECT doc_id, CASE WHEN k > 1 THEN w[k - 1] END AS a, w[k] AS b FROM d, LATERAL (SELECT unnest(generate_series(1, len(w))) AS k)),
n AS (SELECT count(*) AS words FROM p),
one AS (SELECT b AS w, count(*) AS c FROM p GROUP BY 1),
two AS (SELECT a, b, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY 1, 2),
s AS (SELECT doc_id, CASE WHEN p.a IS NOT NULL THEN two.c >= 2 ELSE len(d.w) = 1 AND y.c >= 2 END AS again, CASE WHEN p.a IS NOT NULL THEN ln(two.c) - ln(x.c) ELSE ln(y.c) - ln(words) END AS s
  FROM p JOIN d USING (doc_id) CROSS JOIN n LEFT JOIN two ON p.a = two.a AND p.b = two.b LEFT JOIN one x ON p.a = x.w LEFT JOIN one y ON p.b = y.w)
SELECT d.doc_id, count(s) AS n_words, count(*) FILTER (again) AS n_repeated, round(sum(s) / count(s), 6) AS score FROM d LEFT JOIN s USING (doc_id) GROUP BY 1"""

_OP10 = f"""WITH RECURSIVE d AS ({_words("documents", "doc_id", _SPACE)}),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS s FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 2))) AS k) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN size u ON a = u.doc_id JOIN size v ON b = v.doc_id WHERE 100 * pairs.n >= 90 * (u.n + v.n - pairs.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT reach.a AS doc_id, coalesce(max(size.n), 0) AS n_shingles, min(reach.b) AS component_id FROM reach LEFT JOIN size ON reach.a = size.doc_id GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    """SQL twins of the queries that SQL can say; tests hold the others against brute force, round trips or held-out labels."""
    return {
        "op3_decontamination": _OP3,
        "op9_ngram_scores": _OP9,
        "op10_jaccard_join": _OP10,
        "op11_jump_shards": twins.shards(),
        "op12_vector_codes": twins.vector_code_rows(),
        "op13_turn_repair": twins.repaired_conversations(),
    }
