"""The training-data queries as the driver runs them, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import cube_mixing, grammar, html_text, line_crf, line_runs, merkle, packing, pii, quality_rules, secret_scan, simhash, topk, whitening
from terraloom.llm.common import documents


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"]
    return quality_rules.quality_rules(documents(spark, sf_dir)).select(*cols)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op10_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mixing.mix(documents(spark, sf_dir))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_simhash": op2_simhash,
    "op3_line_crf": op3_line_crf,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_topk_search": op6_topk_search,
    "op7_packing": op7_packing,
    "op8_token_files": op8_token_files,
    "op9_secret_scan": op9_secret_scan,
    "op10_cube_mixing": op10_cube_mixing,
    "op11_line_dedup": op11_line_dedup,
    "op12_whitening": op12_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))

ORACLES: dict[str, str] = {
    "op11_line_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), e AS (
  SELECT r, doc_id, i, l[i] AS line,
         translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM d, unnest(range(1, len(l) + 1)) u(i)
), f AS (
  SELECT k, true AS gone FROM e WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN f USING (k) GROUP BY r, doc_id""",
    "op13_merkle_manifest": """
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, doc_id, CAST(doc_id AS VARCHAR) AS i, source, lang, n_chars, text FROM documents
), c AS (
  SELECT *, i IS NOT NULL AND xor(list_reduce(list_concat([4294967295], list_transform(string_split(i, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295) % 7 = 0 AS bad FROM f
), p AS (
  SELECT *, list_transform([i, source, lang, CAST(n_chars AS VARCHAR), text], lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END) AS v,
    CASE WHEN bad AND n_chars IS NOT NULL THEN strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END AS more FROM c
), h AS (
  SELECT r, g, doc_id, sha256(array_to_string(v, '')) AS leaf, sha256(v[1] || v[2] || v[3] || coalesce(more, v[4]) || v[5]) AS given FROM p
), l AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY g) AS n FROM h
), t AS (
  SELECT g, 0 AS level, slot, leaf AS node, n FROM l
  UNION ALL SELECT g, level + 1, slot // 2, sha256(string_agg(node, '' ORDER BY slot)), any_value(n + 1) // 2 FROM t WHERE n > 1 GROUP BY g, level, slot // 2
), k AS (
  SELECT 0 AS level, g AS slot, node, count(*) OVER () AS n FROM t WHERE n = 1
  UNION ALL SELECT level + 1, slot // 2, sha256(string_agg(node, '' ORDER BY slot)), any_value(n + 1) // 2 FROM k WHERE n > 1 GROUP BY level, slot // 2
), own AS (
  SELECT DISTINCT g, level FROM t WHERE n > 1 UNION ALL SELECT x.g, 100 + k.level FROM (SELECT DISTINCT g FROM l) x, (SELECT DISTINCT level FROM k WHERE n > 1) k
), w AS (
  SELECT r, level, level >= 100 AS high, CASE WHEN level < 100 THEN slot >> level ELSE g >> (level - 100) END AS at, g FROM l JOIN own USING (g)
), s AS (
  SELECT w.r, row_number() OVER (PARTITION BY w.r ORDER BY w.level) AS step, w.at % 2 AS odd, coalesce(t.node, k.node) AS node
  FROM w LEFT JOIN t ON NOT w.high AND t.g = w.g AND t.level = w.level AND t.slot = xor(w.at, 1) LEFT JOIN k ON w.high AND k.level = w.level - 100 AND k.slot = xor(w.at, 1)
), up AS (
  SELECT r, 0 AS step, given AS node FROM l
  UNION ALL SELECT up.r, up.step + 1, sha256(CASE WHEN odd = 1 THEN s.node || up.node ELSE up.node || coalesce(s.node, '') END) FROM up JOIN s ON s.r = up.r AND s.step = up.step + 1
), last AS (SELECT r, arg_max(node, step) AS folded_root FROM up GROUP BY r),
proof AS (SELECT r, sha256(string_agg(node, '' ORDER BY step)) AS proof_sha256 FROM s WHERE node IS NOT NULL GROUP BY r)
SELECT doc_id, leaf, x.node AS subroot, y.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = y.node AS verified
FROM l JOIN last USING (r) LEFT JOIN proof USING (r) JOIN (SELECT g, node FROM t WHERE n = 1) x USING (g) CROSS JOIN (SELECT node FROM k WHERE n = 1) y""",
    "op6_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op4_quality_rules": f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM t
), win AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(w) - 6)) u(i)
), rep AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1
), cov AS (
  SELECT r, count(DISTINCT i + j) AS n FROM rep, unnest(range(0, 8)) u(j) GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words,
         len(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         len(text) - len(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutter
  FROM w LEFT JOIN cov USING (r)
), f AS (
  SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2,
         word_chars / greatest(n_words, 1) AS mean_chars, n_symbols / greatest(n_words, 1) AS symbols,
         n_dup_lines / greatest(n_lines, 1) AS dups, n_stop / greatest(n_words, 1) AS stops, n_stutter / greatest(n_words, 1) AS stutter
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2 OR mean_chars < 2 OR mean_chars > 14 OR symbols > 0.1 OR dups > 0.6 OR stops < 0.01 OR stutter > 0.3) AS kept,
       list_filter([CASE WHEN f1 THEN 'min_words' END, CASE WHEN n_repeat_words / greatest(n_words, 1) > 0.3 THEN 'repeated_windows' END,
         CASE WHEN mean_chars < 2 OR mean_chars > 14 THEN 'word_length' END, CASE WHEN symbols > 0.1 THEN 'symbols' END,
         CASE WHEN dups > 0.6 THEN 'repeated_lines' END, CASE WHEN stops < 0.01 THEN 'stop_words' END,
         CASE WHEN stutter > 0.3 THEN 'stuttering' END], lambda x: x IS NOT NULL) AS failed_rules
FROM f""",
}
