"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, licenses, packing, quality, simhash, suffix, tokenbin, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_simhash_dedup": simhash.op2_simhash_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_suffix_dedup": suffix.op6_suffix_dedup,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_warc_index": warc.op8_warc_index,
    "op9_language_id": langid.op9_language_id,
    "op10_token_files": tokenbin.op10_token_files,
}

_OP3 = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), g AS (
  SELECT r, unnest(range(1, greatest(len(words) - 1, 1))) AS p, words FROM w
), c AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, words[p], words[p + 1], words[p + 2]) AS n FROM g
), k AS (
  SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM c WHERE n > 1) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims
  FROM w LEFT JOIN k USING (r)
), b AS (
  SELECT *, CAST(BITS AS BIGINT) AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & BASE) <> 0 AS base_failed,
       (fail_bits & MASK) = 0 AS kept, fail_bits, n_lines, n_exclaims
FROM b
"""

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": _OP3.replace(
        "BITS",
        " + ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, (_, rule) in enumerate(quality.RULES)),
    )
    .replace("BASE", str(quality.policy_mask("base")))
    .replace("MASK", str(quality.policy_mask("v1"))),
}
