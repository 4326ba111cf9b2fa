"""Queries over text collections, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosescan.llm import bpe, formatdup, lookalike, neardup, packing, quality
from prosescan.sources.tables import spread, table

#: Tokens that a container of p7_packed holds.
CAPACITY = 2048
RULE_TEXT = ["signature", "description", "rewrite_guidance"]
PAYLOAD = ["text", "kind", "match", "note"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.NearDuplicates(spread(table(spark, sf_dir, "extracted_rules").select("rule_id", *RULE_TEXT)), "rule_id", RULE_TEXT)
    return found.pairs().select(F.col("a").alias("rule_a"), F.col("b").alias("rule_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.NearDuplicates(spread(table(spark, sf_dir, "extracted_rules").select("rule_id", *RULE_TEXT)), "rule_id", RULE_TEXT)
    return found.groups().withColumnRenamed("id", "rule_id")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = formatdup.json_fields(F.col("payload"), PAYLOAD)
    return table(spark, sf_dir, "phrase_raw").select("raw_id", fields.alias("fields")).where("fields is not null").select("raw_id", "fields.*")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdup.format_duplicates(_payloads(spark, sf_dir), "raw_id", PAYLOAD)


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdup.collapsed(_payloads(spark, sf_dir), "raw_id", PAYLOAD)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon, specs = table(spark, sf_dir, "lexicon"), table(spark, sf_dir, "signature_specs")
    bigrams = lookalike.letter_bigrams(lexicon.select(F.col("phrase").alias("t")).union(specs.select(F.col("description").alias("t"))), "t")
    phrases = lookalike.look_alike_matches(spread(table(spark, sf_dir, "watch_phrases").select("phrase_id", "text")), "phrase_id", "text", lexicon, "lex_id", "phrase", bigrams)
    rules = lookalike.look_alike_matches(spread(table(spark, sf_dir, "extracted_rules").select("rule_id", "description")), "rule_id", "description", specs, "signature", "description", bigrams)
    named = lambda df, field: df.select(F.lit(field).alias("field_name"), "row_id", "ref_id")
    return named(phrases, "phrase").unionByName(named(rules, "description"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(bpe.token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.text_statistics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
    ratios = [F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "line_end_share", "common_share")]
    return stats.select("doc_id", "n_chars", "n_words", "n_lines", *ratios)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_statistics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "shape").where("shape is not null")


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_records, p4_found, p6_ids, p7_packed, p8_stats, p8_found)}

CANON = ", ".join(rf"regexp_replace(lower(coalesce(json_extract_string(payload, '$.{f}'), '')), '[^\p{{L}}\p{{Nd}}]', '', 'g') AS c_{f}" for f in PAYLOAD)
KEYS = ", ".join(f"c_{f}" for f in PAYLOAD)
PAIRS = r"""
words AS (
  SELECT rule_id, w, count(*) AS n FROM (
    SELECT rule_id, unnest(regexp_extract_all(lower(concat_ws(' ', signature, description, rewrite_guidance)), '[\p{L}\p{Nd}]+')) AS w FROM extracted_rules
  ) GROUP BY ALL
),
sizes AS (SELECT rule_id, sum(n) AS m FROM words GROUP BY rule_id),
shared AS (SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, sum(least(a.n, b.n)) AS s FROM words a JOIN words b ON a.w = b.w AND a.rule_id < b.rule_id GROUP BY ALL),
pairs AS (SELECT rule_a, rule_b FROM shared JOIN sizes x ON x.rule_id = rule_a JOIN sizes y ON y.rule_id = rule_b WHERE 2 * s >= 0.8 * (x.m + y.m))
"""
COMMON = ", ".join(f"'{w}'" for w in quality.COMMON_WORDS.split())
ENDS = quality.END_MARKS.replace("'", "''")

SQL = {
    "p2_found": f"WITH {PAIRS} SELECT rule_a, rule_b FROM pairs",
    "p2_groups": f"""
WITH RECURSIVE {PAIRS},
both_ways AS (SELECT rule_a AS u, rule_b AS v FROM pairs UNION SELECT rule_b, rule_a FROM pairs),
reached AS (SELECT rule_id AS id, rule_id AS other FROM extracted_rules UNION SELECT r.id, b.v FROM reached r JOIN both_ways b ON b.u = r.other)
SELECT id AS rule_id, min(other) AS group_id, (SELECT count(*) FROM both_ways b WHERE b.u = id) AS n_links FROM reached GROUP BY id
""",
    "p3_found": f"""
WITH canon AS (SELECT raw_id, {CANON} FROM phrase_raw),
kept AS (SELECT raw_id, min(raw_id) OVER (PARTITION BY {KEYS}) AS keep_id FROM canon)
SELECT keep_id, raw_id AS copy_id FROM kept WHERE raw_id <> keep_id
""",
    "p3_records": f"""
WITH canon AS (SELECT raw_id, payload, {CANON} FROM phrase_raw),
kept AS (SELECT min(raw_id) AS keep_id, count(*) AS n_copies FROM canon GROUP BY {KEYS})
SELECT keep_id, {", ".join(f"coalesce(json_extract_string(payload, '$.{f}'), '') AS {f}" for f in PAYLOAD)}, n_copies FROM kept JOIN phrase_raw ON raw_id = keep_id
""",
    "p8_stats": rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT doc_id, text, list_concat(regexp_extract_all(text, '\p{{Han}}'), regexp_extract_all(regexp_replace(text, '\p{{Han}}', ' ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS words,
    list_filter(regexp_split_to_array(text, '[\n\r\f\x0b\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '[\s\p{{Z}}\x1c-\x1f\x{{FEFF}}]', '', 'g') <> '') AS lines,
    length(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g')) AS ink
  FROM texts
),
counts AS (
  SELECT *, len(words) AS n_words, len(lines) AS n_lines, list_sum(list_transform(words, lambda w: length(w))) AS word_chars,
    len(list_filter(words, lambda w: lower(w) IN ({COMMON}))) AS common,
    len(list_filter(lines, lambda x: contains('{ENDS}', right(regexp_replace(x, '[\s\p{{Z}}\x1c-\x1f\x{{FEFF}}]+$', ''), 1)))) AS ended,
    length(regexp_replace(text, '[\p{{L}}\p{{M}}\p{{N}}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g')) AS symbols
  FROM parts
)
SELECT doc_id, length(text) AS n_chars, n_words, n_lines, round(word_chars / nullif(n_words, 0), 6) AS mean_word_length, round(symbols / nullif(ink, 0), 6) AS symbol_ratio,
  round(ended / nullif(n_lines, 0), 6) AS line_end_share, round(common / nullif(n_words, 0), 6) AS common_share
FROM counts
""",
}
