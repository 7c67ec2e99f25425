"""Queries of the corpus operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.exact_dedup import exact_groups

    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL["op9_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.token_counts import token_counts

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2048)


@_query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.jaccard_join import jaccard_components

    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.quality_rules import apply_policy, ledger

    led = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "v1")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


_LEDGER = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), p AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p) WHERE n > 1
), c AS (
  SELECT r, sum(least(5, i - coalesce(before, -5))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_marks, len(list_distinct(w)) AS n_distinct
  FROM w LEFT JOIN c USING (r)
), f AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (n_symbols > 0.1 * n_words)::BIGINT
    + 8 * (n_dup_lines > 0.3 * greatest(n_lines, 1))::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
    + 32 * (n_upper > 0.5 * word_chars)::BIGINT + 64 * (n_marks > 0.2 * n_words)::BIGINT + 128 * (n_distinct < 0.1 * n_words)::BIGINT AS failed FROM m
)"""
ORACLE_SQL["op3_quality_rules"] = _LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


@_query
def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of op3 under two versions of the policy: what each rule drops, and what only it drops."""
    from lattica.llm.quality_rules import ablations, ledger

    led = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ablations(led, ["v1", "v2"])


ORACLE_SQL["rule_ablations"] = _LEDGER + """
, r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('word_length', 16), ('upper_case', 32), ('exclamations', 64), ('few_distinct', 128)),
o AS (SELECT 'v1' AS policy, 255 AS mask UNION ALL SELECT 'v2', 1 + 2 + 8 + 16 + 128)
SELECT policy, rule, count(*) FILTER (WHERE failed & bit <> 0) AS fails, count(*) FILTER (WHERE failed & mask = bit) AS only_this FROM o JOIN r ON mask & bit <> 0, f GROUP BY 1, 2
"""


@_query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.quality_classifier import quality_scores

    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.toxicity import toxicity_scores

    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.html_extraction import main_texts

    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.line_dedup import drop_boilerplate

    return drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"), host="source").select("doc_id", "source", "text", "n_lines", "n_dropped")


ORACLE_SQL["op1_line_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), x AS (
  SELECT r, doc_id, source, i, l[i] AS line, trim(l[i], ' ' || chr(9) || chr(13)) AS k FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)
), b AS (
  SELECT source, k FROM x JOIN (SELECT source, count(*) AS pages FROM d GROUP BY source) p USING (source)
  WHERE k <> '' GROUP BY source, k, pages HAVING count(DISTINCT r) >= 3 AND count(DISTINCT r) > 0.05 * pages
)
SELECT doc_id, x.source, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.k IS NULL), '') AS text, count(*) AS n_lines, count(b.k) AS n_dropped
FROM x LEFT JOIN b ON x.source = b.source AND x.k = b.k GROUP BY r, doc_id, x.source
"""


@_query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.mixing import mix

    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
