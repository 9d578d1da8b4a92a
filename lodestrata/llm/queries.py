"""The registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import (
    alignment, decontaminate, html_text, language_id, line_dedup, mixing, pii, pretokens, quality_rules, simhash, token_counts, token_files,
    toxicity, whitening,
)
from lodestrata.session import apply_conf, checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(read)``, where ``read`` gives a table by name."""
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            apply_conf(spark)
            return build(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build
    return register


@query("op1_benchmark_leaks")
def op1(read):
    return decontaminate.leaks(read("documents"), read("benchmark"))


@query("op2_main_text")
def op2(read):
    return html_text.extract(read("pages"))


def _sql_list(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


QUALITY_SQL = rf"""
WITH base AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 7) AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM base WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, gram FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT win.doc_id, unnest(range(win.i, win.i + 8)) AS p FROM win JOIN twice USING (doc_id, gram)) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters,
         len(list_filter(ws, lambda x: x IN {_sql_list(quality_rules.stop_forms())})) AS n_stop,
         coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(lines.n, 0) AS n_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.5
         AND coalesce(n_upper / nullif(n_letters, 0), 0) <= 0.6 AND n_stop / n_words >= 0.02
         AND n_dup_lines / n_lines <= 0.5 AND (word_chars - n_letters) / word_chars <= 0.5 AS kept
FROM m
"""


@query("op3_quality_rules", QUALITY_SQL)
def op3(read):
    return quality_rules.quality(read("documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_personal_data")
def op4(read):
    return pii.digest(pii.personal_data(read("documents")))


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
firsts AS MATERIALIZED (SELECT line, hash(line) AS name, min({'d': doc_id, 'n': line_no}) AS first FROM lines GROUP BY line),
cuts AS MATERIALIZED (
  SELECT line, first, p, hash(substr(line, 1, p - 1) || substr(line, p + 1)) AS variant
  FROM (SELECT *, unnest(range(1, length(line) + 1)) AS p FROM firsts)),
near AS MATERIALIZED (
  SELECT c.line FROM cuts c JOIN (SELECT variant, p, min(first) AS least FROM cuts GROUP BY ALL) g USING (variant, p) WHERE c.first > g.least
  UNION SELECT c.line FROM cuts c JOIN firsts s ON c.variant = s.name WHERE c.first > s.first
  UNION SELECT s.line FROM cuts c JOIN firsts s ON c.variant = s.name WHERE s.first > c.first),
drops AS (
  SELECT DISTINCT doc_id, line_no, near.line IS NOT NULL AS near
  FROM lines JOIN firsts USING (line) LEFT JOIN near USING (line)
  WHERE near.line IS NOT NULL OR {'d': doc_id, 'n': line_no} > first),
per AS (SELECT doc_id, count(*) AS n, count(*) FILTER (near) AS m, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS listed FROM drops GROUP BY doc_id)
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, coalesce(n, 0) AS n_dropped, coalesce(m, 0) AS n_near,
       coalesce(listed, '') AS dropped
FROM documents LEFT JOIN per USING (doc_id)
"""


@query("op5_line_dedup", LINE_SQL)
def op5(read):
    return line_dedup.line_report(read("documents"))


@query("op6_token_counts")
def op6(read):
    return token_counts.token_counts(read("documents"), pretokens.tokenizer_path("byte_bpe_50k.json"))


@query("op7_simhash_classes")
def op7(read):
    return simhash.near_duplicates(read("documents"))


@query("op8_language_id")
def op8(read):
    return language_id.identify(read("documents"))


@query("op9_token_files")
def op9(read):
    docs = read("documents")
    manifest = token_files.write_tokens(docs, checkpoint_dir(docs.sparkSession), pretokens.tokenizer_path("word_bpe_49k.json"))
    return token_files.read_tokens(docs.sparkSession, manifest, docs.schema["doc_id"].dataType.simpleString())


# Target shares of the tokens by domain.
MIX = {"clean": 0.9, "low": 0.1, "toxic": 0.0}
# So much of the clean text that the totals of all domains can meet their targets with rates up to 1.
REACH = 0.8


@query("op10_domain_mixing")
def op10(read):
    return mixing.rates(read("documents"), read("labels"), MIX, reach=REACH)


@query("op11_embedding_whitening")
def op11(read):
    return whitening.whiten(read("embeddings"))


@query("op12_token_alignment")
def op12(read):
    return alignment.alignments(read("documents"), pretokens.tokenizer_path("byte_bpe_50k.json"), pretokens.tokenizer_path("piece_bpe_32k.model"))


@query("op13_toxicity")
def op13(read):
    scored = toxicity.score(read("documents"), read("labels"))
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", "held_out", "score", "predicted", spans.alias("offending"))
