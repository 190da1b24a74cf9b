"""The queries of the ten operators over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetweave.llm import bpe, compress_bands, decontam, html_blocks, license, link_trust, lm_automaton, quality, substring, superminhash
from fleetweave.llm._spark import table


def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.url_filter(table(spark, sf_dir, "pages"))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_bands.compression_bands(table(spark, sf_dir, "documents"))


def op3_lm_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_automaton.score(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_substring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.recognise(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """Pieces by row; a known sentence is looked up as the run of one to ``most`` pieces from each piece on, the longest
    first. That a run may not begin within an earlier one is left out, for no known sentence holds the end of another
    before a mark."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    most = 6
    known = ", ".join(f"({quote(license.normal(v))}, {quote(k)})" for k, v in license.SENTENCES.items())
    rules = ", ".join(f"({quote(n)}, {k}, {quote(',' + s.strip(',').replace(',', ',,') + ',')})" for n, k, s in license.rule_rows())
    spans = " UNION ALL ".join(f"SELECT r, pos, {n} AS n, array_to_string(list_slice(said, pos, pos + {n - 1}), ' ') AS sentence FROM places WHERE pos + {n - 1} <= len(said)" for n in range(1, most + 1))
    return rf"""
WITH known(sentence, sid) AS (VALUES {known}), rules(license, rule, seq) AS (VALUES {rules}),
rows_ AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
parts AS MATERIALIZED (SELECT r, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[.!?;:]+(\s|$)', chr(10), 'g'), '[

]+'), lambda x: trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: x <> '') AS said FROM rows_),
places AS (SELECT r, said, unnest(generate_series(1, len(said))) AS pos FROM parts),
spans AS ({spans}),
found AS (SELECT r, pos, arg_max(sid, n) AS sid FROM spans JOIN known USING (sentence) GROUP BY 1, 2),
seqs AS (SELECT r, ',' || string_agg(sid, ',,' ORDER BY pos) || ',' AS said FROM found GROUP BY r),
hits AS (SELECT r, license, rule, seq, CAST((length(said) - length(replace(said, seq, ''))) / length(seq) AS BIGINT) AS n_found FROM seqs JOIN rules ON contains(said, seq))
SELECT doc_id, license, rule, n_found, NOT EXISTS (SELECT 1 FROM hits o WHERE o.r = h.r AND o.seq <> h.seq AND contains(o.seq, h.seq)) AS is_longest FROM hits h JOIN rows_ USING (r)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_link_trust": op1_link_trust,
    "op2_compression_bands": op2_compression_bands,
    "op3_lm_automaton": op3_lm_automaton,
    "op4_decontamination": op4_decontamination,
    "op5_html_blocks": op5_html_blocks,
    "op6_substring_chains": op6_substring_chains,
    "op7_superminhash": op7_superminhash,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_license_scan": op10_license_scan,
}

ORACLES: dict[str, str] = {"op1_link_trust": link_trust.sql(), "op3_lm_automaton": lm_automaton.sql(), "op10_license_scan": _license_sql()}
