"""The named queries of this subpackage, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe_automaton, decontaminate, divergence, line_dedup, near_dup, pii, quality_score, query_sql, revisits, substring_dedup, vector_codes
from loomspark.llm.html_text import extract_pages
from loomspark.llm.mixing import plan_mix, taken_words
from loomspark.llm.quality_rules import score_rules
from loomspark.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(plan_mix(table(spark, sf_dir, "documents")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op3_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_score.score_documents(docs, quality_score.fit_labels(docs, table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), short=True)


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = revisits.resolve(revisits.records_of_pages(table(spark, sf_dir, "pages")))
    h = F.col("headers")
    named = [h[k].alias(k.replace("-", "_")) for k in ("date", "etag", "last-modified", "content-length", "content-type", "cache-control")]
    return done.select("record_id", "canonical_url", "is_revisit", "refers_to", "resolved", *named)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dup.find_groups(table(spark, sf_dir, "documents"), width=4)
    return groups.withColumn("kept", groups["doc_id"].eqNullSafe(groups["component_id"]))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_rules(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    return bpe_automaton.report(table(spark, sf_dir, "documents"), bpe_automaton.load_automaton(path))


def queries() -> dict[str, QueryFn]:
    return {
        "op1_mixing": op1_mixing,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_quality_score": op3_quality_score,
        "op4_line_dedup": op4_line_dedup,
        "op5_revisits": op5_revisits,
        "op6_pii": op6_pii,
        "op7_near_dup": op7_near_dup,
        "op8_decontamination": op8_decontamination,
        "op9_quality_rules": op9_quality_rules,
        "op10_html_text": op10_html_text,
        "op11_vector_codes": op11_vector_codes,
        "op12_divergence": op12_divergence,
        "op13_bpe": op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_revisits": query_sql.op5(),
        "op8_decontamination": query_sql.op8(),
        "op9_quality_rules": query_sql.op9(),
        "op12_divergence": query_sql.op12(),
    }
