"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes
every stage's rows as Parquet in the shared scratch folder and reads them back for the next one.

Edge cases, for every stage: an empty table gives no rows; extra columns pass through, whatever their names; a null text is
empty and fails the quality rules; null doc_ids are left alone by the stages that compare documents; rows that repeat a
doc_id are documents of their own, of which near_dup keeps or drops all by their groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import decontaminate, line_dedup, mixing, near_dup, quality_rules
from loomspark.session import discard, materialize, temporary_tables
from loomspark.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go; documents that lose all their words with them go too."""
    return line_dedup.dedup_lines(docs, short=True)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    return near_dup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; adds shard and epoch."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("line_dedup", dedup_lines),
    ("near_dup", dedup_near),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: Near-duplicate groups and the mixing draw have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents. What a stage wrote on its way, and the rows it was given, are deleted once its own rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary_tables(spark):
            given, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        discard(given)
    return docs
