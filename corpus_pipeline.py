"""Training-data pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Between
stages the rows are written as Parquet and read again. Null and empty texts go in the first stage, as they have too few
words; extra columns pass to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import decision_rules, decontaminate, fuzzy_lines, near_dup, pieces
from inkloom.llm.store import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return decision_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, exactly or nearly."""
    return fuzzy_lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ids, their number, and whether decoding gives the text back."""
    made = pieces.encode(docs, decoded="_decoded")
    same = F.col("_decoded").eqNullSafe(F.regexp_replace("text", "▁", " "))
    return made.withColumns({"n_tokens": F.coalesce(F.size("ids"), F.lit(0)).cast("long"), "round_trip": same}).drop("_decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

ORACLE_SQL = None  # learned and iterative stages; tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
