"""Corpus pipeline over ``documents``: STAGES are applied in turn, each to what the one before kept.

Quality rules, line deduplication, near duplicates, personal data, packing. All stages but the last
return the columns of their input; ``n_chars`` follows a changed text. Nulls, empty and repeated rows
and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilotlab.llm import jaccard, packing, pii, quality, templates
from pilotlab.llm.text import SPACES
from pilotlab.sources.tables import cut_lineage, drop_stages, stage_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}  # by application: what the last stage stored on its way


def _own_tables(stage: Stage) -> Stage:
    """A stage that first removes what the one before stored on its way, whose result has been written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = spark.sparkContext.applicationId
        drop_stages(spark, _left.pop(name, []))
        with stage_scope() as made:
            out = stage(spark, docs, sf_dir)
        _left[name] = made
        return out

    return run_stage


def _counted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of ``before``, with ``n_chars`` of the text as it is now."""
    if "n_chars" in before.columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text").cast(before.schema["n_chars"].dataType), "n_chars"))
    return docs.select(*before.columns)


@_own_tables
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from ``labels``."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_own_tables
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of earlier ones; a document of which no word is left goes."""
    cut = templates.drop_recurring(docs)
    emptied = (F.col("n_dropped") > 0) & (F.length(F.btrim("text", F.lit(SPACES))) == 0)
    return _counted(cut.where(~emptied), docs)


@_own_tables
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.representatives(docs)


@_own_tables
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets."""
    return _counted(pii.redact(docs), docs)


@_own_tables
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences in curve order, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", pack),
]
# The learned decision list, the trees and the tokenizer have no SQL form; tests/llm/test_pipeline.py
# compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what each returns is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        with stage_scope() as made:
            docs = cut_lineage(stage(spark, docs, sf_dir), "zstd")
        drop_stages(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
