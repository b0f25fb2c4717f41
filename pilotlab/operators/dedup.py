"""Exact duplicates and stage-by-stage exclusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One row out of each group that agrees in every column (null equals null)."""
    return df.distinct()


def duplicate_summary(df: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """``rows_in, rows_out, removed, pct`` of dropping exact duplicates.

    With ``unique``, the stored result of ``drop_exact_duplicates``, two row counts are enough, and
    Parquet answers those from its footers. Without it the groups are counted in one pass.
    """
    if unique is None:
        groups = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
        counts = groups.agg(
            F.coalesce(F.sum("_copies"), F.lit(0)).cast("bigint").alias("rows_in"),
            F.count("*").alias("rows_out"),
        )
    else:
        rows_out = unique.agg(F.count("*")).scalar()
        counts = df.agg(F.count("*").alias("rows_in")).withColumn("rows_out", rows_out)
    removed = F.col("rows_in") - F.col("rows_out")
    return counts.select(
        "rows_in",
        "rows_out",
        removed.alias("removed"),
        F.coalesce(F.try_divide(removed * 100.0, F.col("rows_in")), F.lit(0.0)).alias("pct"),
    )


def exclusion_counts(df: DataFrame, table: str, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows dropped by each reason in turn: ``table, stage, reason, n_before, n_excluded, pct``.

    A row counts for the first reason that applies, as if the reasons were applied one after the
    other; all counts come from one aggregate.
    """
    already = F.lit(False)
    counts = [F.count("*").alias("n0")]
    for i, (_, reason) in enumerate(stages):
        hit = F.coalesce(reason, F.lit(False))
        counts.append(F.count_if(hit & ~already).alias(f"x{i}"))
        already = already | hit
    rows, before = [], F.col("n0")
    for i, (name, _) in enumerate(stages):
        excluded = F.col(f"x{i}")
        rows.append(F.struct(
            F.lit(table).alias("table"),
            F.lit(i + 1).cast("bigint").alias("stage"),
            F.lit(name).alias("reason"),
            before.alias("n_before"),
            excluded.alias("n_excluded"),
            F.coalesce(F.try_divide(excluded * 100.0, before), F.lit(0.0)).alias("pct"),
        ))
        before = before - excluded
    return df.agg(*counts).select(F.inline(F.array(*rows)))
