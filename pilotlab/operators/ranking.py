"""Priority scores and the ordinal labels of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of at most five clusters, from highest to lowest priority.
PRIORITY_LABELS = ("alto_potencial", "medio_alto", "medio", "medio_bajo", "bajo_potencial")
UNKNOWN_LABEL = "desconocido"


def priority_labels(k: int) -> list[str]:
    """Labels by rank. With fewer than five clusters the list ends early at the low end."""
    return list(PRIORITY_LABELS[:k]) if k <= 5 else [f"prioridad_{i + 1}" for i in range(k)]


def population_stats(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row with ``mean`` and ``std`` (sample deviation) structs, a field per column."""
    return df.agg(
        F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).alias("mean"),
        F.struct(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in columns]).alias("std"),
    )


def z_sum(columns: tuple[str, ...], mean: dict[str, Column], std: dict[str, Column]) -> Column:
    """Sum of z-scores; a null value or a column without spread adds nothing."""
    total = F.lit(0.0)
    for c in columns:
        z = F.try_divide(F.col(c).cast("double") - mean[c], std[c])
        total = total + F.coalesce(z, F.lit(0.0))
    return total


def with_priority_score(df: DataFrame, columns: tuple[str, ...], output: str = "priority_score") -> DataFrame:
    """Adds the priority score of each row against the whole population."""
    stats = population_stats(df, columns).select(F.struct("mean", "std")).scalar()
    return df.withColumn(output, z_sum(
        columns, {c: stats["mean"][c] for c in columns}, {c: stats["std"][c] for c in columns}
    ))


def rank_clusters(df: DataFrame, cluster: str, score: str) -> DataFrame:
    """``cluster, n, mean_score, rank, segment``, highest mean score first.

    The window orders one row per cluster.
    """
    means = df.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))
    place = F.row_number().over(Window.orderBy(F.desc("mean_score"), cluster))
    k = F.count("*").over(Window.partitionBy())
    few = F.array(*[F.lit(label) for label in PRIORITY_LABELS])
    return (
        means.withColumn("rank", place).withColumn("_k", k)
        .withColumn("segment", F.when(F.col("_k") <= 5, F.get(few, F.col("rank") - 1)).otherwise(
            F.concat(F.lit("prioridad_"), F.col("rank").cast("string"))
        )).drop("_k")
    )


def label_clusters(df: DataFrame, cluster: str, score: str) -> DataFrame:
    """Adds ``segment``, the label of each row's cluster."""
    ranked = rank_clusters(df, cluster, score).select(cluster, "segment")
    return df.join(ranked, cluster, "left")
