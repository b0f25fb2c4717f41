"""Covariate balance between the two arms of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMBALANCE = 0.1


def covariate_balance(df: DataFrame, arm: str, columns: list[str]) -> DataFrame:
    """``variable, mean_treated, mean_control, smd, unbalanced`` from one aggregate.

    The difference is 0 where the pooled variance is zero or unknown. Sort by ``abs(smd)`` to show it.
    """
    aggregates = []
    for c in columns:
        for side, value in (("t", 1), ("c", 0)):
            x = F.when(F.col(arm) == value, F.col(c).cast("double"))
            aggregates += [F.avg(x).alias(f"mean_{side}_{c}"), F.var_samp(x).alias(f"var_{side}_{c}")]

    def row(c: str) -> Column:
        pooled = (F.col(f"var_t_{c}") + F.col(f"var_c_{c}")) / 2
        difference = F.col(f"mean_t_{c}") - F.col(f"mean_c_{c}")
        smd = F.when(pooled > 0, F.try_divide(difference, F.sqrt(pooled))).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(c).alias("variable"),
            F.col(f"mean_t_{c}").alias("mean_treated"),
            F.col(f"mean_c_{c}").alias("mean_control"),
            smd.alias("smd"),
        )

    return (
        df.agg(*aggregates).select(F.inline(F.array(*[row(c) for c in columns])))
        .withColumn("unbalanced", F.abs("smd") > IMBALANCE)
    )


def category_balance(df: DataFrame, arm: str, column: str) -> DataFrame:
    """Percentage of each category within either arm, one decimal; nulls are left out."""
    present = df.where(F.col(column).isNotNull())
    treated, control = F.col(arm) == 1, F.col(arm) == 0
    totals = present.agg(F.struct(F.count_if(treated).alias("t"), F.count_if(control).alias("c"))).scalar()

    def share(hit: Column, side: str) -> Column:
        return F.coalesce(F.round(F.try_divide(F.count_if(hit) * 100.0, totals[side]), 1), F.lit(0.0))

    return present.groupBy(column).agg(
        share(treated, "t").alias("pct_treated"), share(control, "c").alias("pct_control")
    )
