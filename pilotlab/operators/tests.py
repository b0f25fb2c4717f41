"""Tests of an effect against zero: t-test, signed ranks, bootstrap, and their summary."""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ordering import describe, exact_quantiles, value_runs, with_rows_before

# Lets the Arrow functions below run on workers that do not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIGNIFICANCE = 0.05
# Up to this many values without ties or zeros the signed-rank distribution is enumerated.
EXACT_RANKS = 50


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def signed_rank_two_sided(w: float, n: int) -> float:
    """Exact two-sided tail of the smaller rank sum of ``n`` untied values."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] += ways[:-rank].copy()
    return float(min(1.0, 2.0 * ways[: int(w) + 1].sum() / ways.sum()))


@F.pandas_udf(DoubleType())
def _t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(a) or b < 1 else t_two_sided(float(a), float(b)) for a, b in zip(t, df)
    ], dtype="float64")


@F.pandas_udf(DoubleType())
def _wilcoxon_p_value(w: pd.Series, z: pd.Series, n: pd.Series, untied: pd.Series) -> pd.Series:
    def tail(w: float, z: float, n: int, untied: bool) -> float | None:
        if untied and 0 < n <= EXACT_RANKS:
            return signed_rank_two_sided(w, int(n))
        return None if pd.isna(z) else math.erfc(abs(z) / math.sqrt(2.0))

    return pd.Series([tail(*row) for row in zip(w, z, n, untied)], dtype="float64")


def t_statistic(df: DataFrame, column: str) -> DataFrame:
    """``n, mean, t, p_t``: one-sample t-test against zero."""
    x = F.col(column).cast("double")
    moments = df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("_std")
    )
    t = F.try_divide(F.col("mean"), F.col("_std") / F.sqrt("n"))
    return moments.select("n", "mean", t.alias("t")).withColumn(
        "p_t", _t_p_value("t", (F.col("n") - 1).cast("double"))
    )


def wilcoxon_statistic(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """``n_nonzero, w_plus, w_minus, w, z, p_wilcoxon``: signed-rank test against zero.

    Zeros are dropped and ties get their average rank. Equal absolute values are combined first and
    ranks come from bucketed running counts, so no task ever sorts the whole column.
    """
    x = F.col(column).cast("double")
    nonzero = df.select(x.alias("x")).where("x IS NOT NULL AND x <> 0")
    runs = value_runs(nonzero, {"x": F.abs("x")}, n_plus=F.count_if(F.col("x") > 0))
    n, rank = F.col("n").cast("double"), F.col("before") + (F.col("n") + 1) / 2
    sums = with_rows_before(runs, buckets).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_nonzero"),
        F.coalesce(F.sum(F.col("n_plus") * rank), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum((F.col("n") - F.col("n_plus")) * rank), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(n * n * n - n), F.lit(0.0)).alias("_ties"),
    )
    zeros = df.agg(F.count_if(x == 0)).scalar()
    size = F.col("n_nonzero").cast("double")
    middle = size * (size + 1) / 4
    variance = size * (size + 1) * (2 * size + 1) / 24 - F.col("_ties") / 48
    untied = (F.col("_ties") == 0) & (zeros == 0)
    return (
        sums.withColumn("w", F.least("w_plus", "w_minus"))
        .withColumn("z", F.try_divide(F.col("w") - middle, F.sqrt(variance)))
        .withColumn("p_wilcoxon", _wilcoxon_p_value("w", "z", "n_nonzero", untied))
        .drop("_ties")
    )


# Modulus of the draws; a product of two numbers below it fits 64 bits.
PRIME = 2**31 - 1


def md5_number(text: str) -> int:
    """First 32 bits of an MD5, modulo ``PRIME``."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % PRIME


def poisson_bounds() -> list[float]:
    """Distribution function of Poisson(1) at 0 … 17."""
    total, weight, bounds = 0.0, math.exp(-1.0), []
    for k in range(18):
        total += weight
        bounds.append(total)
        weight /= k + 1
    return bounds


def bootstrap_means(
    df: DataFrame, column: str, key: str, replicates: int = 2_000, seed: int = 42
) -> DataFrame:
    """``replicate, mean``: the mean under Poisson(1) row weights, per replicate.

    A row's draw is ``(h * a + b) mod PRIME / PRIME`` with ``h`` from the MD5 of key and seed and ``a``, ``b`` from
    that of replicate and seed, so the result does not depend on partitioning. A task adds up the
    weights and weighted values of its rows and passes on one row per replicate.
    """
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    hashed = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % PRIME
    value = df.select(hashed.alias("h"), F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    a = np.array([md5_number(f"a{r}:{seed}") % (PRIME - 1) + 1 for r in range(replicates)], dtype=np.int64)
    b = np.array([md5_number(f"b{r}:{seed}") for r in range(replicates)], dtype=np.int64)
    bounds = np.array(poisson_bounds())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            h, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first in range(0, len(h), 256):
                part = slice(first, first + 256)
                draws = (h[part, None] * a + b) % PRIME / PRIME
                w = np.searchsorted(bounds, draws, side="right")
                weights += w.sum(axis=0)
                sums += x[part] @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(replicates)), pa.array(weights), pa.array(sums)], ["replicate", "w", "wx"]
        )

    return (
        value.mapInArrow(add_up, "replicate bigint, w double, wx double").groupBy("replicate")
        .agg(F.try_divide(F.sum("wx"), F.sum("w")).alias("mean"))
    )


def bootstrap_interval(
    df: DataFrame, column: str, key: str, replicates: int = 2_000, seed: int = 42, level: float = 0.95
) -> DataFrame:
    """``ci_low, ci_high``: percentile interval of the bootstrap means (``replicates`` values)."""
    tail = (1.0 - level) / 2.0
    means = bootstrap_means(df, column, key, replicates, seed)
    return means.agg(
        F.percentile("mean", F.lit(tail)).alias("ci_low"),
        F.percentile("mean", F.lit(1.0 - tail)).alias("ci_high"),
    )


def effect_summary(df: DataFrame, column: str) -> DataFrame:
    """Distribution of an effect with the share of positive values."""
    x = F.col(column).cast("double")
    positive = df.agg(F.avg((x > 0).cast("double")) * 100).scalar()
    return describe(df, [column]).withColumn("pct_positive", positive)


def effect_decision(
    df: DataFrame, column: str, key: str, replicates: int = 2_000, seed: int = 42
) -> DataFrame:
    """Summary, both tests and the interval in one row, with the two decisions."""
    joined = effect_summary(df, column)
    for part in (
        t_statistic(df, column).select("t", "p_t"),
        wilcoxon_statistic(df, column).select("w", "z", "p_wilcoxon"),
        bootstrap_interval(df, column, key, replicates, seed),
    ):
        fields = part.select(F.struct(*part.columns)).scalar()
        joined = joined.withColumn("_part", fields).select("*", "_part.*").drop("_part")
    either = (F.col("p_t") < SIGNIFICANCE) | (F.col("p_wilcoxon") < SIGNIFICANCE)
    return joined.withColumns({
        "significant": F.coalesce(either, F.lit(False)),
        "interval_excludes_zero": (F.col("ci_low") > 0) | (F.col("ci_high") < 0),
    })


def winsorize(
    df: DataFrame, column: str, output: str, low: float = 0.01, high: float = 0.99
) -> DataFrame:
    """Adds ``output``: the column held between two of its own exact quantiles."""
    quantiles = exact_quantiles(df, {column: F.col(column)}, [low, high])
    bounds = quantiles.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"))).scalar()
    held = F.least(F.greatest(F.col(column), bounds["low"]), bounds["high"])
    return df.withColumn(output, F.when(F.col(column).isNotNull(), held))
