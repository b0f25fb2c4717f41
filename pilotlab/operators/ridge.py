"""Ridge regression with an unpenalised intercept, and the T-learner built on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import FeatureColumns
from .gram import LinearModel, Products, Terms, fit, pivots, sums_by_group
from .ordering import exact_quantiles


# Widest table of the normal-equation solver.
NORMAL_FEATURES = 4096


def fit_ridge(df: DataFrame, label: str, alpha: float = 1.0, features: str = "features") -> LinearRegressionModel:
    """Minimises ``sum of squared errors + alpha * |coefficients|^2``.

    The normal-equation solver sums the Gram matrix in one pass. It scales the penalty by the label's
    deviation and divides the loss by the row count, hence the ``regParam``. It takes up to
    ``NORMAL_FEATURES`` features; wider tables go through the iterative solver with the same penalty.
    """
    first = df.select(features).first()
    wide = first is not None and first[0].size > NORMAL_FEATURES
    size = df.agg(F.count("*").alias("n"), F.stddev_pop(label).alias("deviation")).first()
    return LinearRegression(
        featuresCol=features, labelCol=label, standardization=False,
        solver="l-bfgs" if wide else "normal", maxIter=1000, tol=1e-12,
        regParam=alpha * (size["deviation"] or 0.0) / size["n"],
    ).fit(df)


def holdout(key: str, seed: int, percent: int = 20) -> Column:
    """True for about ``percent`` of the keys; depends on the key's text alone, not on partitioning.

    The first 32 bits of an MD5, which other engines have as well.
    """
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % 100 < percent


@dataclass(frozen=True)
class ArmModel:
    """One arm's model per outcome."""

    outcomes: dict[str, LinearModel]

    def predict(self, df: DataFrame, outcome: str, output: str) -> DataFrame:
        return df.withColumn(output, self.outcomes[outcome].expression())


@dataclass(frozen=True)
class TLearner:
    """``r2``: arm, outcome, R² on the held-out rows. ``residual``: largest error of a normal equation of the
    final models, as a share of its largest term."""

    control: ArmModel
    treated: ArmModel
    r2: DataFrame
    residual: float

    def effect(self, treated: DataFrame, outcome: str, actual: str | None = None) -> DataFrame:
        """Adds ``effect``: the actual outcome minus what the control model expects."""
        expected = self.control.predict(treated, outcome, "expected")
        return expected.withColumn("effect", F.col(actual or outcome) - F.col("expected"))

    def conditional_effect(self, df: DataFrame, outcome: str) -> DataFrame:
        """Adds ``cate``: the treated model's prediction minus the control model's."""
        both = self.treated.predict(self.control.predict(df, outcome, "_if_control"), outcome, "_if_treated")
        return both.withColumn("cate", F.col("_if_treated") - F.col("_if_control")).drop("_if_control", "_if_treated")


def fit_t_learner(
    base: DataFrame,
    arm: str,
    key: str,
    columns: FeatureColumns,
    outcomes: list[str],
    alpha: float = 1.0,
    seed: int = 42,
) -> TLearner:
    """A model per arm and outcome on all rows of the arm, with the R² of a held-out fifth.

    One scan adds up the products of all terms per arm and part; the models of the training rows and of
    all rows, and the errors on the held-out rows, follow from those sums. Medians, which no sums
    give, come from ``exact_quantiles`` over the same groups. Rows of no arm or with a null outcome take
    no part; an arm without training rows is an error. The jobs run before this returns.
    """
    held = F.coalesce(holdout(key, seed), F.lit(False))
    known = base.where(F.col(arm).isin(0, 1)).dropna(subset=list(outcomes))
    terms = Terms(columns, tuple(outcomes), pivots(known, columns, outcomes))
    # Medians of four overlapping sets: 0 and 1 all rows of an arm, 2 and 3 its training rows.
    sets = F.array_compact(F.array(F.col(arm).cast("int"), F.when(~held, F.col(arm).cast("int") + 2)))
    numeric = known.select(F.explode(sets).alias("_set"), *columns.numeric)
    medians: dict[int, dict[str, float | None]] = {}
    for r in exact_quantiles(numeric, {c: F.col(c) for c in columns.numeric}, [0.5], by="_set").collect():
        medians.setdefault(r["_set"], {})[r["variable"]] = r["value"]
    parts = sums_by_group(known, F.col(arm).cast("int") * 2 + held.cast("int"), terms)
    arms, scores, residual = {}, [], 0.0
    for value, name in ((0, "control"), (1, "treated")):
        training, held_out = parts.get(2 * value), parts.get(2 * value + 1)
        if training is None:
            raise ValueError(f"no rows to learn the {name} model from")
        if held_out is not None:
            prepared, w, intercepts = fit(training, terms, medians.get(value + 2, {}), alpha)
            r2 = Products(held_out, prepared).r2(w, intercepts)
        else:
            r2 = [None] * len(outcomes)
        scores += [(name, y, score) for y, score in zip(outcomes, r2)]
        whole = training + held_out if held_out is not None else training
        prepared, w, intercepts = fit(whole, terms, medians.get(value, {}), alpha)
        products = Products(whole, prepared)
        size = np.abs(products.with_outcomes).max(initial=1.0)
        residual = max(residual, float(np.abs(products.residuals(w, intercepts, alpha)).max() / size))
        arms[name] = ArmModel({
            y: LinearModel(prepared, w[:, k], float(intercepts[k]) + terms.pivots[y]) for k, y in enumerate(outcomes)
        })
    r2 = base.sparkSession.createDataFrame(scores, "arm string, outcome string, r2 double")
    return TLearner(arms["control"], arms["treated"], r2, residual)
