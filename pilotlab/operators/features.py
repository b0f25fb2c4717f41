"""Feature preparation as a ``PipelineModel``: impute, standardise, one-hot, assemble.

Medians are exact, deviations are population deviations of the imputed column, the first category (in
sort order) is dropped and unknown categories encode as zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..sources.bindings import MISSING_CATEGORY
from .ordering import exact_quantiles


@dataclass(frozen=True)
class FeatureColumns:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    boolean: tuple[str, ...] = ()

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.boolean]


def _moments(df: DataFrame, columns: FeatureColumns) -> Row:
    aggregates = [F.count("*").alias("rows")]
    for c in columns.numeric:
        value = F.col(c).cast("double")
        aggregates += [
            F.count(value).alias(f"n_{c}"), F.avg(value).alias(f"mean_{c}"), F.var_pop(value).alias(f"var_{c}")
        ]
    for c in columns.boolean:
        # Most frequent value, the smaller one on ties.
        aggregates.append((F.avg(F.col(c).cast("double")) > 0.5).cast("double").alias(f"mode_{c}"))
    return df.agg(*aggregates).first()


def _imputed_moments(moments: Row, column: str, median: float) -> tuple[float, float]:
    """Mean and deviation of a column after its nulls became the median."""
    present = moments[f"n_{column}"]
    missing = moments["rows"] - present
    observed_mean = moments[f"mean_{column}"] or 0.0
    mean = (present * observed_mean + missing * median) / moments["rows"]
    spread = (
        present * (moments[f"var_{column}"] or 0.0)
        + present * (observed_mean - mean) ** 2
        + missing * (median - mean) ** 2
    )
    deviation = (spread / moments["rows"]) ** 0.5
    # Floating-point noise of a constant column is no deviation.
    negligible = deviation <= 1e-12 * max(1.0, abs(mean))
    return mean, 1.0 if negligible else deviation


def _filled(column: str) -> str:
    return f"coalesce(CAST(`{column}` AS STRING), '{MISSING_CATEGORY}')"


def category_levels(df: DataFrame, column: str) -> list[str]:
    """Sorted categories, the label for missing ones included where it occurs. They are part of the model."""
    levels = df.select(F.expr(_filled(column)).alias("level")).distinct()
    return sorted(r["level"] for r in levels.collect())


def fit_features(df: DataFrame, columns: FeatureColumns, output: str = "features") -> PipelineModel:
    """Fitted preparation; the driver sees one row of statistics and the category lists."""
    medians = {
        r["variable"]: r["value"]
        for r in exact_quantiles(df, {c: F.col(c) for c in columns.numeric}, [0.5]).collect()
    }
    moments = _moments(df, columns)
    expressions, inputs = [], []
    for c in columns.numeric:
        median = medians[c] if medians[c] is not None else 0.0  # a column without numbers is all zeros
        mean, deviation = _imputed_moments(moments, c, median)
        expressions.append(
            f"(coalesce(CAST(`{c}` AS DOUBLE), {median!r}D) - {mean!r}D) / {deviation!r}D AS `_num_{c}`"
        )
        inputs.append(f"_num_{c}")
    for c in columns.categorical:
        expressions.append(f"{_filled(c)} AS `_text_{c}`")
    booleans = []
    for c in columns.boolean:
        expressions.append(f"coalesce(CAST(`{c}` AS DOUBLE), {moments[f'mode_{c}'] or 0.0!r}D) AS `_bool_{c}`")
        booleans.append(f"_bool_{c}")

    numeric_stage = SQLTransformer(statement=f"SELECT *, {', '.join(expressions)} FROM __THIS__")
    stages, staged = [numeric_stage], numeric_stage.transform(df)
    for c in columns.categorical:
        # The dropped level and unknown ones share the indexer's last slot, which the encoder drops.
        kept = category_levels(df, c)[1:]
        if not kept:
            continue
        indexer = StringIndexerModel.from_labels(
            kept, inputCol=f"_text_{c}", outputCol=f"_index_{c}", handleInvalid="keep"
        )
        staged = indexer.transform(staged)
        encoder = OneHotEncoder(inputCols=[f"_index_{c}"], outputCols=[f"_hot_{c}"], dropLast=True).fit(staged)
        staged = encoder.transform(staged)
        stages += [indexer, encoder]
        inputs.append(f"_hot_{c}")
    stages.append(VectorAssembler(inputCols=[*inputs, *booleans], outputCol=output))
    return PipelineModel(stages)


def with_features(df: DataFrame, prepared: PipelineModel, output: str = "features") -> DataFrame:
    """``df`` plus the feature vector, without the intermediate columns."""
    return prepared.transform(df).select(*df.columns, output)
