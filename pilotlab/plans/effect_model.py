"""From the causal table to the measured effect of the pilot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.balance import category_balance, covariate_balance
from ..operators.features import FeatureColumns
from ..operators.ridge import TLearner, fit_t_learner
from ..operators.tests import effect_decision, winsorize
from ..sources.tables import cut_lineage
from . import spec

EFFECT_FEATURES = FeatureColumns(spec.EFFECT_NUMERIC, spec.CATEGORICAL, spec.EFFECT_BOOLEAN)
OUTCOMES = ("y_frequency", "y_amount")


@dataclass(frozen=True)
class EffectResult:
    balance: DataFrame
    categories: dict[str, DataFrame]
    learner: TLearner
    effects: dict[str, DataFrame]
    decisions: DataFrame


def measure_effect(
    base: DataFrame, replicates: int = 2_000, seed: int = 42, winsorize_training: bool = False
) -> EffectResult:
    """Balance, T-learner and tests for both outcomes.

    Amounts of the treated are held between their own 1% and 99% quantiles before the effect is taken.
    The control model sees raw amounts unless ``winsorize_training`` is set. The table and the effects
    are checkpointed once, since every fit and every test reads them again.
    """
    base = cut_lineage(base)
    treated, control = (base.where(F.col("treated") == arm) for arm in (1, 0))
    training = base
    if winsorize_training:
        training = winsorize(treated, "y_amount", "y_amount").unionByName(
            winsorize(control, "y_amount", "y_amount")
        )
    learner = fit_t_learner(training, "treated", "client_id", EFFECT_FEATURES, list(OUTCOMES), seed=seed)
    effects = {
        "y_frequency": learner.effect(treated, "y_frequency"),
        "y_amount": learner.effect(
            winsorize(treated, "y_amount", "y_amount_held"), "y_amount", "y_amount_held"
        ),
    }
    effects = {y: cut_lineage(e.select("client_id", "expected", "effect")) for y, e in effects.items()}
    decisions = None
    for outcome, effect in effects.items():
        row = effect_decision(effect, "effect", "client_id", replicates, seed).withColumn(
            "variable", F.lit(outcome)
        )
        decisions = row if decisions is None else decisions.unionByName(row)
    return EffectResult(
        covariate_balance(base, "treated", [*spec.EFFECT_NUMERIC, *spec.EFFECT_BOOLEAN]),
        {c: category_balance(base, "treated", c) for c in spec.CATEGORICAL},
        learner,
        effects,
        decisions,
    )
