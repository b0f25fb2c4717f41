"""Parameters shared by the two modelling tables."""

from __future__ import annotations

from dataclasses import dataclass

from ..sources import bindings


@dataclass(frozen=True)
class Labels:
    physical: str = bindings.PHYSICAL
    virtual: str = bindings.VIRTUAL
    cash_types: tuple[str, ...] = bindings.CASH_TYPES


@dataclass(frozen=True)
class EffectSpec:
    labels: Labels = Labels()
    campaign: str = bindings.PILOT_CAMPAIGN
    window_days: int = 60
    tx_id: tuple[str, ...] = ("ts", "tx_type", "amount")


@dataclass(frozen=True)
class SegmentSpec:
    labels: Labels = Labels()
    window_days: int = 365
    days_per_month: float = 30.44
    min_tenure_days: int = 30
    tx_id: tuple[str, ...] = ("ts", "tx_type", "amount")


EFFECT_NUMERIC = (
    "age_years", "tenure_days", "frequency_pre", "amount_pre", "type_diversity_pre",
    "cash_share_pre", "n_contacts", "response_rate", "virtual_card_days",
)
EFFECT_BOOLEAN = ("has_active_virtual", "id_valid")
SEGMENT_NUMERIC = (
    "age_years", "tenure_days", "monthly_frequency", "monthly_amount", "type_diversity",
    "monthly_contacts", "response_rate", "virtual_card_days",
)
SEGMENT_BOOLEAN = ("has_active_virtual",)
CATEGORICAL = ("city", "acquisition_channel")
PRIORITY_COLUMNS = ("monthly_frequency", "monthly_amount", "response_rate")
