"""Causal table: pilot clients with outcomes before and after an anchor date, and covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import add_days, whole_days
from ..operators.skew import aggregate_by_key, of_keys
from ..sources.tables import cut_lineage, within
from . import events as ev
from .spec import EffectSpec

DAYS_PER_YEAR = 365.25


def pilot_cohort(client: DataFrame, contact: DataFrame, campaign: str) -> DataFrame:
    """Clients contacted in the campaign, with their first valid contact."""
    first = (
        ev.valid_contacts(contact).where((F.col("campaign") == campaign) & F.col("client_id").isNotNull())
        .groupBy("client_id").agg(F.min("contacted_ts").alias("first_contact_ts"))
    )
    return client.join(first, "client_id")


def first_activation(card: DataFrame, physical: str) -> DataFrame:
    return (
        ev.activated_physical(card, physical).where(F.col("client_id").isNotNull())
        .groupBy("client_id").agg(F.min("activated_ts").alias("first_activation_ts"))
    )


def with_arms(cohort: DataFrame, activation: DataFrame) -> DataFrame:
    """Adds ``active_before`` and ``treated`` to the cohort, nobody dropped yet."""
    activated, contacted = F.col("first_activation_ts"), F.col("first_contact_ts")
    return cohort.join(activation, "client_id", "left").withColumns({
        "active_before": F.coalesce(activated < contacted, F.lit(False)),
        "treated": activated.isNotNull().cast("int"),
    })


def arm_sizes(arms: DataFrame) -> DataFrame:
    """``cohort, active_before, treated, control`` counts in one row."""
    kept = ~F.col("active_before")
    return arms.agg(
        F.count("*").alias("cohort"),
        F.count_if(F.col("active_before")).alias("active_before"),
        F.count_if(kept & (F.col("treated") == 1)).alias("treated"),
        F.count_if(kept & (F.col("treated") == 0)).alias("control"),
    )


def anchored(arms: DataFrame) -> DataFrame:
    """Drops clients active before contact and adds the anchor ``t0``.

    A treated client's anchor is the activation, a control's is the contact plus the median whole days
    from contact to activation among the treated. Whole days have few distinct values, which bounds
    the state of the exact median.
    """
    kept = arms.where(~F.col("active_before"))
    delay = whole_days(F.col("first_contact_ts"), F.col("first_activation_ts"))
    median_delay = kept.where("treated = 1").agg(F.median(delay)).scalar()
    return kept.withColumn(
        "t0", F.coalesce("first_activation_ts", add_days(F.col("first_contact_ts"), median_delay))
    )


def data_range(tx: DataFrame) -> DataFrame:
    """First and last valid transaction."""
    return ev.valid(tx, "flag_orphan_client", "flag_future").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def window_fits(days: int, last: Column) -> Column:
    before = add_days(F.col("t0"), -days) >= F.col("registered_ts")
    after = add_days(F.col("t0"), days) <= last
    return F.coalesce(before & after, F.lit(False))


def window_sensitivity(cohort: DataFrame, tx: DataFrame, candidates: list[int]) -> DataFrame:
    """Clients whose windows before and after the anchor fit, per window length, in one aggregate."""
    last = ev.last_transaction(tx)
    counts = cohort.agg(
        F.count("*").alias("n_clients"),
        *[F.count_if(window_fits(d, last)).alias(f"d{d}") for d in candidates],
    )
    return counts.select(F.inline(F.array(*[
        F.struct(
            F.lit(d).cast("bigint").alias("window_days"),
            F.col(f"d{d}").alias("n_valid"),
            "n_clients",
            F.coalesce(F.try_divide(F.col(f"d{d}") * 100.0, F.col("n_clients")), F.lit(0.0)).alias("pct"),
        )
        for d in candidates
    ])))


EFFECT_COLUMNS = (
    "client_id", "treated", "t0", "y_frequency", "y_amount", "age_years", "city",
    "acquisition_channel", "tenure_days", "frequency_pre", "amount_pre", "type_diversity_pre",
    "cash_share_pre", "n_contacts", "response_rate", "has_active_virtual", "virtual_card_days",
    "id_valid",
)


def anchored_cohort(
    client: DataFrame, card: DataFrame, contact: DataFrame, spec: EffectSpec = EffectSpec()
) -> DataFrame:
    cohort = pilot_cohort(client, contact, spec.campaign)
    return anchored(with_arms(cohort, first_activation(card, spec.labels.physical)))


def window_aggregates(
    client: DataFrame,
    card: DataFrame,
    tx: DataFrame,
    contact: DataFrame,
    spec: EffectSpec = EffectSpec(),
    only_valid: bool = False,
) -> DataFrame:
    """Every cohort client with its aggregates around the anchor, or only those whose window is valid.

    For the latter the anchors bound the times of the events that are read.
    """
    last = ev.last_transaction(tx)
    cohort = anchored_cohort(client, card, contact, spec).withColumn(
        "window_valid", window_fits(spec.window_days, last)
    )
    cohort = cut_lineage(cohort.where("window_valid") if only_valid else cohort)
    if only_valid:
        ends = cohort.agg(F.min("t0").alias("first"), F.max("t0").alias("last"))
        # Bare scalar subqueries, which are pushed into the scans.
        start = ends.select(add_days(F.col("first"), -spec.window_days - 1)).scalar()
        end = ends.select(add_days(F.col("last"), spec.window_days + 1)).scalar()
        tx = within(tx, "ts", start, end)
        contact = within(contact, "contacted_ts", end=end)
        card = card.where(F.col("issued_ts") < end)
    tx, contact, card = (of_keys(df, cohort, "client_id") for df in (tx, contact, card))
    # The card state before the anchor uses all virtual cards, flagged ones included.
    stream = ev.client_events(
        ev.valid_transactions(tx), ev.valid_contacts(contact),
        card.where(F.col("card_type") == spec.labels.virtual),
    )
    day = whole_days(F.col("t0"), F.col("at"))
    is_tx = F.col("kind") == ev.TX
    pre = is_tx & (day >= -spec.window_days) & (day < 0)
    post = is_tx & (day >= 0) & (day < spec.window_days)
    earlier = F.col("at") < F.col("t0")
    contact_hit = (F.col("kind") == ev.CONTACT) & earlier
    card_hit = (F.col("kind") == ev.CARD) & earlier
    net, tx_type = F.col("net_amount"), F.col("tx_type")
    aggregates = {
        "frequency_pre": F.count_if(pre),
        "amount_pre": ev.sum_where(pre, net),
        "type_diversity_pre": ev.distinct_where(pre, tx_type),
        "n_cash_pre": F.count_if(pre & tx_type.isin(*spec.labels.cash_types)),
        "frequency_post": F.count_if(post),
        "amount_post": ev.sum_where(post, net),
        "n_contacts": F.count_if(contact_hit),
        "response_rate": ev.rate_where(contact_hit, F.col("responded")),
        "has_active_virtual": F.bool_or(card_hit & F.col("activated")),
        "oldest_virtual_ts": F.min(F.when(card_hit, F.col("at"))),
    }
    counts = ("frequency_pre", "type_diversity_pre", "n_cash_pre", "frequency_post", "n_contacts")
    defaults = {
        **dict.fromkeys(counts, 0), "amount_pre": 0.0, "amount_post": 0.0, "response_rate": 0.0,
        "has_active_virtual": False,
    }
    return aggregate_by_key(stream, cohort, "client_id", ["t0"], aggregates, defaults, ev.SPREAD_BY)


def outcomes_and_covariates(windows: DataFrame) -> DataFrame:
    """Adds what follows from the aggregates around the anchor."""
    t0 = F.col("t0")
    cash_share = ev.ratio(F.col("n_cash_pre"), F.col("frequency_pre"))
    return windows.withColumns({
        "y_frequency": (F.col("frequency_post") - F.col("frequency_pre")).cast("double"),
        "y_amount": F.col("amount_post") - F.col("amount_pre"),
        "cash_share_pre": F.coalesce(cash_share, F.lit(0.0)),
        "age_years": whole_days(F.col("birth_ts"), t0) / DAYS_PER_YEAR,
        "tenure_days": whole_days(F.col("registered_ts"), t0),
        "virtual_card_days": F.coalesce(whole_days(F.col("oldest_virtual_ts"), t0), F.lit(0)),
        "id_valid": ~F.col("flag_invalid_id"),
    })


def effect_base(
    client: DataFrame,
    card: DataFrame,
    tx: DataFrame,
    contact: DataFrame,
    spec: EffectSpec = EffectSpec(),
) -> DataFrame:
    """The eighteen columns of the causal table, for clients with valid windows."""
    windows = window_aggregates(client, card, tx, contact, spec, only_valid=True)
    return outcomes_and_covariates(windows).select(*EFFECT_COLUMNS)
