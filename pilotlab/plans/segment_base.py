"""Segmentation table: monthly behaviour of clients who never had an activated physical card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import add_days, whole_days
from ..operators.dedup import exclusion_counts
from ..operators.ordering import describe
from ..operators.skew import aggregate_by_key
from ..sources.tables import within
from . import events as ev
from .spec import SegmentSpec

DAYS_PER_YEAR = 365.25


def today(tx: DataFrame) -> Column:
    """Reference date: the last valid transaction, found once and used as a literal."""
    return ev.last_transaction(tx)


def horizon(now: Column, spec: SegmentSpec) -> Column:
    """Start of the longest possible window. As a literal it is pushed into the scans."""
    return add_days(now, -spec.window_days)


def exclusions(card: DataFrame, tx: DataFrame, contact: DataFrame) -> DataFrame:
    """Rows dropped from each table by its flags, stage by stage."""
    orphan = ("orphan client", F.col("flag_orphan_client"))
    return (
        exclusion_counts(card, "card", [orphan, ("activation before issue", F.col("flag_activation_order"))])
        .unionByName(exclusion_counts(tx, "tx", [orphan, ("future date", F.col("flag_future"))]))
        .unionByName(exclusion_counts(contact, "contact", [orphan, ("future date", F.col("flag_future"))]))
    )


def _marked_clients(client: DataFrame, card: DataFrame, now: Column, spec: SegmentSpec) -> DataFrame:
    """Clients with the three reasons to leave the population as columns."""
    owners = (
        ev.activated_physical(card, spec.labels.physical).select("client_id").distinct()
        .withColumn("_owner", F.lit(True))
    )
    tenure = whole_days(F.col("registered_ts"), now)
    return client.join(owners, "client_id", "left").withColumns({
        "_owner": F.coalesce("_owner", F.lit(False)),
        "tenure_days": tenure,
        "_too_new": ~F.coalesce(tenure >= spec.min_tenure_days, F.lit(False)),
    })


def eligibility_counts(
    client: DataFrame, card: DataFrame, tx: DataFrame, spec: SegmentSpec = SegmentSpec()
) -> DataFrame:
    marked = _marked_clients(client, card, today(tx), spec)
    return exclusion_counts(marked, "client", [
        ("has or had a physical card", F.col("_owner")),
        ("minor at registration", F.col("flag_minor")),
        ("tenure too short", F.col("_too_new")),
    ])


def eligible_clients(
    client: DataFrame, card: DataFrame, tx: DataFrame, spec: SegmentSpec = SegmentSpec(), now: Column | None = None
) -> DataFrame:
    """Eligible clients with the start and length of their observation window, which ends ``today`` if no
    ``now`` is given."""
    now = today(tx) if now is None else now
    marked = _marked_clients(client, card, now, spec)
    start = F.greatest(F.col("registered_ts"), add_days(now, -spec.window_days))
    return (
        marked.where(~F.col("_owner") & ~F.col("flag_minor") & ~F.col("_too_new"))
        .withColumn("window_start", start)
        .withColumn("observed_days", whole_days(F.col("window_start"), now))
        .withColumn("observed_months", F.col("observed_days") / spec.days_per_month)
        .withColumn("age_years", whole_days(F.col("birth_ts"), now) / DAYS_PER_YEAR)
        .select(
            "client_id", "city", "acquisition_channel", "age_years", "tenure_days",
            "window_start", "observed_days", "observed_months",
        )
    )


def window_coverage(eligible: DataFrame, spec: SegmentSpec = SegmentSpec()) -> DataFrame:
    """Distribution of the observed months, with the number of clients seen for the whole window."""
    full = eligible.agg(F.count_if(F.col("observed_days") >= spec.window_days)).scalar()
    return describe(eligible, ["observed_months"]).withColumn("n_full_window", full)


def segment_base(
    client: DataFrame,
    card: DataFrame,
    tx: DataFrame,
    contact: DataFrame,
    spec: SegmentSpec = SegmentSpec(),
) -> DataFrame:
    """One row per eligible client with its monthly rates and card state."""
    now = today(tx)
    eligible = eligible_clients(client, card, tx, spec, now)
    start = horizon(now, spec)
    virtual = ev.valid(card, "flag_orphan_client", "flag_activation_order").where(
        F.col("card_type") == spec.labels.virtual
    )
    # No window starts before the horizon, so older transactions and contacts never reach the shuffle.
    stream = ev.client_events(
        within(ev.valid_transactions(tx), "ts", start),
        within(ev.valid_contacts(contact), "contacted_ts", start),
        virtual.where(F.col("issued_ts") < now),
    )
    in_window = F.col("at") >= F.col("window_start")
    tx_hit = (F.col("kind") == ev.TX) & in_window
    contact_hit = (F.col("kind") == ev.CONTACT) & in_window
    card_hit = F.col("kind") == ev.CARD
    aggregates = {
        "n_transactions": F.count_if(tx_hit),
        "total_amount": ev.sum_where(tx_hit, F.col("net_amount")),
        "type_diversity": ev.distinct_where(tx_hit, F.col("tx_type")),
        "n_cash": F.count_if(tx_hit & F.col("tx_type").isin(*spec.labels.cash_types)),
        "n_contacts": F.count_if(contact_hit),
        "response_rate": ev.rate_where(contact_hit, F.col("responded")),
        "has_active_virtual": F.bool_or(card_hit & F.col("activated")),
        "oldest_virtual_ts": F.min(F.when(card_hit, F.col("at"))),
    }
    counts = ("n_transactions", "type_diversity", "n_cash", "n_contacts")
    defaults = {**dict.fromkeys(counts, 0), "total_amount": 0.0, "response_rate": 0.0, "has_active_virtual": False}
    months = F.col("observed_months")
    return aggregate_by_key(
        stream, eligible, "client_id", ["window_start"], aggregates, defaults, ev.SPREAD_BY
    ).withColumns({
        "monthly_frequency": ev.ratio(F.col("n_transactions"), months),
        "monthly_amount": ev.ratio(F.col("total_amount"), months),
        "monthly_contacts": ev.ratio(F.col("n_contacts"), months),
        "has_active_virtual": F.col("has_active_virtual").cast("double"),
        "virtual_card_days": F.coalesce(whole_days(F.col("oldest_virtual_ts"), now), F.lit(0)),
    })


SEGMENT_COLUMNS = (
    "client_id", "age_years", "tenure_days", "monthly_frequency", "monthly_amount", "type_diversity",
    "monthly_contacts", "response_rate", "has_active_virtual", "virtual_card_days", "city",
    "acquisition_channel",
)


def segment_features(
    client: DataFrame,
    card: DataFrame,
    tx: DataFrame,
    contact: DataFrame,
    spec: SegmentSpec = SegmentSpec(),
) -> DataFrame:
    """The twelve columns of the segmentation table."""
    return segment_base(client, card, tx, contact, spec).select(*SEGMENT_COLUMNS)


def transaction_rates(
    client: DataFrame, card: DataFrame, tx: DataFrame, spec: SegmentSpec = SegmentSpec()
) -> DataFrame:
    """Monthly frequency and net amount per eligible client, from transactions alone."""
    now = today(tx)
    eligible = eligible_clients(client, card, tx, spec, now)
    stream = ev.client_events(within(ev.valid_transactions(tx), "ts", horizon(now, spec)))
    hit = (F.col("kind") == ev.TX) & (F.col("at") >= F.col("window_start"))
    aggregates = {
        "n_transactions": F.count_if(hit),
        "total_amount": ev.sum_where(hit, F.col("net_amount")),
    }
    months = F.col("observed_months")
    return aggregate_by_key(
        stream, eligible, "client_id", ["window_start"], aggregates,
        {"n_transactions": 0, "total_amount": 0.0}, ev.SPREAD_BY,
    ).select(
        "client_id",
        "n_transactions",
        ev.ratio(F.col("n_transactions"), months).alias("monthly_frequency"),
        ev.ratio(F.col("total_amount"), months).alias("monthly_amount"),
    )
