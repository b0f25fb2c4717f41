"""Causal tables of any window length from one pass over the events.

Transactions are added up per client, type and day around the client's anchor. A day is 24 hours
counted from the anchor itself, so no window cuts a day and no single event has to be kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import add_days, whole_days
from ..operators.skew import aggregate_by_key, spread_join
from ..sources.tables import cut_lineage, within
from . import effect_base as eb
from . import events as ev
from .spec import EffectSpec


def daily_activity(cohort: DataFrame, tx: DataFrame, longest: int) -> DataFrame:
    """``client_id, day, tx_type, n, net_amount``: valid transactions of ``cohort(client_id, t0)`` on the days from
    ``-longest`` up to ``longest`` around the anchor.

    The anchors bound the transactions that are read. Sums are formed before the shuffle, and the rows
    of a heavy client are spread.
    """
    ends = cohort.agg(F.min("t0").alias("first"), F.max("t0").alias("last"))
    start = ends.select(add_days(F.col("first"), -longest - 1)).scalar()
    end = ends.select(add_days(F.col("last"), longest + 1)).scalar()
    near = within(ev.valid_transactions(tx), "ts", start, end).where(F.col("client_id").isNotNull())
    events = near.select("client_id", "ts", "tx_type", F.col("net_amount").cast("double").alias("net_amount"))
    joined = spread_join(events, cohort.select("client_id", "t0"), "client_id", ["ts", "tx_type", "net_amount"], "inner")
    day = whole_days(F.col("t0"), F.col("ts"))
    return (
        joined.select("client_id", day.alias("day"), "tx_type", "net_amount").where(F.col("day").between(-longest, longest - 1))
        .groupBy("client_id", "day", "tx_type").agg(F.count("*").alias("n"), F.sum("net_amount").alias("net_amount"))
    )


def window_sums(activity: DataFrame, lengths: list[int], cash_types: tuple[str, ...]) -> DataFrame:
    """``client_id, window_days`` and the sums before and after the anchor, for clients with any activity.

    Types are added up first, so the number of different ones needs no distinct aggregate.
    """
    day, n, amount = F.col("day"), F.col("n"), F.col("net_amount")
    parts = []
    for d in lengths:
        pre, post = (day >= -d) & (day < 0), (day >= 0) & (day < d)
        parts += [
            F.sum(F.when(when, value)).alias(f"{name}_{d}")
            for when, side in ((pre, "pre"), (post, "post")) for value, name in ((n, f"n_{side}"), (amount, f"amount_{side}"))
        ]
    by_type = activity.groupBy("client_id", "tx_type").agg(*parts)
    sums = []
    for d in lengths:
        before = F.coalesce(F.col(f"n_pre_{d}"), F.lit(0))
        cash = F.col("tx_type").isin(*cash_types)
        sums += [
            F.sum(before).alias(f"frequency_pre_{d}"), F.sum(f"amount_pre_{d}").alias(f"amount_pre_{d}"),
            F.count_if((before > 0) & F.col("tx_type").isNotNull()).alias(f"type_diversity_pre_{d}"),
            F.sum(F.when(cash, before).otherwise(0)).alias(f"n_cash_pre_{d}"),
            F.coalesce(F.sum(f"n_post_{d}"), F.lit(0)).alias(f"frequency_post_{d}"),
            F.sum(f"amount_post_{d}").alias(f"amount_post_{d}"),
        ]
    names = ("frequency_pre", "amount_pre", "type_diversity_pre", "n_cash_pre", "frequency_post", "amount_post")
    rows = F.array(*[
        F.struct(F.lit(d).alias("window_days"), *[F.col(f"{name}_{d}").alias(name) for name in names]) for d in lengths
    ])
    return by_type.groupBy("client_id").agg(*sums).select("client_id", F.inline(rows))


def effect_bases(
    client: DataFrame, card: DataFrame, tx: DataFrame, contact: DataFrame, lengths: list[int], spec: EffectSpec = EffectSpec()
) -> DataFrame:
    """The causal table for every window length, with ``window_days``: a row for each client and length whose
    windows lie inside the data.

    The transactions are read once for the last date and once for all lengths; contacts and cards,
    which do not depend on the length, once.
    """
    longest = max(lengths)
    last = ev.last_transaction(tx)
    anchored = eb.anchored_cohort(client, card, contact, spec)
    fits = [F.when(eb.window_fits(d, last), F.lit(d)) for d in lengths]
    cohort = cut_lineage(anchored.withColumn("_windows", F.array_compact(F.array(*fits))).where(F.size("_windows") > 0))
    sums = window_sums(daily_activity(cohort, tx, longest), lengths, spec.labels.cash_types)
    end = cohort.agg(add_days(F.max("t0"), 1)).scalar()
    stream = ev.client_events(
        tx.limit(0).withColumn("net_amount", F.lit(0.0)), within(ev.valid_contacts(contact), "contacted_ts", end=end),
        card.where((F.col("card_type") == spec.labels.virtual) & (F.col("issued_ts") < end)),
    )
    earlier = F.col("at") < F.col("t0")
    contact_hit, card_hit = (F.col("kind") == ev.CONTACT) & earlier, (F.col("kind") == ev.CARD) & earlier
    known = aggregate_by_key(
        stream, cohort, "client_id", ["t0"],
        {
            "n_contacts": F.count_if(contact_hit), "response_rate": ev.rate_where(contact_hit, F.col("responded")),
            "has_active_virtual": F.bool_or(card_hit & F.col("activated")),
            "oldest_virtual_ts": F.min(F.when(card_hit, F.col("at"))),
        },
        {"n_contacts": 0, "response_rate": 0.0, "has_active_virtual": False}, ev.SPREAD_BY,
    )
    counts = ("frequency_pre", "type_diversity_pre", "n_cash_pre", "frequency_post")
    rows = known.withColumn("window_days", F.explode("_windows")).drop("_windows")
    joined = rows.join(sums, ["client_id", "window_days"], "left").fillna(
        {**dict.fromkeys(counts, 0), "amount_pre": 0.0, "amount_post": 0.0}
    )
    return eb.outcomes_and_covariates(joined).select("window_days", *eb.EFFECT_COLUMNS)


def outcomes_by_window(bases: DataFrame) -> DataFrame:
    """``window_days, treated, n`` and mean outcomes: how far the measured change depends on the length."""
    return bases.groupBy("window_days", "treated").agg(
        F.count("*").alias("n"), F.avg("y_frequency").alias("y_frequency"), F.avg("y_amount").alias("y_amount")
    )
