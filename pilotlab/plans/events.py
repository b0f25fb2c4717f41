"""Transactions, contacts and cards as one event stream per client.

All per-client aggregates of a modelling table come from one join of this stream with the client
frame and one grouping, instead of a join and a grouping per source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import newest

TX, CONTACT, CARD = "tx", "contact", "card"


def valid(df: DataFrame, *flags: str) -> DataFrame:
    """Rows with none of the flags set."""
    condition = F.lit(True)
    for f in flags:
        condition = condition & ~F.col(f)
    return df.where(condition)


def valid_transactions(tx: DataFrame) -> DataFrame:
    """Transactions of known clients that are not in the future, with refunds as negative amounts."""
    refund = F.coalesce("is_refund", F.lit(False))
    return valid(tx, "flag_orphan_client", "flag_future").withColumn(
        "net_amount", F.when(refund, -F.col("amount")).otherwise(F.col("amount"))
    )


def last_transaction(tx: DataFrame) -> Column:
    """Time of the last valid transaction, as a literal. It runs two jobs, see ``newest``."""
    return newest(valid(tx, "flag_orphan_client", "flag_future"), "ts", ["ts", "amount"])


def valid_contacts(contact: DataFrame) -> DataFrame:
    return valid(contact, "flag_orphan_client", "flag_future")


def activated_physical(card: DataFrame, physical: str) -> DataFrame:
    """Physical cards with a trustworthy activation date."""
    return valid(card, "flag_orphan_client", "flag_activation_order").where(
        (F.col("card_type") == physical) & F.col("activated_ts").isNotNull()
    )


def client_events(tx: DataFrame, contact: DataFrame | None = None, card: DataFrame | None = None) -> DataFrame:
    """``client_id, kind, at, tx_type, net_amount, responded, activated`` of all given sources."""
    stream = _event(tx, TX, F.col("ts"), tx_type=F.col("tx_type"), net_amount=F.col("net_amount"))
    if contact is not None:
        stream = stream.unionByName(_event(contact, CONTACT, F.col("contacted_ts"), responded=F.col("responded")))
    if card is not None:
        stream = stream.unionByName(
            _event(card, CARD, F.col("issued_ts"), activated=F.col("activated_ts").isNotNull())
        )
    return stream


def _event(df: DataFrame, kind: str, at: Column, **fields: Column) -> DataFrame:
    types = {"tx_type": "string", "net_amount": "double", "responded": "boolean", "activated": "boolean"}
    return df.where(F.col("client_id").isNotNull()).select(
        "client_id",
        F.lit(kind).alias("kind"),
        at.alias("at"),
        *[fields.get(f, F.lit(None)).cast(t).alias(f) for f, t in types.items()],
    )


SPREAD_BY = ["kind", "at", "tx_type", "net_amount", "responded", "activated"]


def sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def distinct_where(condition: Column, value: Column) -> Column:
    return F.count_distinct(F.when(condition, value))


def rate_where(condition: Column, answer: Column) -> Column:
    """Share of true answers among the non-null ones."""
    return F.avg(F.when(condition, answer.cast("double")))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is zero."""
    return F.try_divide(numerator, denominator)
