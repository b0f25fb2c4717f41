"""Client, card, transaction and contact views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flags
from .tables import prepare

PILOT = "signup"
PHYSICAL, VIRTUAL = "physical", "virtual"
CASH_TYPES = ("1-URGENT", "2-HIGH")
AS_OF = "2001-01-01 00:00:00"

# The same text runs in DuckDB, with TIMESTAMP for TIMESTAMP_NTZ.
CLIENT = """
SELECT c.c_custkey AS client_id, n.n_name AS city, c.c_mktsegment AS acquisition_channel,
       CAST('1950-01-01' AS TIMESTAMP_NTZ)
         + CAST((c.c_custkey * 7919) % 11000 AS INT) * INTERVAL '1' DAY AS birth_ts,
       CAST('1994-06-01' AS TIMESTAMP_NTZ)
         + CAST((c.c_custkey * 37) % 600 AS INT) * INTERVAL '1' DAY AS registered_ts,
       CAST(1710000000 + c.c_custkey * 97 AS {string}) AS national_id
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""
CARD = """
SELECT o_orderkey AS card_id, o_custkey AS client_id,
       CASE WHEN o_orderkey % 12 = 0 THEN 'physical' ELSE 'virtual' END AS card_type,
       o_orderdate AS issued_ts,
       CASE WHEN o_orderkey % 5 <> 0
            THEN o_orderdate + CAST((o_orderkey * 13) % 40 - 5 AS INT) * INTERVAL '1' DAY END AS activated_ts
FROM {orders}
"""
TX = """
SELECT l.l_orderkey, l.l_linenumber, o.o_custkey AS client_id, l.l_shipdate AS ts,
       o.o_orderpriority AS tx_type, l.l_extendedprice AS amount,
       (l.l_returnflag = 'R') AS is_refund, l.l_suppkey AS merchant_code
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""
CONTACT = """
SELECT event_id, user_id AS client_id, event_type AS campaign,
       ts - INTERVAL '10000' DAY AS contacted_ts,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value > 20 END AS responded
FROM {events}
"""
VIEWS = {"client": CLIENT, "card": CARD, "tx": TX, "contact": CONTACT}
_TABLES = ("customer", "nation", "orders", "lineitem", "events")


def oracle(view: str) -> str:
    """The view's text for DuckDB, in brackets."""
    text = VIEWS[view].format(string="VARCHAR", **{t: t for t in _TABLES})
    return f"({text.replace('TIMESTAMP_NTZ', 'TIMESTAMP')})"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names = [t for t in _TABLES if "{" + t + "}" in VIEWS[name]]
    frames = {t: load(spark, sf_dir, t) for t in names}
    return spark.sql(VIEWS[name].replace("{string}", "STRING"), **frames)


def trusted(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four views with every business-rule flag."""
    client, card, tx, contact = (view(spark, sf_dir, n) for n in ("client", "card", "tx", "contact"))
    future = F.lit("2005-01-01 00:00:00").cast("timestamp_ntz")

    def with_orphans(df: DataFrame, spread_by: list[str]) -> DataFrame:
        return flags.flag_orphans(df, "client_id", client, "client_id", "flag_orphan_client", True, spread_by)

    return {
        "client": client.withColumns({
            "flag_minor": flags.minor_at(F.col("registered_ts"), F.col("birth_ts")),
            "flag_invalid_id": flags.invalid_id(F.col("national_id")),
        }),
        "card": with_orphans(card, ["card_id"]).withColumn(
            "flag_activation_order",
            flags.activated_before_issue(F.col("activated_ts"), F.col("issued_ts")),
        ),
        "tx": with_orphans(tx, ["l_orderkey", "l_linenumber"]).withColumn(
            "flag_future", flags.in_future(F.col("ts"), future)
        ),
        "contact": with_orphans(contact, ["event_id"]).withColumn(
            "flag_future", flags.in_future(F.col("contacted_ts"), future)
        ),
    }
