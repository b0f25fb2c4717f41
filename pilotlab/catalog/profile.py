"""Queries of the profiling operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import id_is_valid
from ..operators import ordering, profile
from ..operators.skew import spread_join
from ..sources import testviews as tv
from .common import CHECK_DIGIT, load, micros, rounded


def table_shape(spark: SparkSession, sf: str) -> DataFrame:
    customer, orders = load(spark, sf, "customer"), load(spark, sf, "orders")
    return profile.table_shape(customer, "customer").unionByName(profile.table_shape(orders, "orders"))


# Column types of two test tables.
_SHAPES = {
    "customer": ["c_custkey bigint", "c_name string", "c_nationkey int", "c_acctbal double", "c_mktsegment string"],
    "orders": ["o_orderkey bigint", "o_custkey bigint", "o_orderstatus string", "o_totalprice double",
               "o_orderdate timestamp_ntz", "o_orderpriority string"],
}
_SQL_SHAPE = "\nUNION ALL ".join(
    f"""SELECT '{t}' AS "table", CAST({i} AS BIGINT) AS position, '{c.split()[0]}' AS "column",
  '{c.split()[1]}' AS dtype, count(*) AS n_rows, CAST({len(columns)} AS BIGINT) AS n_columns FROM {t}"""
    for t, columns in _SHAPES.items() for i, c in enumerate(columns)
)


def schema_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Date, text and client columns picked from each table's schema, with non-null counts."""
    out = None
    for table in ("customer", "orders", "lineitem"):
        df = load(spark, sf, table)
        picked = {
            "date": profile.date_columns(df.schema),
            "text": profile.text_columns(df.schema),
            "key": profile.columns_named(df.schema, "custkey", "orderkey")[:1],
        }
        rows = [(role, c) for role, columns in picked.items() for c in columns]
        part = df.agg(*[F.count(F.col(c)).alias(f"{r}_{c}") for r, c in rows]).select(F.inline(F.array(*[
            F.struct(F.lit(table).alias("table"), F.lit(r).alias("role"), F.lit(c).alias("column"),
                     F.col(f"{r}_{c}").alias("n"))
            for r, c in rows
        ])))
        out = part if out is None else out.unionByName(part)
    return out


_CHOSEN = {
    "customer": [("text", "c_name"), ("text", "c_mktsegment"), ("key", "c_custkey")],
    "orders": [("date", "o_orderdate"), ("text", "o_orderstatus"), ("text", "o_orderpriority"), ("key", "o_orderkey")],
    "lineitem": [("date", "l_shipdate"), ("text", "l_returnflag"), ("text", "l_linestatus"), ("key", "l_orderkey")],
}
_SQL_CHOICE = "\nUNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{r}' AS role, '{c}' AS "column", count({c}) AS n FROM {t}"""
    for t, rows in _CHOSEN.items() for r, c in rows
)


def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    card = profile.null_profile(tv.view(spark, sf, "card")).withColumn("table", F.lit("card"))
    contact = profile.null_profile(tv.view(spark, sf, "contact")).withColumn("table", F.lit("contact"))
    return card.unionByName(contact)


_SQL_NULLS = "\nUNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls,
  round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2) AS pct FROM {tv.oracle(t)}
  HAVING count(*) FILTER ({c} IS NULL) > 0"""
    for t, c in (("card", "activated_ts"), ("card", "client_id"), ("contact", "responded"), ("contact", "campaign"))
)


def dup_count(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats among documents and conversation turns once their ids are left out."""
    documents = load(spark, sf, "documents").select("text", "lang", "source")
    turns = load(spark, sf, "conversations").select("role", "text")
    return (
        profile.duplicate_count(documents).withColumn("table", F.lit("documents"))
        .unionByName(profile.duplicate_count(turns).withColumn("table", F.lit("conversations")))
    )


_SQL_DUPS = """SELECT 'documents' AS "table", (SELECT count(*) FROM documents) - (SELECT count(*) FROM
    (SELECT DISTINCT text, lang, source FROM documents)) AS duplicates
UNION ALL SELECT 'conversations', (SELECT count(*) FROM conversations) - (SELECT count(*) FROM
    (SELECT DISTINCT role, text FROM conversations))"""


def cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return profile.cardinality(load(spark, sf, "orders").join(
        load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )).select("column", "n_distinct", "high_cardinality",
              F.coalesce(F.array_join("values", "|"), F.lit("")).alias("listed"))


_SQL_CARDINALITY = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) > 30 AS high_cardinality,
  CASE WHEN count(DISTINCT {c}) <= 30 THEN string_agg(DISTINCT {c}, '|' ORDER BY {c}) ELSE '' END AS listed
FROM orders JOIN customer ON o_custkey = c_custkey"""
    for c in ("o_orderstatus", "o_orderpriority", "c_name", "c_mktsegment")
)


def crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return profile.crosstab_nulls(tv.view(spark, sf, "card"), "card_type", "activated_ts")


def null_rate_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rates = profile.null_rate_by_group(tv.view(spark, sf, "contact"), "campaign", "responded")
    return rounded(rates, {"pct_null": 6})


def key_check(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select(
        "l_orderkey", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("line_key")
    )
    return profile.key_check(load(spark, sf, "orders"), ["o_orderkey", "o_custkey"]).unionByName(
        profile.key_check(lines, ["l_orderkey", "line_key"])
    )


def _key_sql(table: str, name: str, expression: str) -> str:
    return f"""SELECT '{name}' AS "key", count(*) AS n_values, count(*) FILTER (n > 1) AS repeated_values,
  CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_covered, count(*) FILTER (n > 1) = 0 AS is_unique
FROM (SELECT {expression} AS k, count(*) AS n FROM {table} GROUP BY 1)"""


_SQL_KEYS = "\nUNION ALL ".join([
    _key_sql("orders", "o_orderkey", "o_orderkey"),
    _key_sql("orders", "o_custkey", "o_custkey"),
    _key_sql("lineitem", "l_orderkey", "l_orderkey"),
    _key_sql("lineitem", "line_key", "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"),
])


def first_validity_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Validity of the first client per shared id: several clients hold each of the ids."""
    clients = tv.view(spark, sf, "client").withColumn(
        "national_id", F.expr("CAST(1710000000 + (client_id % 400) * 97 AS STRING)")
    )
    return profile.first_by_key(
        clients.withColumn("valid", id_is_valid(F.col("national_id"))), "national_id", F.col("valid"), "client_id"
    )


def first_city_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """City of the client registered first under each shared id. Cities differ within an id, and days tie."""
    clients = tv.view(spark, sf, "client").withColumn("national_id", F.expr("CAST(client_id % 40 AS STRING)"))
    clients = clients.withColumn("registered_month", F.date_trunc("month", "registered_ts"))
    return profile.first_by_key(clients, "national_id", F.col("city"), "registered_month")


_SQL_FIRST_CITY = f"""SELECT CAST(client_id % 40 AS VARCHAR) AS national_id,
  first(city ORDER BY date_trunc('month', registered_ts), city) AS first_value FROM {tv.oracle('client')} GROUP BY 1"""


_SQL_FIRST = f"""SELECT national_id, {CHECK_DIGIT} AS first_value
FROM (SELECT DISTINCT CAST(1710000000 + (c_custkey % 400) * 97 AS VARCHAR) AS national_id FROM customer)"""


def fk_report(spark: SparkSession, sf: str) -> DataFrame:
    customer, orders = load(spark, sf, "customer"), load(spark, sf, "orders")
    lineitem, supplier = load(spark, sf, "lineitem"), load(spark, sf, "supplier")
    shifted = orders.withColumn("o_custkey", F.expr(
        "CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1000000 WHEN o_orderkey % 13 <> 0 THEN o_custkey END"
    ))
    report = profile.foreign_key_report([
        ("orders -> customer", shifted, "o_custkey", customer, "c_custkey"),
        ("lineitem -> orders", lineitem, "l_orderkey", orders, "o_orderkey"),
        ("lineitem -> supplier", lineitem, "l_suppkey", supplier, "s_suppkey"),
        ("events -> customer", load(spark, sf, "events"), "user_id", customer, "c_custkey"),
    ])
    return rounded(report, {"pct": 6})


def _fk_sql(name: str, child: str, key: str, master: str, master_key: str) -> str:
    return f"""SELECT '{name}' AS relation, count(*) AS ids, count(*) FILTER (m.k IS NULL) AS orphans,
  round(count(*) FILTER (m.k IS NULL) * 100.0 / count(*), 6) AS pct
FROM (SELECT DISTINCT {key} AS k FROM {child} WHERE {key} IS NOT NULL) c
LEFT JOIN (SELECT DISTINCT {master_key} AS k FROM {master}) m ON c.k = m.k"""


_SQL_FK = "\nUNION ALL ".join([
    _fk_sql("orders -> customer", """(SELECT CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1000000
        WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS o_custkey FROM orders)""", "o_custkey", "customer", "c_custkey"),
    _fk_sql("lineitem -> orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    _fk_sql("lineitem -> supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    _fk_sql("events -> customer", "events", "user_id", "customer", "c_custkey"),
])


def mix_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Transaction types of clients with an activated physical card against the others."""
    owners = tv.view(spark, sf, "card").where("card_type = 'physical' AND activated_ts IS NOT NULL")
    mix = profile.mix_by_ownership(
        tv.view(spark, sf, "tx"), "client_id", "tx_type", owners, ["ts", "tx_type", "client_id"]
    )
    return rounded(mix, {"share": 6})


_SQL_MIX = f"""WITH marked AS (SELECT tx_type, client_id IN (SELECT client_id FROM {tv.oracle('card')}
    WHERE card_type = 'physical' AND activated_ts IS NOT NULL) AS owner FROM {tv.oracle('tx')})
SELECT owner, tx_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY owner), 6) AS share
FROM marked GROUP BY owner, tx_type"""


def category_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.category_shares(load(spark, sf, "events"), ["event_type"]), {"share": 6})


def distribution_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = ordering.describe(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(summary, {c: 4 for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


def describe_sql(source: str, columns: list[str], digits: int = 4) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), {digits}) AS mean,
  round(stddev_samp({c}), {digits}) AS std, round(CAST(min({c}) AS DOUBLE), {digits}) AS min,
  round(quantile_cont({c}, 0.25), {digits}) AS q25, round(quantile_cont({c}, 0.5), {digits}) AS q50,
  round(quantile_cont({c}, 0.75), {digits}) AS q75, round(CAST(max({c}) AS DOUBLE), {digits}) AS max FROM {source}"""
        for c in columns
    )


def mode_by_group(spark: SparkSession, sf: str) -> DataFrame:
    clients = tv.view(spark, sf, "client").select("client_id", "city")
    events = spread_join(tv.view(spark, sf, "tx"), clients, "client_id", ["l_orderkey", "l_linenumber"], "inner")
    return profile.mode_by_group(events, "city", "tx_type")


_SQL_MODE = f"""SELECT city, tx_type, n FROM (SELECT city, tx_type, count(*) AS n,
    row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, tx_type) AS place
  FROM {tv.oracle('tx')} t JOIN {tv.oracle('client')} c USING (client_id) GROUP BY city, tx_type) WHERE place = 1"""


def bucketed_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles by the way taken for large tables."""
    lines = load(spark, sf, "lineitem")
    columns = {c: F.col(c) for c in ("l_extendedprice", "l_quantity", "l_discount")}
    found = ordering.exact_quantiles(lines, columns, [0.0, 0.01, 0.5, 0.9, 1.0])
    return rounded(found, {"value": 4})


_SQL_QUANTILES = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS variable, CAST({p} AS DOUBLE) AS p, round(quantile_cont({c}, {p}), 4) AS value FROM lineitem"""
    for c in ("l_extendedprice", "l_quantity", "l_discount") for p in (0.0, 0.01, 0.5, 0.9, 1.0)
)


def running_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines cheaper than each price: the bucketed running count behind ranks and quantiles."""
    runs = ordering.value_runs(load(spark, sf, "lineitem"), {"price": F.col("l_extendedprice")})
    return ordering.with_rows_before(runs).select(
        F.round("value", 2).alias("price"), "n", F.col("before").cast("bigint").alias("before")
    )


_SQL_RUNNING = """SELECT round(l_extendedprice, 2) AS price, count(*) AS n,
  CAST(coalesce(sum(count(*)) OVER (ORDER BY l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS BIGINT) AS before FROM lineitem GROUP BY l_extendedprice"""


def event_span(spark: SparkSession, sf: str) -> DataFrame:
    """First and last event per type."""
    return load(spark, sf, "events").groupBy("event_type").agg(
        micros(F.min("ts")).alias("first_us"), micros(F.max("ts")).alias("last_us")
    )


QUERIES = {
    "table_shape": (table_shape, _SQL_SHAPE),
    "schema_choice": (schema_choice, _SQL_CHOICE),
    "null_profile": (null_profile, _SQL_NULLS),
    "dup_count": (dup_count, _SQL_DUPS),
    "cardinality": (cardinality, _SQL_CARDINALITY),
    "crosstab": (crosstab, f"""SELECT card_type, count(activated_ts) AS present,
        count(*) - count(activated_ts) AS missing FROM {tv.oracle('card')} GROUP BY card_type"""),
    "null_rate_by_group": (null_rate_by_group, f"""SELECT campaign,
        round(avg(CASE WHEN responded IS NULL THEN 100.0 ELSE 0.0 END), 6) AS pct_null
        FROM {tv.oracle('contact')} GROUP BY campaign"""),
    "key_check": (key_check, _SQL_KEYS),
    "first_city_by_key": (first_city_by_key, _SQL_FIRST_CITY),
    "first_validity_by_key": (first_validity_by_key, _SQL_FIRST),
    "fk_report": (fk_report, _SQL_FK),
    "mix_by_group": (mix_by_group, _SQL_MIX),
    "category_distribution": (category_distribution, """SELECT event_type, count(*) AS n,
        round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type"""),
    "distribution_summary": (distribution_summary,
                             describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"])),
    "mode_by_group": (mode_by_group, _SQL_MODE),
    "running_counts": (running_counts, _SQL_RUNNING),
    "bucketed_quantiles": (bucketed_quantiles, _SQL_QUANTILES),
    "event_span": (event_span, """SELECT event_type, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
        FROM events GROUP BY event_type"""),
}
