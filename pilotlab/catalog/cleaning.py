"""Queries of the cleaning and flag operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, numbers, text
from ..operators import cleaning, dedup, flags, profile
from ..plans import segment_base
from ..sources import testviews as tv
from .common import CHECK_DIGIT, VIEWS, days, load, micros, rounded, trusted

# --- duplicates ----------------------------------------------------------------------------------


def _repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item one to three times."""
    lines = load(spark, sf, "lineitem").withColumn("shipped_us", micros("l_shipdate")).drop("l_shipdate")
    copies = F.sequence(F.lit(0), F.col("l_linenumber") % 3)
    return lines.select("*", F.explode(copies).alias("_copy")).drop("_copy")


def dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.drop_exact_duplicates(_repeated_lines(spark, sf))


def dedup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dedup.duplicate_summary(_repeated_lines(spark, sf)), {"pct": 6})


def dedup_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = load(spark, sf, "documents").select("text", "lang", "source")
    unique = dedup.drop_exact_duplicates(documents)
    return unique.select(F.md5("text").alias("text_md5"), "lang", "source")


_SQL_DEDUP_COUNTS = """WITH lines AS (SELECT lineitem.*, r.i AS copy FROM lineitem, LATERAL
    (SELECT unnest(range(0, l_linenumber % 3 + 1)) AS i) r),
n AS (SELECT count(*) AS a FROM lines),
u AS (SELECT count(*) AS b FROM (SELECT DISTINCT * EXCLUDE (copy) FROM lines))
SELECT CAST(a AS BIGINT) AS rows_in, CAST(b AS BIGINT) AS rows_out, CAST(a - b AS BIGINT) AS removed,
  round((a - b) * 100.0 / a, 6) AS pct FROM n, u"""

# --- text ----------------------------------------------------------------------------------------


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("clean"))


_SQL_BLANKS = r"[\s\x0B\x1c-\x1f\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_SQL_NORMALIZE = rf"""WITH t AS (SELECT doc_id,
    trim(regexp_replace(replace(lower(text), '_', ' '), '{_SQL_BLANKS}', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN s NOT IN ('n/a', 'na', 'n\a', 'null', 'none', 'nan', '-', 's/d', 'sin dato', '')
  THEN s END AS clean FROM t"""

# Order priorities wrapped in noise, or a placeholder, by key.
_NOISY_PRIORITY = r"""CASE o_orderkey % 10
    WHEN 0 THEN 'N/A' WHEN 1 THEN ' null ' WHEN 2 THEN '-' WHEN 3 THEN 'Sin_Dato' WHEN 4 THEN ''
    WHEN 5 THEN concat('  ', upper(o_orderpriority), chr(9))
    WHEN 6 THEN concat('_', o_orderpriority, '_') WHEN 7 THEN replace(o_orderpriority, ' ', '   ')
    WHEN 8 THEN CAST(NULL AS {string}) ELSE o_orderpriority END"""


def normalize_categories(spark: SparkSession, sf: str) -> DataFrame:
    noisy = F.expr(_NOISY_PRIORITY.replace("{string}", "STRING"))
    return load(spark, sf, "orders").select("o_orderkey", text.normalize_text(noisy).alias("priority"))


_SQL_NORMALIZE_CATEGORIES = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (5, 6, 7, 9)
    THEN lower(o_orderpriority) END AS priority FROM orders"""

_CARD_TEXT = """CASE card_id % 8 WHEN 0 THEN 'f' WHEN 1 THEN 'FÍSICA' WHEN 2 THEN ' Fisica' WHEN 3 THEN 'V'
    WHEN 4 THEN 'virtual' WHEN 5 THEN 'x' WHEN 6 THEN 'Vïrtual ' END"""


def classify_prefix(spark: SparkSession, sf: str) -> DataFrame:
    labels = {"f": "physical", "v": "virtual"}
    return tv.view(spark, sf, "card").select(
        "card_id",
        text.classify_prefix(F.expr(_CARD_TEXT), labels).alias("card_type"),
        text.strip_accents(F.expr(_CARD_TEXT)).alias("plain"),
    )


_SQL_PREFIX = f"""SELECT card_id,
  CASE WHEN card_id % 8 IN (0, 1, 2) THEN 'physical' WHEN card_id % 8 IN (3, 4, 6) THEN 'virtual' END AS card_type,
  CASE card_id % 8 WHEN 1 THEN 'FISICA' WHEN 6 THEN 'Virtual ' ELSE {_CARD_TEXT} END AS plain
FROM {tv.oracle('card')}"""

_REFUND_TEXT = """CASE WHEN l_linenumber = 6 THEN 'n/a' WHEN l_linenumber = 7 THEN '1.0'
    WHEN is_refund THEN CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN ' Sí' WHEN 3 THEN 'TRUE' WHEN 4 THEN 'y'
        ELSE 'Verdadero' END
    ELSE CASE l_linenumber WHEN 1 THEN '0' WHEN 2 THEN 'No' WHEN 3 THEN 'False' WHEN 4 THEN 'n' ELSE 'FALSO' END END"""


def standardize_boolean(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(_REFUND_TEXT)
    return (
        tv.view(spark, sf, "tx")
        .select("client_id", "l_linenumber", raw.alias("raw"), text.parse_boolean(raw).alias("value"))
        .select("client_id", "l_linenumber", F.col("value").cast("string").alias("is_refund"),
                text.boolean_unrecognised(F.col("raw"), F.col("value")).alias("unrecognised"))
        .groupBy("client_id", "l_linenumber", "is_refund", "unrecognised")
        .agg(F.count("*").alias("n"))
    )


_SQL_BOOLEAN = f"""SELECT client_id, l_linenumber, CASE WHEN l_linenumber < 6 THEN CAST(is_refund AS VARCHAR) END AS is_refund,
  l_linenumber = 7 AS unrecognised, count(*) AS n FROM {tv.oracle('tx')} GROUP BY ALL"""

# --- dates ---------------------------------------------------------------------------------------

# Order dates with a time of day, written in one of fourteen ways by key.
_MOMENT = "o_orderdate + make_dt_interval(0, 0, 0, CAST((o_orderkey * 7919) % 86400 AS INT))"
_QUARTER = "CAST((o_orderkey DIV 14) % 4 AS INT)"
_SINCE_EPOCH = f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {_MOMENT})"
_SINCE_SERIAL = "datediff(CAST(o_orderdate AS DATE), DATE'1899-12-30')"
_DATE_TEXT = f"""CASE o_orderkey % 14
    WHEN 0 THEN date_format({_MOMENT}, "yyyy-MM-dd'T'HH:mm:ss")
    WHEN 1 THEN date_format({_MOMENT}, 'yyyy-MM-dd HH:mm:ss')
    WHEN 2 THEN date_format(o_orderdate, ' yyyy-MM-dd ')
    WHEN 3 THEN date_format({_MOMENT}, 'dd/MM/yyyy HH:mm')
    WHEN 4 THEN date_format(o_orderdate, 'd/M/yyyy')
    WHEN 5 THEN date_format(o_orderdate, if(o_orderkey % 4 = 1, 'd-M-yyyy', 'dd-MM-yyyy'))
    WHEN 6 THEN date_format(o_orderdate, 'dd.MM.yyyy')
    WHEN 7 THEN date_format(o_orderdate, 'MM/dd/yyyy')
    WHEN 8 THEN date_format(o_orderdate, 'yyyyMMdd')
    WHEN 9 THEN concat(CAST({_SINCE_SERIAL} AS STRING), element_at(array('', '.25', '.5', '.75'), {_QUARTER} + 1))
    WHEN 10 THEN CAST({_SINCE_EPOCH} AS STRING)
    WHEN 11 THEN concat(CAST({_SINCE_EPOCH} AS STRING), '000')
    WHEN 12 THEN concat('on ', date_format(o_orderdate, 'yyyy-MM-dd')) END"""

_SQL_DATES = """SELECT o_orderkey,
  CASE o_orderkey % 14 WHEN 0 THEN moment WHEN 1 THEN moment WHEN 3 THEN date_trunc('minute', moment)
    WHEN 7 THEN CASE WHEN day(o_orderdate) <= 12
        THEN make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0) ELSE o_orderdate END
    WHEN 9 THEN o_orderdate + CAST((o_orderkey // 14) % 4 * 6 AS INT) * INTERVAL 1 HOUR
    WHEN 10 THEN moment WHEN 11 THEN moment WHEN 12 THEN NULL WHEN 13 THEN NULL ELSE o_orderdate END AS value,
  CASE o_orderkey % 14 WHEN 0 THEN '%Y-%m-%dT%H:%M:%S' WHEN 1 THEN '%Y-%m-%d %H:%M:%S' WHEN 2 THEN '%Y-%m-%d'
    WHEN 3 THEN '%d/%m/%Y %H:%M' WHEN 4 THEN '%d/%m/%Y' WHEN 5 THEN '%d-%m-%Y' WHEN 6 THEN '%d.%m.%Y'
    WHEN 7 THEN CASE WHEN day(o_orderdate) <= 12 THEN '%d/%m/%Y' ELSE '%m/%d/%Y' END WHEN 8 THEN '%Y%m%d'
    WHEN 9 THEN 'excel_serial' WHEN 10 THEN 'unix_epoch_segundos' WHEN 11 THEN 'unix_epoch_milisegundos'
    END AS format
FROM (SELECT *, o_orderdate + CAST((o_orderkey * 7919) % 86400 AS INT) * INTERVAL 1 SECOND AS moment FROM orders)"""


def messy_dates(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", F.expr(_DATE_TEXT).alias("order_date"))


def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    parsed = messy_dates(spark, sf).select("o_orderkey", dates.parse_date(F.col("order_date")).alias("d"))
    return parsed.select("o_orderkey", micros("d.value").cast("string").alias("value_us"), "d.format")


def date_format_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.date_format_profile(messy_dates(spark, sf))


def date_range_flag(spark: SparkSession, sf: str) -> DataFrame:
    clients = tv.view(spark, sf, "client").select(
        "client_id", F.col("birth_ts").cast("string").alias("birth_ts"),
        F.col("registered_ts").cast("string").alias("registered_ts"),
    )
    audited = cleaning.date_audit(clients, ["birth_ts", "registered_ts"], dates.ntz("1996-01-01 00:00:00"))
    return audited.select("client_id", "birth_ts_out_of_range", "registered_ts_out_of_range", "birth_ts_format")


_SQL_RANGE = f"""SELECT client_id,
  birth_ts < TIMESTAMP '1996-01-01' - INTERVAL 40150 DAY OR birth_ts > TIMESTAMP '1996-01-01' - INTERVAL 6570 DAY
    AS birth_ts_out_of_range,
  registered_ts > TIMESTAMP '1996-01-02' AS registered_ts_out_of_range, '%Y-%m-%d %H:%M:%S' AS birth_ts_format
FROM {tv.oracle('client')}"""

# --- numbers and ids -----------------------------------------------------------------------------

_GROUPED = "format_number(o_totalprice, 2)"
_PRICE_TEXT = f"""CASE o_orderkey % 9
    WHEN 0 THEN concat('$', {_GROUPED}) WHEN 1 THEN translate({_GROUPED}, ',.', '.,')
    WHEN 2 THEN replace(format_number(o_totalprice, '0.00'), '.', ',') WHEN 3 THEN concat({_GROUPED}, ' USD')
    WHEN 4 THEN format_number(o_totalprice, '0.00') WHEN 5 THEN concat('-', {_GROUPED})
    WHEN 6 THEN format_number(floor(o_totalprice), '#,##0') WHEN 7 THEN 'unknown' END"""


def parse_number(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        "o_orderkey", F.round(numbers.parse_number(F.expr(_PRICE_TEXT)), 2).alias("price")
    )


_SQL_NUMBER = """SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 5 THEN round(o_totalprice, 2)
    WHEN o_orderkey % 9 = 5 THEN -round(o_totalprice, 2)
    WHEN o_orderkey % 9 = 6 THEN floor(o_totalprice) END AS price FROM orders"""

_ID_TEXT = """CASE client_id % 5 WHEN 0 THEN concat(substr(national_id, 1, 9), '-', substr(national_id, 10, 1))
    WHEN 1 THEN concat(' ', national_id, '.0') WHEN 2 THEN concat('9', substr(national_id, 3, 8))
    WHEN 3 THEN substr(national_id, 1, 7) ELSE national_id END"""


def id_format(spark: SparkSession, sf: str) -> DataFrame:
    formatted = ids.format_id(F.expr(_ID_TEXT))
    return tv.view(spark, sf, "client").select(
        "client_id", formatted.alias("national_id"), ids.id_unrecognised(formatted).alias("unrecognised")
    )


_SQL_ID_FORMAT = f"""SELECT client_id, CASE client_id % 5 WHEN 2 THEN '09' || substr(national_id, 3, 8)
    WHEN 3 THEN substr(national_id, 1, 7) ELSE national_id END AS national_id, client_id % 5 = 3 AS unrecognised
FROM {tv.oracle('client')}"""


def id_check_digit(spark: SparkSession, sf: str) -> DataFrame:
    return tv.view(spark, sf, "client").select("client_id", ids.id_is_valid(F.col("national_id")).alias("valid"))


_SQL_CHECK_DIGIT = f"SELECT client_id, {CHECK_DIGIT} AS valid FROM {tv.oracle('client')}"

# --- report of a whole cleaning run --------------------------------------------------------------

_PRESENT = "1998-01-01"


def _report_plan() -> cleaning.Plan:
    """Cleaners of every kind, and one that cannot work on its column."""

    def unable(c: Column, dtype: str) -> Column:
        raise ValueError(f"no cleaner for {dtype}")

    return [
        ("order_date", (cleaning.date_step(dates.ntz(f"{_PRESENT} 00:00:00")),)),
        ("priority", (cleaning.text_step(),)),
        ("price", (cleaning.number_step(),)),
        ("status", (cleaning.text_step(), cleaning.prefix_step({"f": "final", "o": "open"}))),
        ("o_orderkey", (cleaning.Step("keep_key", unable),)),
    ]


def messy_orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        "o_orderkey",
        F.expr(_DATE_TEXT).alias("order_date"),
        F.expr(_NOISY_PRIORITY.replace("{string}", "STRING")).alias("priority"),
        F.expr(_PRICE_TEXT).alias("price"),
        F.col("o_orderstatus").alias("status"),
    )


def _flat(column: str):
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    )


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    report = cleaning.quality_report(messy_orders(spark, sf), "orders", _report_plan())
    return report.select(
        F.col("position").cast("bigint").alias("position"), "table", "function", "column", "rows_in", "rows_out",
        "nulls_in", "nulls_out", "n_unrecognised",
        F.coalesce(F.size("unrecognised"), F.lit(0)).cast("bigint").alias("n_listed"),
        F.coalesce(_flat("formats"), F.lit("")).alias("formats"),
        F.array_join("warnings", ";").alias("warnings"), "n_out_of_range",
        F.array_join("errors", ";").alias("errors"), "ok",
    )


def clean_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The table that the report is about."""
    cleaned = cleaning.clean_table(messy_orders(spark, sf), _report_plan())
    return cleaned.select(
        "o_orderkey", micros("order_date").cast("string").alias("order_date_us"), "order_date_out_of_range", "priority",
        F.round("price", 2).alias("price"), "status",
    )


_FAR = f"(value < TIMESTAMP '1900-01-01' OR value > TIMESTAMP '{_PRESENT}' + INTERVAL 1 DAY)"
_SQL_CLEAN = f"""SELECT o_orderkey, CAST(epoch_us(d.value) AS VARCHAR) AS order_date_us, coalesce({_FAR}, false) AS order_date_out_of_range,
  priority, price, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status
FROM orders JOIN ({_SQL_DATES}) d USING (o_orderkey) JOIN ({_SQL_NORMALIZE_CATEGORIES}) USING (o_orderkey)
  JOIN ({_SQL_NUMBER}) USING (o_orderkey)"""


def range_flags(spark: SparkSession, sf: str) -> DataFrame:
    """How many clients have an implausible date, from the columns that cleaning adds."""
    clients = tv.view(spark, sf, "client").select(*[F.col(c).cast("string").alias(c) for c in ("birth_ts", "registered_ts")])
    step = cleaning.date_step(dates.ntz("1996-01-01 00:00:00"))
    cleaned = cleaning.clean_table(clients, [("birth_ts", (step,)), ("registered_ts", (step,))])
    names = ["birth_ts_out_of_range", "registered_ts_out_of_range"]
    return rounded(flags.flag_summary(cleaned, "client", names), {"pct": 6})


_SQL_RANGE_FLAGS = f"WITH flagged AS ({_SQL_RANGE}) " + "\nUNION ALL ".join(
    f"""SELECT 'client' AS "table", '{c}' AS flag, count(*) FILTER ({c}) AS n, count(*) AS total,
  round(count(*) FILTER ({c}) * 100.0 / count(*), 6) AS pct FROM flagged"""
    for c in ("birth_ts_out_of_range", "registered_ts_out_of_range")
)


def _report_row(
    position: int, function: str, column: str, nulls_in: str, nulls_out: str, lost: str, listed: str,
    formats: str, placeholder: bool = False, far: str = "0", error: str = "",
) -> str:
    warned = f"CASE WHEN {lost} > 0 THEN concat({lost}, ' values not recognised') ELSE '' END"
    if placeholder:
        gained = f"(({nulls_out}) - ({nulls_in}))"
        warned = f"CASE WHEN {gained} > 0 THEN concat({gained}, ' placeholders turned into null') ELSE '' END"
    if far != "0":
        outside = f"CASE WHEN {far} > 0 THEN concat({far}, ' dates outside the plausible range, marked and kept') END"
        warned = f"concat_ws(';', nullif({warned}, ''), {outside})"
    return f"""SELECT CAST({position} AS BIGINT) AS position, 'orders' AS "table", '{function}' AS "function",
  '{column}' AS "column", CAST(count(*) AS BIGINT) AS rows_in, CAST(count(*) AS BIGINT) AS rows_out,
  CAST({nulls_in} AS BIGINT) AS nulls_in, CAST({nulls_out} AS BIGINT) AS nulls_out,
  CAST({lost} AS BIGINT) AS n_unrecognised, CAST({listed} AS BIGINT) AS n_listed, {formats} AS formats,
  {warned} AS warnings, CAST({far} AS BIGINT) AS n_out_of_range, '{error}' AS errors, {str(not error).lower()} AS ok FROM orders"""


_KEY = "count(*) FILTER (o_orderkey % {m} IN ({v}))"
_STATUS_LOST = "count(*) FILTER (o_orderstatus NOT IN ('F', 'O'))"
_SQL_REPORT = "\nUNION ALL ".join([
    _report_row(
        0, "parse_date", "order_date", _KEY.format(m=14, v="13"), _KEY.format(m=14, v="12, 13"),
        _KEY.format(m=14, v="12"), "least(50, count(DISTINCT o_orderdate) FILTER (o_orderkey % 14 = 12))",
        "(SELECT string_agg(format || '=' || n, ';' ORDER BY format) FROM (SELECT coalesce(format, 'none') AS format,"
        f" count(*) AS n FROM ({_SQL_DATES}) GROUP BY 1))",
        far=f"(SELECT count(*) FILTER ({_FAR}) FROM ({_SQL_DATES}))",
    ),
    _report_row(1, "normalize_text", "priority", _KEY.format(m=10, v="8"),
                _KEY.format(m=10, v="0, 1, 2, 3, 4, 8"), "0", "0", "''", placeholder=True),
    _report_row(2, "parse_number", "price", _KEY.format(m=9, v="8"), _KEY.format(m=9, v="7, 8"),
                _KEY.format(m=9, v="7"), "1", "''"),
    _report_row(3, "normalize_text", "status", "0", "0", "0", "0", "''", placeholder=True),
    _report_row(4, "classify_prefix", "status", "0", _STATUS_LOST, _STATUS_LOST, "1", "''"),
    _report_row(5, "keep_key", "o_orderkey", "0", "0", "0", "0", "''", error="ValueError: no cleaner for long"),
])

# --- flags ---------------------------------------------------------------------------------------


def flag_minor(spark: SparkSession, sf: str) -> DataFrame:
    return tv.view(spark, sf, "client").select(
        "client_id",
        flags.minor_at(F.col("registered_ts"), F.col("birth_ts")).alias("flag_minor"),
        flags.invalid_id(F.col("national_id")).alias("flag_invalid_id"),
    )


def flag_activation_order(spark: SparkSession, sf: str) -> DataFrame:
    return tv.view(spark, sf, "card").select(
        "card_id", flags.activated_before_issue(F.col("activated_ts"), F.col("issued_ts")).alias("flagged")
    )


_AS_OF = tv.AS_OF


def flag_future(spark: SparkSession, sf: str) -> DataFrame:
    return tv.view(spark, sf, "contact").select(
        "event_id", flags.in_future(F.col("contacted_ts"), dates.ntz(_AS_OF)).alias("flag_future")
    )


# Some keys are moved out of the master's range; some merchant codes are absent.
_SHIFTED = "CASE WHEN {id} % 50 = 0 THEN client_id + 1000000 ELSE client_id END"
_MERCHANT = ("CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN merchant_code + 1000000"
             " ELSE merchant_code END")


def flawed_views(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Cards, transactions and contacts with orphan keys, flagged by the library."""
    client = tv.view(spark, sf, "client")
    supplier = load(spark, sf, "supplier")
    as_of = dates.ntz(_AS_OF)

    def orphans(df: DataFrame, spread_by: list[str]) -> DataFrame:
        return flags.flag_orphans(df, "client_id", client, "client_id", "flag_orphan_client", True, spread_by)

    card = tv.view(spark, sf, "card").withColumn("client_id", F.expr(_SHIFTED.format(id="card_id")))
    tx = tv.view(spark, sf, "tx").withColumns({
        "client_id": F.expr(_SHIFTED.format(id="l_orderkey")), "merchant_code": F.expr(_MERCHANT)
    })
    contact = tv.view(spark, sf, "contact").withColumn("client_id", F.expr(_SHIFTED.format(id="event_id")))
    tx = orphans(tx, ["l_orderkey", "l_linenumber"]).withColumn("flag_future", flags.in_future(F.col("ts"), as_of))
    tx = flags.flag_orphans(
        tx, "merchant_code", supplier, "s_suppkey", "flag_orphan_merchant", False, ["l_orderkey", "l_linenumber"]
    )
    return {
        "card": orphans(card, ["card_id"]).withColumn(
            "flag_activation_order",
            flags.activated_before_issue(F.col("activated_ts"), F.col("issued_ts")),
        ),
        "tx": tx,
        "contact": orphans(contact, ["event_id"]).withColumn(
            "flag_future", flags.in_future(F.col("contacted_ts"), as_of)
        ),
    }


_FLAWED = f"""WITH client AS (SELECT *, {days('birth_ts', 'registered_ts')} / 365.25 < 18 AS flag_minor,
    NOT {CHECK_DIGIT} AS flag_invalid_id FROM {tv.oracle('client')}),
card AS (SELECT *, card_id % 50 = 0 AS flag_orphan_client, coalesce(activated_ts < issued_ts, false)
    AS flag_activation_order FROM {tv.oracle('card')}),
tx AS (SELECT *, l_orderkey % 50 = 0 AS flag_orphan_client, ts > TIMESTAMP '{_AS_OF}' AS flag_future,
    l_orderkey % 7 <> 0 AND l_orderkey % 11 = 0 AS flag_orphan_merchant FROM {tv.oracle('tx')}),
contact AS (SELECT *, event_id % 50 = 0 AS flag_orphan_client, contacted_ts > TIMESTAMP '{_AS_OF}' AS flag_future
    FROM {tv.oracle('contact')})"""


def flag_orphans(spark: SparkSession, sf: str) -> DataFrame:
    tx = flawed_views(spark, sf)["tx"]
    return tx.groupBy("l_orderkey", "flag_orphan_client", "flag_orphan_merchant").agg(F.count("*").alias("n"))


_SQL_ORPHANS = f"""{_FLAWED} SELECT l_orderkey, flag_orphan_client, flag_orphan_merchant, count(*) AS n
FROM tx GROUP BY ALL"""

_SUMMARY_FLAGS = {
    "client": ["flag_minor", "flag_invalid_id"],
    "card": ["flag_activation_order", "flag_orphan_client"],
    "tx": ["flag_orphan_client", "flag_future", "flag_orphan_merchant"],
    "contact": ["flag_future", "flag_orphan_client"],
}


def flag_summary(spark: SparkSession, sf: str) -> DataFrame:
    views = flawed_views(spark, sf)
    views["client"] = flag_minor(spark, sf)
    out = None
    for table, names in _SUMMARY_FLAGS.items():
        part = flags.flag_summary(views[table], table, names)
        out = part if out is None else out.unionByName(part)
    return rounded(out, {"pct": 6})


_SQL_SUMMARY = f"{_FLAWED} " + "\nUNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{f}' AS flag, count(*) FILTER ({f}) AS n, count(*) AS total,
  round(count(*) FILTER ({f}) * 100.0 / count(*), 6) AS pct FROM {t}"""
    for t, names in _SUMMARY_FLAGS.items() for f in names
)


def exclusion_report(spark: SparkSession, sf: str) -> DataFrame:
    v = flawed_views(spark, sf)
    return rounded(segment_base.exclusions(v["card"], v["tx"], v["contact"]), {"pct": 6})


def _stages(table: str, second: str, reason: str) -> str:
    first = "count(*) FILTER (flag_orphan_client)"
    both = f"count(*) FILTER ({second} AND NOT flag_orphan_client)"
    return f"""SELECT '{table}' AS "table", CAST(1 AS BIGINT) AS stage, 'orphan client' AS reason,
  count(*) AS n_before, {first} AS n_excluded, round({first} * 100.0 / count(*), 6) AS pct FROM {table}
UNION ALL SELECT '{table}', 2, '{reason}', count(*) - {first}, {both},
  round({both} * 100.0 / (count(*) - {first}), 6) FROM {table}"""


_SQL_EXCLUSION = f"{_FLAWED} " + "\nUNION ALL ".join([
    _stages("card", "flag_activation_order", "activation before issue"),
    _stages("tx", "flag_future", "future date"),
    _stages("contact", "flag_future", "future date"),
])


def trusted_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and flagged rows of the views with flaws."""
    views = flawed_views(spark, sf)
    views["client"] = trusted(spark, sf)[0]
    out = None
    for name, df in views.items():
        flagged = F.lit(False)
        for c in df.columns:
            if c.startswith("flag_"):
                flagged = flagged | F.col(c)
        part = df.agg(
            F.lit(name).alias("table"), F.count("*").alias("n"), F.count_if(flagged).alias("n_flagged")
        )
        out = part if out is None else out.unionByName(part)
    return out


_SQL_TRUSTED = f"""{_FLAWED}
SELECT 'client' AS "table", count(*) AS n, count(*) FILTER (flag_minor OR flag_invalid_id) AS n_flagged FROM client
UNION ALL SELECT 'card', count(*), count(*) FILTER (flag_activation_order OR flag_orphan_client) FROM card
UNION ALL SELECT 'tx', count(*), count(*) FILTER (flag_orphan_client OR flag_future OR flag_orphan_merchant) FROM tx
UNION ALL SELECT 'contact', count(*), count(*) FILTER (flag_orphan_client OR flag_future) FROM contact"""

QUERIES = {
    "dedup_exact": (dedup_exact, """SELECT DISTINCT * EXCLUDE (l_shipdate), epoch_us(l_shipdate) AS shipped_us
        FROM lineitem"""),
    "dedup_counts": (dedup_counts, _SQL_DEDUP_COUNTS),
    "dedup_documents": (dedup_documents, """SELECT md5(text) AS text_md5, lang, source
        FROM (SELECT DISTINCT text, lang, source FROM documents)"""),
    "normalize_text": (normalize_text, _SQL_NORMALIZE),
    "normalize_categories": (normalize_categories, _SQL_NORMALIZE_CATEGORIES),
    "classify_prefix": (classify_prefix, _SQL_PREFIX),
    "standardize_boolean": (standardize_boolean, _SQL_BOOLEAN),
    "parse_dates": (parse_dates, f"SELECT o_orderkey, CAST(epoch_us(value) AS VARCHAR) AS value_us, format FROM ({_SQL_DATES})"),
    "date_format_profile": (date_format_profile, f"""SELECT 'order_date' AS "column", CASE WHEN o_orderkey % 14 = 13
        THEN 'null' ELSE coalesce(format, 'unparsed') END AS format, count(*) AS n FROM ({_SQL_DATES}) GROUP BY 1, 2"""),
    "date_range_flag": (date_range_flag, _SQL_RANGE),
    "parse_number": (parse_number, _SQL_NUMBER),
    "id_format": (id_format, _SQL_ID_FORMAT),
    "id_check_digit": (id_check_digit, _SQL_CHECK_DIGIT),
    "quality_report": (quality_report, _SQL_REPORT),
    "clean_orders": (clean_orders, _SQL_CLEAN),
    "range_flags": (range_flags, _SQL_RANGE_FLAGS),
    "flag_minor": (flag_minor, f"{VIEWS} SELECT client_id, flag_minor, flag_invalid_id FROM client"),
    "flag_activation_order": (flag_activation_order,
                              f"{VIEWS} SELECT card_id, flag_activation_order AS flagged FROM card"),
    "flag_future": (flag_future, f"""SELECT event_id, contacted_ts > TIMESTAMP '{_AS_OF}' AS flag_future
        FROM {tv.oracle('contact')}"""),
    "flag_orphans": (flag_orphans, _SQL_ORPHANS),
    "flag_summary": (flag_summary, _SQL_SUMMARY),
    "exclusion_report": (exclusion_report, _SQL_EXCLUSION),
    "trusted_counts": (trusted_counts, _SQL_TRUSTED),
}
