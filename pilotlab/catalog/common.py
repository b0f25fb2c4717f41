"""Helpers of the query catalogue: rounding, oracle fragments and the shared Spark frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import EffectSpec, Labels, SegmentSpec
from ..sources import testviews as tv

LABELS = Labels(tv.PHYSICAL, tv.VIRTUAL, tv.CASH_TYPES)
EFFECT = EffectSpec(LABELS, tv.PILOT)
SEGMENT = SegmentSpec(LABELS)
load = tv.load


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, for comparison with ``epoch_us``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)


def trusted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    t = tv.trusted(spark, sf)
    return t["client"], t["card"], t["tx"], t["contact"]


def days(start: str, end: str) -> str:
    """Whole days between two timestamps in the oracle's SQL."""
    return f"CAST(floor(date_diff('microsecond', {start}, {end}) / 86400000000.0) AS BIGINT)"


CHECK_DIGIT = """(length(national_id) = 10 AND CAST(substr(national_id, 1, 2) AS INT) BETWEEN 1 AND 24
  AND CAST(substr(national_id, 3, 1) AS INT) <= 6
  AND (10 - (SELECT sum(CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * d >= 10 THEN 2 * d - 9 ELSE 2 * d END ELSE d END)
             FROM (SELECT i, CAST(substr(national_id, CAST(i AS INT), 1) AS INT) AS d FROM range(1, 10) r(i))) % 10) % 10
      = CAST(substr(national_id, 10, 1) AS INT))"""

# The four views with their flags, for DuckDB.
VIEWS = f"""WITH client AS (SELECT *, {days('birth_ts', 'registered_ts')} / 365.25 < 18 AS flag_minor,
    NOT {CHECK_DIGIT} AS flag_invalid_id FROM {tv.oracle('client')}),
card AS (SELECT *, coalesce(activated_ts < issued_ts, false) AS flag_activation_order,
    client_id NOT IN (SELECT client_id FROM client) AS flag_orphan_client FROM {tv.oracle('card')}),
tx AS (SELECT *, CASE WHEN is_refund THEN -amount ELSE amount END AS net_amount FROM {tv.oracle('tx')}
    WHERE client_id IN (SELECT client_id FROM client) AND ts <= TIMESTAMP '2005-01-01'),
contact AS (SELECT * FROM {tv.oracle('contact')}
    WHERE client_id IN (SELECT client_id FROM client) AND contacted_ts <= TIMESTAMP '2005-01-01')"""

# Eligible clients with their observation window.
ELIGIBLE = f"""{VIEWS}, now AS (SELECT max(ts) AS today FROM tx),
owner AS (SELECT DISTINCT client_id FROM card WHERE card_type = 'physical' AND activated_ts IS NOT NULL
    AND NOT flag_activation_order AND NOT flag_orphan_client),
eligible AS (SELECT client_id, city, acquisition_channel, today,
    {days('birth_ts', 'today')} / 365.25 AS age_years, {days('registered_ts', 'today')} AS tenure_days,
    greatest(registered_ts, today - INTERVAL 365 DAY) AS window_start,
    {days('greatest(registered_ts, today - INTERVAL 365 DAY)', 'today')} AS observed_days,
    {days('greatest(registered_ts, today - INTERVAL 365 DAY)', 'today')} / 30.44 AS observed_months
  FROM client, now WHERE client_id NOT IN (SELECT client_id FROM owner) AND NOT flag_minor
    AND {days('registered_ts', 'today')} >= 30)"""

SEGMENT_BASE = f"""{ELIGIBLE},
etx AS (SELECT e.client_id, count(*) AS n, sum(net_amount) AS total, count(DISTINCT tx_type) AS kinds
  FROM eligible e JOIN tx ON tx.client_id = e.client_id AND ts >= window_start GROUP BY e.client_id),
ect AS (SELECT e.client_id, count(*) AS n, avg(CAST(responded AS DOUBLE)) AS rate
  FROM eligible e JOIN contact c ON c.client_id = e.client_id AND contacted_ts >= window_start GROUP BY e.client_id),
ecd AS (SELECT client_id, bool_or(activated_ts IS NOT NULL) AS active, min(issued_ts) AS oldest
  FROM card, now WHERE card_type = 'virtual' AND NOT flag_activation_order AND NOT flag_orphan_client
    AND issued_ts < today GROUP BY client_id),
base AS (SELECT e.client_id, age_years, tenure_days, coalesce(etx.n, 0) / observed_months AS monthly_frequency,
    coalesce(etx.total, 0) / observed_months AS monthly_amount, coalesce(kinds, 0) AS type_diversity,
    coalesce(ect.n, 0) / observed_months AS monthly_contacts, coalesce(rate, 0) AS response_rate,
    CAST(coalesce(active, false) AS DOUBLE) AS has_active_virtual,
    coalesce({days('oldest', 'today')}, 0) AS virtual_card_days, city, acquisition_channel
  FROM eligible e LEFT JOIN etx USING (client_id) LEFT JOIN ect USING (client_id) LEFT JOIN ecd USING (client_id))"""

# The pilot cohort with arms and anchors.
COHORT = f"""{VIEWS}, first_contact AS (SELECT client_id, min(contacted_ts) AS first_contact_ts FROM contact
    WHERE campaign = 'signup' GROUP BY client_id),
activation AS (SELECT client_id, min(activated_ts) AS first_activation_ts FROM card WHERE card_type = 'physical'
    AND activated_ts IS NOT NULL AND NOT flag_activation_order AND NOT flag_orphan_client GROUP BY client_id),
arms AS (SELECT client.*, first_contact_ts, first_activation_ts,
    coalesce(first_activation_ts < first_contact_ts, false) AS active_before,
    CAST(first_activation_ts IS NOT NULL AS INT) AS treated
  FROM client JOIN first_contact USING (client_id) LEFT JOIN activation USING (client_id)),
delay AS (SELECT median({days('first_contact_ts', 'first_activation_ts')}) AS d FROM arms
    WHERE NOT active_before AND treated = 1),
cohort AS (SELECT arms.*, coalesce(first_activation_ts,
    first_contact_ts + to_microseconds(CAST(d * 86400000000 AS BIGINT))) AS t0
  FROM arms, delay WHERE NOT active_before)"""

EFFECT_BASE = f"""{COHORT}, last AS (SELECT max(ts) AS last_ts FROM tx),
day_tx AS (SELECT c.client_id, tx_type, net_amount, {days('t0', 'ts')} AS day
  FROM cohort c JOIN tx ON tx.client_id = c.client_id),
agg_tx AS (SELECT client_id, count(*) FILTER (day >= -60 AND day < 0) AS frequency_pre,
    coalesce(sum(net_amount) FILTER (day >= -60 AND day < 0), 0) AS amount_pre,
    count(DISTINCT tx_type) FILTER (day >= -60 AND day < 0) AS type_diversity_pre,
    count(*) FILTER (day >= -60 AND day < 0 AND tx_type IN ('1-URGENT', '2-HIGH')) AS n_cash_pre,
    count(*) FILTER (day >= 0 AND day < 60) AS frequency_post,
    coalesce(sum(net_amount) FILTER (day >= 0 AND day < 60), 0) AS amount_post
  FROM day_tx GROUP BY client_id),
agg_ct AS (SELECT c.client_id, count(*) AS n_contacts, avg(CAST(responded AS DOUBLE)) AS response_rate
  FROM cohort c JOIN contact ct ON ct.client_id = c.client_id AND contacted_ts < t0 GROUP BY c.client_id),
agg_cd AS (SELECT c.client_id, bool_or(activated_ts IS NOT NULL) AS active, min(issued_ts) AS oldest
  FROM cohort c JOIN card ON card.client_id = c.client_id AND card_type = 'virtual' AND issued_ts < t0
  GROUP BY c.client_id),
base AS (SELECT c.client_id, treated, t0,
    CAST(coalesce(frequency_post, 0) - coalesce(frequency_pre, 0) AS DOUBLE) AS y_frequency,
    CAST(coalesce(amount_post, 0) - coalesce(amount_pre, 0) AS DOUBLE) AS y_amount,
    {days('birth_ts', 't0')} / 365.25 AS age_years, city, acquisition_channel,
    {days('registered_ts', 't0')} AS tenure_days, coalesce(frequency_pre, 0) AS frequency_pre,
    CAST(coalesce(amount_pre, 0) AS DOUBLE) AS amount_pre, coalesce(type_diversity_pre, 0) AS type_diversity_pre,
    coalesce(n_cash_pre / nullif(frequency_pre, 0), 0) AS cash_share_pre, coalesce(n_contacts, 0) AS n_contacts,
    coalesce(response_rate, 0) AS response_rate, coalesce(active, false) AS has_active_virtual,
    coalesce({days('oldest', 't0')}, 0) AS virtual_card_days, NOT flag_invalid_id AS id_valid,
    coalesce(frequency_post, 0) AS frequency_post, CAST(coalesce(amount_post, 0) AS DOUBLE) AS amount_post,
    coalesce(n_cash_pre, 0) AS n_cash_pre
  FROM cohort c CROSS JOIN last LEFT JOIN agg_tx USING (client_id) LEFT JOIN agg_ct USING (client_id)
    LEFT JOIN agg_cd USING (client_id)
  WHERE t0 - INTERVAL 60 DAY >= registered_ts AND t0 + INTERVAL 60 DAY <= last_ts)"""
