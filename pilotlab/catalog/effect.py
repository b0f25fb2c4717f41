"""Queries of the causal table and the effect estimation, each with its oracle where SQL has one."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balance, ridge, tests
from ..operators.features import FeatureColumns, fit_features, with_features
from ..plans import effect_base as eb
from ..plans import activity, effect_model, spec
from ..plans.events import valid_transactions
from ..sources.tables import cut_lineage
from .common import COHORT, EFFECT, EFFECT_BASE, VIEWS, load, micros, rounded, trusted
from . import effect_sql
from .profile import describe_sql


def _base(spark: SparkSession, sf: str) -> DataFrame:
    client, card, tx, contact = trusted(spark, sf)
    return eb.effect_base(client, card, tx, contact, EFFECT)


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    client, card, _, contact = trusted(spark, sf)
    cohort = eb.pilot_cohort(client, contact, EFFECT.campaign)
    return eb.with_arms(cohort, eb.first_activation(card, EFFECT.labels.physical))


def pilot_cohort(spark: SparkSession, sf: str) -> DataFrame:
    client, _, _, contact = trusted(spark, sf)
    cohort = eb.pilot_cohort(client, contact, EFFECT.campaign)
    return cohort.select("client_id", micros("first_contact_ts").alias("first_contact_us"))


def arm_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return eb.arm_sizes(_arms(spark, sf))


def anchor_dates(spark: SparkSession, sf: str) -> DataFrame:
    return eb.anchored(_arms(spark, sf)).select("client_id", "treated", micros("t0").alias("t0_us"))


def transaction_range(spark: SparkSession, sf: str) -> DataFrame:
    span = eb.data_range(trusted(spark, sf)[2])
    return span.select(micros("first_ts").alias("first_us"), micros("last_ts").alias("last_us"))


_CANDIDATES = [30, 60, 240, 480, 960, 1900]


def window_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    client, card, tx, contact = trusted(spark, sf)
    cohort = eb.anchored_cohort(client, card, contact, EFFECT)
    return rounded(eb.window_sensitivity(cohort, tx, _CANDIDATES), {"pct": 6})


_SQL_WINDOWS = f"""{COHORT}, last AS (SELECT max(ts) AS last_ts FROM tx),
fits AS (SELECT d, t0 - to_days(d) >= registered_ts AND t0 + to_days(d) <= last_ts AS ok
  FROM cohort, last, (SELECT unnest({_CANDIDATES}) AS d))
SELECT CAST(d AS BIGINT) AS window_days, count(*) FILTER (ok) AS n_valid, count(*) AS n_clients,
  round(count(*) FILTER (ok) * 100.0 / count(*), 6) AS pct FROM fits GROUP BY d"""


def pre_post_deltas(spark: SparkSession, sf: str) -> DataFrame:
    client, card, tx, contact = trusted(spark, sf)
    table = eb.window_aggregates(client, card, tx, contact, EFFECT).where("window_valid")
    return table.select(
        "client_id", "frequency_pre", "frequency_post", "n_cash_pre", "type_diversity_pre",
        F.round("amount_pre", 2).alias("amount_pre"), F.round("amount_post", 2).alias("amount_post"),
    )


_SQL_DELTAS = f"""{EFFECT_BASE} SELECT client_id, frequency_pre, frequency_post, n_cash_pre, type_diversity_pre,
  round(amount_pre, 2) AS amount_pre, round(amount_post, 2) AS amount_post FROM base"""


def causal_base(spark: SparkSession, sf: str) -> DataFrame:
    digits = {"y_amount": 2, "amount_pre": 2, "age_years": 6, "cash_share_pre": 6, "response_rate": 6}
    return rounded(_base(spark, sf), digits).withColumn("t0_us", micros("t0")).drop("t0")


_SQL_BASE = f"""{EFFECT_BASE} SELECT client_id, treated, epoch_us(t0) AS t0_us, y_frequency,
  round(y_amount, 2) AS y_amount, round(age_years, 6) AS age_years, city, acquisition_channel, tenure_days,
  frequency_pre, round(amount_pre, 2) AS amount_pre, type_diversity_pre, round(cash_share_pre, 6) AS cash_share_pre,
  n_contacts, round(response_rate, 6) AS response_rate, has_active_virtual, virtual_card_days, id_valid FROM base"""


_LENGTHS = [30, 45, 60, 90, 120]


def _bases(spark: SparkSession, sf: str) -> DataFrame:
    return activity.effect_bases(*trusted(spark, sf), _LENGTHS, EFFECT)


def causal_base_from_days(spark: SparkSession, sf: str) -> DataFrame:
    """The causal table once more, by way of the daily sums that serve every window length."""
    digits = {"y_amount": 2, "amount_pre": 2, "age_years": 6, "cash_share_pre": 6, "response_rate": 6}
    base = _bases(spark, sf).where("window_days = 60").drop("window_days")
    return rounded(base, digits).withColumn("t0_us", micros("t0")).drop("t0")


def outcomes_by_window(spark: SparkSession, sf: str) -> DataFrame:
    found = activity.outcomes_by_window(_bases(spark, sf))
    return rounded(found.withColumn("window_days", F.col("window_days").cast("bigint")), {"y_frequency": 6, "y_amount": 4})


def _of_length(days: int) -> str:
    """The oracle's causal table for another window length."""
    text = EFFECT_BASE.replace("day >= -60", f"day >= -{days}").replace("day < 60", f"day < {days}")
    return text.replace("INTERVAL 60 DAY", f"INTERVAL {days} DAY")


_SQL_BY_WINDOW = "\nUNION ALL ".join(
    f"""(SELECT CAST({d} AS BIGINT) AS window_days, treated, count(*) AS n, round(avg(y_frequency), 6) AS y_frequency,
  round(avg(y_amount), 4) AS y_amount FROM ({_of_length(d)} SELECT * FROM base) GROUP BY treated)"""
    for d in _LENGTHS
)


def signed_amount_by_client(spark: SparkSession, sf: str) -> DataFrame:
    tx = valid_transactions(trusted(spark, sf)[2])
    return tx.groupBy("client_id").agg(
        F.count("*").alias("n"),
        F.round(F.sum("net_amount"), 2).alias("net_amount"),
        F.count_distinct("tx_type").alias("n_types"),
    )


def covariate_balance(spark: SparkSession, sf: str) -> DataFrame:
    columns = [*spec.EFFECT_NUMERIC, *spec.EFFECT_BOOLEAN]
    table = balance.covariate_balance(_base(spark, sf), "treated", columns)
    return rounded(table, {"mean_treated": 4, "mean_control": 4, "smd": 4})


def _balance_sql() -> str:
    rows = []
    for c in (*spec.EFFECT_NUMERIC, *spec.EFFECT_BOOLEAN):
        x = f"CAST({c} AS DOUBLE)"
        gap = f"avg({x}) FILTER (treated = 1) - avg({x}) FILTER (treated = 0)"
        pooled = f"(var_samp({x}) FILTER (treated = 1) + var_samp({x}) FILTER (treated = 0)) / 2"
        smd = f"CASE WHEN {pooled} > 0 THEN ({gap}) / sqrt({pooled}) ELSE 0 END"
        rows.append(f"""SELECT '{c}' AS variable, round(avg({x}) FILTER (treated = 1), 4) AS mean_treated,
  round(avg({x}) FILTER (treated = 0), 4) AS mean_control, round({smd}, 4) AS smd,
  abs({smd}) > 0.1 AS unbalanced FROM base""")
    return EFFECT_BASE.replace("base AS (", "base AS MATERIALIZED (") + "\n" + "\nUNION ALL ".join(rows)


def category_balance(spark: SparkSession, sf: str) -> DataFrame:
    return balance.category_balance(cut_lineage(_base(spark, sf)), "treated", "acquisition_channel")


_SQL_CATEGORY = f"""{EFFECT_BASE}, n AS (SELECT count(*) FILTER (treated = 1) AS t, count(*) FILTER (treated = 0) AS c
  FROM base)
SELECT acquisition_channel, round(count(*) FILTER (treated = 1) * 100.0 / any_value(t), 1) AS pct_treated,
  round(count(*) FILTER (treated = 0) * 100.0 / any_value(c), 1) AS pct_control
FROM base, n GROUP BY acquisition_channel"""


def ridge_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Price of a line on its quantity and discount, with a penalty large enough to matter."""
    lines = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(
        load(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    )
    model = ridge.fit_ridge(lines, "l_extendedprice", alpha=50.0)
    values = [*model.coefficients.toArray().tolist(), float(model.intercept)]
    return spark.createDataFrame(
        [(n, round(float(v), 3)) for n, v in zip(("l_quantity", "l_discount", "intercept"), values)],
        "term string, value double",
    )


_SQL_RIDGE = """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_extendedprice) AS p FROM lineitem),
s AS (SELECT sum((l_quantity - q) ** 2) + 50 AS qq, sum((l_discount - d) ** 2) + 50 AS dd,
    sum((l_quantity - q) * (l_discount - d)) AS qd, sum((l_quantity - q) * (l_extendedprice - p)) AS qp,
    sum((l_discount - d) * (l_extendedprice - p)) AS dp FROM lineitem, m),
b AS (SELECT (qp * dd - dp * qd) / (qq * dd - qd * qd) AS bq, (dp * qq - qp * qd) / (qq * dd - qd * qd) AS bd FROM s)
SELECT 'l_quantity' AS term, round(bq, 3) AS value FROM b UNION ALL SELECT 'l_discount', round(bd, 3) FROM b
UNION ALL SELECT 'intercept', round(p - bq * q - bd * d, 3) FROM b, m"""


def feature_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the prepared features over all clients: zero means and unit deviations."""
    lines = load(spark, sf, "lineitem").withColumn(
        "l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_tax"))
    )
    columns = FeatureColumns(("l_extendedprice", "l_tax"), ("l_returnflag",), ())
    ready = with_features(lines, fit_features(lines, columns))
    values = ready.select("l_returnflag", vector_to_array("features").alias("x"))
    return values.groupBy("l_returnflag").agg(*[
        F.round(F.avg(F.col("x")[i]), 6).alias(f"x{i}") for i in range(4)
    ])


_SQL_FEATURES = """WITH t AS (SELECT l_returnflag, l_extendedprice AS p, CASE WHEN l_linenumber <> 3 THEN l_tax END AS tax
  FROM lineitem),
f AS (SELECT l_returnflag, p, coalesce(tax, (SELECT median(tax) FROM t)) AS tax FROM t),
s AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, avg(tax) AS mt, stddev_pop(tax) AS st FROM f)
SELECT l_returnflag, round(avg((p - mp) / sp), 6) AS x0, round(avg((tax - mt) / st), 6) AS x1,
  CASE l_returnflag WHEN 'N' THEN 1.0 ELSE 0.0 END::DOUBLE AS x2, CASE l_returnflag WHEN 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS x3
FROM f, s GROUP BY l_returnflag"""


def _learner(spark: SparkSession, sf: str) -> tuple[DataFrame, ridge.TLearner]:
    base = cut_lineage(_base(spark, sf))
    return base, ridge.fit_t_learner(
        base, "treated", "client_id", effect_model.EFFECT_FEATURES, list(effect_model.OUTCOMES)
    )


def t_learner_effect(spark: SparkSession, sf: str) -> DataFrame:
    base, learner = _learner(spark, sf)
    return learner.effect(base.where("treated = 1"), "y_frequency").select(
        "client_id", F.round("expected", 6).alias("expected"), F.round("effect", 6).alias("effect")
    )


def conditional_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted effect of every client of the causal table, whatever the arm."""
    base, learner = _learner(spark, sf)
    return learner.conditional_effect(base, "y_frequency").select("client_id", F.round("cate", 6).alias("cate"))


def holdout_r2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_learner(spark, sf)[1].r2, {"r2": 6})


def normal_equations(spark: SparkSession, sf: str) -> DataFrame:
    """Largest error of the final models in their normal equations, taken from the rows and not from the sums."""
    base, learner = _learner(spark, sf)
    out = None
    for value, arm in ((0, learner.control), (1, learner.treated)):
        for y, model in arm.outcomes.items():
            rows = base.where(F.col("treated") == value).withColumn("_error", F.col(y) - model.expression())
            prepared, numeric = model.prepared, spec.EFFECT_NUMERIC
            gaps = [F.sum("_error").alias("g")]
            for i, c in enumerate(numeric):
                x = (F.coalesce(F.col(c).cast("double"), F.lit(prepared.fills[c])) - prepared.means[c]) / prepared.deviations[c]
                gaps.append((F.sum(F.col("_error") * x) - F.lit(float(model.coefficients[i]))).alias(f"g{i}"))
            worst = F.greatest(*[F.abs(F.col(f"g{i}")) for i in range(len(numeric))], F.abs("g"))
            scale = F.sum(F.abs(y)) + 1
            row = rows.agg(*gaps, scale.alias("scale")).select(
                F.lit(value).alias("treated"), F.lit(y).alias("outcome"), (F.round(worst / F.col("scale"), 6) + 0.0).alias("residual")
            )
            out = row if out is None else out.unionByName(row)
    return out


def effect_decision(spark: SparkSession, sf: str) -> DataFrame:
    digits = {c: 4 for c in ("mean", "std", "min", "q25", "q50", "q75", "max", "pct_positive", "t", "z")}
    digits |= {"p_t": 6, "p_wilcoxon": 6, "w": 1, "ci_low": 3, "ci_high": 3}
    return rounded(effect_model.measure_effect(_base(spark, sf)).decisions, digits)


def p_values(spark: SparkSession, sf: str) -> DataFrame:
    """Both tests on a small gap of each line, which neither rejects nor is sure."""
    lines = load(spark, sf, "lineitem").where("l_linenumber = 7").select(F.expr(_GAP).alias("x"))
    ranks = tests.wilcoxon_statistic(lines, "x").select(F.struct("w", "z", "p_wilcoxon")).scalar()
    both = tests.t_statistic(lines, "x").select("t", "p_t", ranks.alias("ranks")).select("t", "p_t", "ranks.*")
    return rounded(both, {"t": 6, "p_t": 6, "w": 1, "z": 6, "p_wilcoxon": 6})


def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out share of all customers; the split depends on the key alone."""
    return load(spark, sf, "customer").groupBy(ridge.holdout("c_custkey", 42).alias("held_out")).agg(
        F.count("*").alias("n")
    )


_SQL_HOLDOUT = """SELECT CAST('0x' || substr(md5(concat(c_custkey, ':42')), 1, 8) AS BIGINT) % 100 < 20 AS held_out,
  count(*) AS n FROM customer GROUP BY 1"""


def effect_summary(spark: SparkSession, sf: str) -> DataFrame:
    treated = cut_lineage(_base(spark, sf).where("treated = 1"))
    digits = {c: 4 for c in ("mean", "std", "min", "q25", "q50", "q75", "max", "pct_positive")}
    return rounded(tests.effect_summary(treated, "y_amount"), digits)


_SQL_EFFECT_SUMMARY = f"""{EFFECT_BASE}, t AS (SELECT * FROM base WHERE treated = 1)
SELECT d.*, (SELECT round(avg(CASE WHEN y_amount > 0 THEN 100.0 ELSE 0.0 END), 4) FROM t) AS pct_positive
FROM ({describe_sql('t', ['y_amount'])}) d"""

_GAP = "round(l_extendedprice) % 1000 - 490"

# A symmetric quantity of each line with many ties, zeros included.
_GAIN = "round(l_discount * 100) - 5"


def t_statistic(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select(F.expr(_GAIN).alias("x"))
    return tests.t_statistic(lines, "x").select("n", F.round("mean", 6).alias("mean"), F.round("t", 6).alias("t"))


def wilcoxon_statistic(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select(F.expr("round(l_extendedprice * l_discount) - 2000").alias("x"))
    return tests.wilcoxon_statistic(lines, "x").select(
        "n_nonzero", F.round("w_plus", 1).alias("w_plus"), F.round("w_minus", 1).alias("w_minus"),
        F.round("w", 1).alias("w"), F.round("z", 6).alias("z"),
    )


_SQL_WILCOXON = """WITH x AS (SELECT round(l_extendedprice * l_discount) - 2000 AS x FROM lineitem),
r AS (SELECT x, (rank() OVER (ORDER BY abs(x)) + rank() OVER (ORDER BY abs(x)) + count(*) OVER (PARTITION BY abs(x))
    - 1) / 2.0 AS r FROM x WHERE x <> 0),
w AS (SELECT count(*) AS n, sum(CASE WHEN x > 0 THEN r ELSE 0 END) AS p, sum(CASE WHEN x < 0 THEN r ELSE 0 END) AS m
  FROM r),
t AS (SELECT sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY abs(x)))
SELECT n AS n_nonzero, round(CAST(p AS DOUBLE), 1) AS w_plus, round(CAST(m AS DOUBLE), 1) AS w_minus,
  round(CAST(least(p, m) AS DOUBLE), 1) AS w,
  round((CAST(least(p, m) AS DOUBLE) - CAST(n AS DOUBLE) * (n + 1) / 4)
    / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z
FROM w, t"""


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    treated = cut_lineage(_base(spark, sf).where("treated = 1").select("client_id", "y_amount"))
    return rounded(tests.bootstrap_interval(treated, "y_amount", "client_id"), {"ci_low": 3, "ci_high": 3})


def _md5_sql(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {tests.PRIME})"


_DRAW_SQL = " ".join(f"WHEN u < {bound!r}e0 THEN {k}" for k, bound in enumerate(tests.poisson_bounds()))
_SQL_BOOTSTRAP = f"""{EFFECT_BASE}, h AS (
  SELECT {_md5_sql("concat(client_id, ':42')")} AS h, CAST(y_amount AS DOUBLE) AS x FROM base WHERE treated = 1),
r AS (SELECT r, {_md5_sql("concat('a', r, ':42')")} % {tests.PRIME - 1} + 1 AS a, {_md5_sql("concat('b', r, ':42')")} AS b
  FROM range(2000) t(r)),
d AS (SELECT r, x, CAST((h * a + b) % {tests.PRIME} AS DOUBLE) / {tests.PRIME} AS u FROM h, r WHERE x IS NOT NULL),
w AS (SELECT r, x, CASE {_DRAW_SQL} ELSE 18 END AS w FROM d),
m AS (SELECT r, sum(x * w) / nullif(sum(w), 0) AS mean FROM w GROUP BY r)
SELECT round(quantile_cont(mean, 0.025), 3) AS ci_low, round(quantile_cont(mean, 0.975), 3) AS ci_high FROM m"""


def winsorize(spark: SparkSession, sf: str) -> DataFrame:
    treated = cut_lineage(_base(spark, sf).where("treated = 1"))
    return tests.winsorize(treated, "y_amount", "held").select("client_id", F.round("held", 4).alias("held"))


_SQL_WINSORIZE = f"""{EFFECT_BASE}, t AS (SELECT * FROM base WHERE treated = 1),
q AS (SELECT quantile_cont(y_amount, 0.01) AS lo, quantile_cont(y_amount, 0.99) AS hi FROM t)
SELECT client_id, round(least(greatest(y_amount, lo), hi), 4) AS held FROM t, q"""

QUERIES = {
    "pilot_cohort": (pilot_cohort, f"""{COHORT} SELECT client_id, epoch_us(first_contact_ts) AS first_contact_us
        FROM arms"""),
    "arm_sizes": (arm_sizes, f"""{COHORT} SELECT count(*) AS cohort, count(*) FILTER (active_before) AS active_before,
        count(*) FILTER (NOT active_before AND treated = 1) AS treated,
        count(*) FILTER (NOT active_before AND treated = 0) AS control FROM arms"""),
    "anchor_dates": (anchor_dates, f"{COHORT} SELECT client_id, treated, epoch_us(t0) AS t0_us FROM cohort"),
    "transaction_range": (transaction_range, f"""{VIEWS} SELECT epoch_us(min(ts)) AS first_us,
        epoch_us(max(ts)) AS last_us FROM tx"""),
    "window_sensitivity": (window_sensitivity, _SQL_WINDOWS),
    "pre_post_deltas": (pre_post_deltas, _SQL_DELTAS),
    "causal_base": (causal_base, _SQL_BASE),
    "causal_base_from_days": (causal_base_from_days, _SQL_BASE),
    "outcomes_by_window": (outcomes_by_window, _SQL_BY_WINDOW),
    "signed_amount_by_client": (signed_amount_by_client, f"""{VIEWS} SELECT client_id, count(*) AS n,
        round(sum(net_amount), 2) AS net_amount, count(DISTINCT tx_type) AS n_types FROM tx GROUP BY client_id"""),
    "covariate_balance": (covariate_balance, _balance_sql()),
    "category_balance": (category_balance, _SQL_CATEGORY),
    "feature_statistics": (feature_statistics, _SQL_FEATURES),
    "ridge_coefficients": (ridge_coefficients, _SQL_RIDGE),
    "holdout_split": (holdout_split, _SQL_HOLDOUT),
    "holdout_r2": (holdout_r2, effect_sql.HOLDOUT_R2),
    "t_learner_effect": (t_learner_effect, effect_sql.T_LEARNER),
    "conditional_effect": (conditional_effect, effect_sql.CONDITIONAL),
    "normal_equations": (normal_equations, """SELECT CAST(a AS INTEGER) AS treated, y AS outcome, 0.0::DOUBLE AS residual
        FROM range(2) r(a), (SELECT unnest(['y_frequency', 'y_amount']) AS y)"""),
    "effect_decision": (effect_decision, effect_sql.decision(_md5_sql("concat(client_id, ':42')"), _DRAW_SQL, _md5_sql)),
    "p_values": (p_values, f"""WITH RECURSIVE gaps AS (SELECT {_GAP} AS x FROM lineitem WHERE l_linenumber = 7),
        {effect_sql.p_values('gaps', 'x', 'x')}
        SELECT round(t, 6) AS t, round(p_t, 6) AS p_t, round(CAST(w AS DOUBLE), 1) AS w, round(z, 6) AS z,
          round(p_wilcoxon, 6) AS p_wilcoxon FROM t_x, w_x"""),
    "effect_summary": (effect_summary, _SQL_EFFECT_SUMMARY),
    "t_statistic": (t_statistic, f"""SELECT count(*) AS n, round(avg(x), 6) AS mean,
        round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 6) AS t FROM (SELECT {_GAIN} AS x FROM lineitem)"""),
    "wilcoxon_statistic": (wilcoxon_statistic, _SQL_WILCOXON),
    "bootstrap_ci": (bootstrap_ci, _SQL_BOOTSTRAP),
    "winsorize": (winsorize, _SQL_WINSORIZE),
}
