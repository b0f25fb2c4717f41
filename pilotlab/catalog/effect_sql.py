"""Oracles of the effect models: ridge regression, the effects and both p-values in DuckDB's SQL."""

from __future__ import annotations

from ..plans import spec
from ..sources.bindings import MISSING_CATEGORY
from .common import EFFECT_BASE
from .profile import describe_sql

OUTCOMES = ("y_frequency", "y_amount")


def _list(columns: tuple[str, ...], form: str) -> str:
    return "[" + ", ".join(form.format(c=c) for c in columns) + "]"


# Models 0 and 1: all rows of an arm; 2 and 3: its rows outside the held-out fifth. Every model has the
# features of every client; a feature's first category and those it did not learn are left out.
# The normal equations are solved by elimination, one column a step, over a matrix in one list.
MODELS = f"""{EFFECT_BASE.replace('base AS (SELECT', 'base AS MATERIALIZED (SELECT')},
split AS MATERIALIZED (SELECT *, CAST('0x' || substr(md5(concat(client_id, ':42')), 1, 8) AS BIGINT) % 100 < 20 AS held FROM base),
uses AS MATERIALIZED (SELECT m, m % 2 = treated AND (m < 2 OR NOT held) AS learns, split.* FROM split, range(4) r(m)),
num AS MATERIALIZED (SELECT m, learns, client_id, unnest({_list(spec.EFFECT_NUMERIC, "'{c}'")}) AS f,
    unnest({_list(spec.EFFECT_NUMERIC, 'CAST({c} AS DOUBLE)')}) AS v FROM uses),
fills AS (SELECT m, f, coalesce(median(v) FILTER (learns), 0) AS fill FROM num GROUP BY m, f),
moments AS (SELECT m, f, any_value(fill) AS fill, avg(coalesce(v, fill)) FILTER (learns) AS mean,
    stddev_pop(coalesce(v, fill)) FILTER (learns) AS dev FROM num JOIN fills USING (m, f) GROUP BY m, f),
bool AS MATERIALIZED (SELECT m, learns, client_id, unnest({_list(spec.EFFECT_BOOLEAN, "'{c}'")}) AS f,
    unnest({_list(spec.EFFECT_BOOLEAN, 'CAST({c} AS DOUBLE)')}) AS v FROM uses),
modes AS (SELECT m, f, CASE WHEN avg(v) FILTER (learns) > 0.5 THEN 1.0 ELSE 0.0 END AS fill FROM bool GROUP BY m, f),
cat AS MATERIALIZED (SELECT m, learns, client_id, unnest({_list(spec.CATEGORICAL, "'{c}'")}) AS f,
    unnest({_list(spec.CATEGORICAL, f"coalesce(CAST({{c}} AS VARCHAR), '{MISSING_CATEGORY}')")}) AS level FROM uses),
levels AS (SELECT m, f, level FROM (SELECT DISTINCT m, f, level FROM cat WHERE learns)
    QUALIFY row_number() OVER (PARTITION BY m, f ORDER BY level) > 1),
long AS (
    SELECT m, learns, client_id, '1' AS f, 1.0::DOUBLE AS v FROM uses
    UNION ALL SELECT m, learns, client_id, f, (coalesce(v, fill) - mean) / CASE WHEN dev <= 1e-12 * greatest(1, abs(mean)) THEN 1 ELSE dev END
      FROM num JOIN moments USING (m, f)
    UNION ALL SELECT m, learns, client_id, f, coalesce(v, fill) FROM bool JOIN modes USING (m, f)
    UNION ALL SELECT m, learns, client_id, f || '=' || level, 1.0 FROM cat JOIN levels USING (m, f, level)),
features AS (SELECT m, f, row_number() OVER (PARTITION BY m ORDER BY f) - 1 AS j FROM (SELECT DISTINCT m, f FROM long)),
x AS MATERIALIZED (SELECT m, learns, client_id, j, f, v FROM long JOIN features USING (m, f)),
p AS (SELECT m, count(*) AS p FROM features GROUP BY m),
gram AS (
    SELECT a.m, a.j AS i, b.j, sum(a.v * b.v) + CASE WHEN a.j = b.j AND any_value(a.f) <> '1' THEN 1.0 ELSE 0.0 END AS g
      FROM x a JOIN x b ON a.m = b.m AND a.client_id = b.client_id WHERE a.learns GROUP BY a.m, a.j, b.j
    UNION ALL SELECT m, j, p + 0, sum(v * y_frequency) FROM x JOIN base USING (client_id) JOIN p USING (m) WHERE learns GROUP BY m, j, p
    UNION ALL SELECT m, j, p + 1, sum(v * y_amount) FROM x JOIN base USING (client_id) JOIN p USING (m) WHERE learns GROUP BY m, j, p),
matrix AS (SELECT m, p, list(coalesce(g, 0.0) ORDER BY i, j) AS a FROM (
    SELECT m, p, r.i, c.j FROM p, range(p) r(i), range(p + 2) c(j)) LEFT JOIN gram USING (m, i, j) GROUP BY m, p),
solved AS (
    SELECT m, p, 0 AS k, a FROM matrix
    UNION ALL SELECT m, p, k + 1, list_transform(range(p * (p + 2)), lambda t: CASE WHEN t // (p + 2) = k
        THEN a[t + 1] / a[k * (p + 2) + k + 1]
        ELSE a[t + 1] - a[t // (p + 2) * (p + 2) + k + 1] * a[k * (p + 2) + t % (p + 2) + 1] / a[k * (p + 2) + k + 1] END)
      FROM solved WHERE k < p),
weights AS MATERIALIZED (SELECT m, j, a[j * (p + 2) + p + 1] AS w_frequency, a[j * (p + 2) + p + 2] AS w_amount
    FROM solved JOIN features USING (m) WHERE k = p),
predicted AS MATERIALIZED (SELECT m, client_id, sum(v * w_frequency) AS e_frequency, sum(v * w_amount) AS e_amount
    FROM x JOIN weights USING (m, j) GROUP BY m, client_id)""".replace("WITH client", "WITH RECURSIVE client", 1)

HOLDOUT_R2 = f"""{MODELS}, judged AS (SELECT m, y_frequency, e_frequency, y_amount, e_amount
  FROM predicted JOIN split USING (client_id) WHERE m >= 2 AND treated = m - 2 AND held),
scores AS (SELECT m, """ + ", ".join(
    f"1 - sum((y_{y} - e_{y}) ** 2) / nullif(count(*) * var_pop(y_{y}), 0) AS r_{y}" for y in ("frequency", "amount")
) + """ FROM judged GROUP BY m)
SELECT CASE m WHEN 2 THEN 'control' ELSE 'treated' END AS arm, 'y_frequency' AS outcome, round(r_frequency, 6) AS r2 FROM scores
UNION ALL SELECT CASE m WHEN 2 THEN 'control' ELSE 'treated' END, 'y_amount', round(r_amount, 6) FROM scores"""

T_LEARNER = f"""{MODELS} SELECT client_id, round(e_frequency, 6) AS expected, round(y_frequency - e_frequency, 6) AS effect
  FROM predicted JOIN base USING (client_id) WHERE m = 0 AND treated = 1"""

CONDITIONAL = f"""{MODELS} SELECT a.client_id, round(b.e_frequency - a.e_frequency, 6) AS cate
  FROM predicted a JOIN predicted b ON a.client_id = b.client_id AND a.m = 0 AND b.m = 1"""

EFFECTS = f"""{MODELS}, ends AS (SELECT quantile_cont(y_amount, 0.01) AS lo, quantile_cont(y_amount, 0.99) AS hi FROM base WHERE treated = 1),
effects AS MATERIALIZED (SELECT client_id, y_frequency - e_frequency AS frequency, least(greatest(y_amount, lo), hi) - e_amount AS amount
  FROM predicted JOIN base USING (client_id), ends WHERE m = 0 AND treated = 1)"""


def simpson(form: str, low: str, high: str, steps: int = 20_000) -> str:
    """Integral of ``form`` (of ``u``) by Simpson's rule, as a scalar subquery."""
    return f"""(SELECT sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({form})) * ({high} - {low}) / {3 * steps}
      FROM (SELECT i, {low} + ({high} - {low}) * i / {steps} AS u FROM range({steps + 1}) s(i)))"""


def p_values(source: str, column: str, name: str) -> str:
    """CTEs ``t_name`` and ``w_name`` with statistics and two-sided p-values of ``column`` against zero.

    The t distribution is integrated over the angle whose tangent is t over the root of the degrees of
    freedom; the signed ranks are counted exactly up to 50 untied values, beyond they are normal.
    """
    t_tail = simpson("cos(u) ** (n - 2)", "atan(abs(t) / sqrt(n - 1))", "pi() / 2")
    t_all = simpson("cos(u) ** (n - 2)", "0", "pi() / 2")
    middle = simpson("exp(-u * u / 2) / sqrt(2 * pi())", "0", "abs(z)")
    return f"""ts_{name} AS (SELECT count({column}) AS n, avg({column}) / nullif(stddev_samp({column}) / sqrt(count({column})), 0) AS t FROM {source}),
t_{name} AS (SELECT t, CASE WHEN t IS NOT NULL AND n > 1 THEN {t_tail} / {t_all} END AS p_t FROM ts_{name}),
r_{name} AS (SELECT {column} AS x, (rank() OVER (ORDER BY abs({column})) * 2 + count(*) OVER (PARTITION BY abs({column})) - 1) / 2.0 AS r
  FROM {source} WHERE {column} <> 0),
s_{name} AS (SELECT count(*) AS n, least(sum(CASE WHEN x > 0 THEN r ELSE 0.0 END), sum(CASE WHEN x < 0 THEN r ELSE 0.0 END)) AS w,
    count(*) = count(DISTINCT abs(x)) AND (SELECT count(*) = 0 FROM {source} WHERE {column} = 0) AS untied FROM r_{name}),
z_{name} AS (SELECT *, (w - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1.0) * (2 * n + 1) / 24 -
    (SELECT coalesce(sum(CAST(c AS DOUBLE) ** 3 - c), 0) FROM (SELECT count(*) AS c FROM r_{name} GROUP BY abs(x))) / 48), 0) AS z FROM s_{name}),
c_{name} AS (SELECT 0 AS k, n, [1.0::DOUBLE] AS ways FROM s_{name}
  UNION ALL SELECT k + 1, n, list_transform(range((k + 1) * (k + 2) // 2 + 1), lambda s: coalesce(ways[s + 1], 0) +
      CASE WHEN s > k THEN coalesce(ways[s - k], 0) ELSE 0 END) FROM c_{name} WHERE k < n AND n <= 50),
w_{name} AS (SELECT w, z, CASE WHEN untied AND n BETWEEN 1 AND 50
    THEN (SELECT least(1.0, 2 * list_sum(ways[1:CAST(floor(w) AS BIGINT) + 1]) / list_sum(ways)) FROM c_{name} WHERE k = n)
    ELSE 1 - 2 * {middle} END AS p_wilcoxon FROM z_{name})"""


def _interval(name: str, draws: str) -> str:
    return f"""d_{name} AS (SELECT r, {name} AS x, CASE {draws} ELSE 18 END AS w FROM (
    SELECT r, {name}, CAST((h * a + b) % 2147483647 AS DOUBLE) / 2147483647 AS u FROM hashed, replicates)),
m_{name} AS (SELECT r, sum(x * w) / nullif(sum(w), 0) AS mean FROM d_{name} GROUP BY r),
i_{name} AS (SELECT quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM m_{name})"""


def decision(hashed: str, draws: str, hash_of) -> str:
    """The decision of both outcomes; draws as in the bootstrap."""
    parts, rows = [], []
    for name in ("frequency", "amount"):
        parts += [p_values("effects", name, name), _interval(name, draws)]
        summary = describe_sql("effects", [name]).replace(f"'{name}' AS variable", f"'y_{name}' AS variable")
        rows.append(f"""SELECT d.*, (SELECT round(avg(CASE WHEN {name} > 0 THEN 100.0 ELSE 0.0 END), 4) FROM effects) AS pct_positive,
  round(t, 4) AS t, round(p_t, 6) AS p_t, round(CAST(w AS DOUBLE), 1) AS w, round(z, 4) AS z, round(p_wilcoxon, 6) AS p_wilcoxon,
  round(ci_low, 3) AS ci_low, round(ci_high, 3) AS ci_high, coalesce(p_t < 0.05 OR p_wilcoxon < 0.05, false) AS significant,
  ci_low > 0 OR ci_high < 0 AS interval_excludes_zero
FROM ({summary}) d, t_{name}, w_{name}, i_{name}""")
    return f"""{EFFECTS}, hashed AS (SELECT {hashed} AS h, * FROM effects),
replicates AS (SELECT r, {hash_of("concat('a', r, ':42')")} % 2147483646 + 1 AS a, {hash_of("concat('b', r, ':42')")} AS b FROM range(2000) t(r)),
{", ".join(parts)}
""" + "\nUNION ALL ".join(rows)
