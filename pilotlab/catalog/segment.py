"""Queries of the segmentation table and model, each with its oracle where SQL has one."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, ranking
from ..plans import segment_base as sb
from ..plans import segment_model as sm
from ..plans.spec import PRIORITY_COLUMNS, SEGMENT_NUMERIC
from ..sources.tables import BucketedStore, cut_lineage, stage_path, write_table
from ..streaming.scoring import request_stream, scored, start_scoring
from .common import ELIGIBLE, SEGMENT, SEGMENT_BASE, load, rounded, trusted
from .profile import describe_sql


def eligible_client_rates(spark: SparkSession, sf: str) -> DataFrame:
    client, card, tx, _ = trusted(spark, sf)
    rates = sb.transaction_rates(client, card, tx, SEGMENT)
    return rounded(rates, {"monthly_frequency": 6, "monthly_amount": 4})


_SQL_RATES = f"""{SEGMENT_BASE} SELECT e.client_id, coalesce(etx.n, 0) AS n_transactions,
  round(coalesce(etx.n, 0) / observed_months, 6) AS monthly_frequency,
  round(CAST(coalesce(etx.total, 0) AS DOUBLE) / observed_months, 4) AS monthly_amount
FROM eligible e LEFT JOIN etx USING (client_id)"""


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return sb.segment_features(*trusted(spark, sf), SEGMENT)


_DIGITS = {"age_years": 6, "monthly_frequency": 6, "monthly_amount": 4, "monthly_contacts": 6, "response_rate": 6}


def segment_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_features(spark, sf), _DIGITS)


_SQL_SEGMENT = f"""{SEGMENT_BASE} SELECT client_id, round(age_years, 6) AS age_years, tenure_days,
  round(monthly_frequency, 6) AS monthly_frequency, round(CAST(monthly_amount AS DOUBLE), 4) AS monthly_amount,
  type_diversity, round(monthly_contacts, 6) AS monthly_contacts, round(response_rate, 6) AS response_rate,
  has_active_virtual, virtual_card_days, city, acquisition_channel FROM base"""


def eligibility_report(spark: SparkSession, sf: str) -> DataFrame:
    client, card, tx, _ = trusted(spark, sf)
    return rounded(sb.eligibility_counts(client, card, tx, SEGMENT), {"pct": 6})


_SQL_ELIGIBILITY = f"""{ELIGIBLE}, n AS (SELECT (SELECT count(*) FROM client) AS n0,
  (SELECT count(*) FROM client WHERE client_id NOT IN (SELECT client_id FROM owner)) AS n1,
  (SELECT count(*) FROM client WHERE client_id NOT IN (SELECT client_id FROM owner) AND NOT flag_minor) AS n2,
  (SELECT count(*) FROM eligible) AS n3)
SELECT 'client' AS "table", CAST(1 AS BIGINT) AS stage, 'has or had a physical card' AS reason, n0 AS n_before,
  n0 - n1 AS n_excluded, round((n0 - n1) * 100.0 / n0, 6) AS pct FROM n
UNION ALL SELECT 'client', 2, 'minor at registration', n1, n1 - n2, round((n1 - n2) * 100.0 / n1, 6) FROM n
UNION ALL SELECT 'client', 3, 'tenure too short', n2, n2 - n3, round((n2 - n3) * 100.0 / n2, 6) FROM n"""


def observation_window_coverage(spark: SparkSession, sf: str) -> DataFrame:
    client, card, tx, _ = trusted(spark, sf)
    coverage = sb.window_coverage(cut_lineage(sb.eligible_clients(client, card, tx, SEGMENT)), SEGMENT)
    return rounded(coverage, {c: 4 for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


_SQL_COVERAGE = f"""{ELIGIBLE} SELECT d.*, (SELECT count(*) FROM eligible WHERE observed_days >= 365) AS n_full_window
FROM ({describe_sql('eligible', ['observed_months'])}) d"""


def priority_score(spark: SparkSession, sf: str) -> DataFrame:
    scored = ranking.with_priority_score(cut_lineage(_features(spark, sf)), PRIORITY_COLUMNS)
    return scored.select("client_id", F.round("priority_score", 5).alias("priority_score"))


_Z = " + ".join(
    f"coalesce(({c} - (SELECT avg({c}) FROM base)) / nullif((SELECT stddev_samp({c}) FROM base), 0), 0)"
    for c in PRIORITY_COLUMNS
)
_SCORED = f"""{SEGMENT_BASE.replace('base AS (', 'base AS MATERIALIZED (')},
scored AS (SELECT *, {_Z} AS score FROM base)"""


def rank_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Acquisition channels ranked and labelled by the mean score of their clients."""
    scored = ranking.with_priority_score(cut_lineage(_features(spark, sf)), PRIORITY_COLUMNS)
    ranked = ranking.rank_clusters(scored, "acquisition_channel", "priority_score")
    return rounded(ranked, {"mean_score": 5}).withColumn("rank", F.col("rank").cast("bigint"))


_SQL_RANK = f"""{_SCORED} SELECT acquisition_channel, n, round(mean_score, 5) AS mean_score, place AS rank,
  CASE WHEN k <= 5 THEN ['alto_potencial', 'medio_alto', 'medio', 'medio_bajo', 'bajo_potencial'][place]
    ELSE 'prioridad_' || place END AS segment
FROM (SELECT *, row_number() OVER (ORDER BY mean_score DESC) AS place, count(*) OVER () AS k
  FROM (SELECT acquisition_channel, count(*) AS n, avg(score) AS mean_score FROM scored GROUP BY 1))"""


def label_segments(spark: SparkSession, sf: str) -> DataFrame:
    scored = ranking.with_priority_score(cut_lineage(_features(spark, sf)), PRIORITY_COLUMNS)
    labelled = ranking.label_clusters(scored, "city", "priority_score")
    return labelled.select("client_id", "city", "segment")


_SQL_LABEL = f"""{_SCORED}, means AS (SELECT city, avg(score) AS m FROM scored GROUP BY city),
places AS (SELECT city, row_number() OVER (ORDER BY m DESC) AS place FROM means)
SELECT client_id, city, 'prioridad_' || place AS segment FROM scored JOIN places USING (city)"""


def cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["tenure_days", "monthly_frequency", "monthly_amount", "response_rate"]
    profile = cluster.cluster_profile(_features(spark, sf), "acquisition_channel", columns)
    return rounded(profile, {c: 4 for c in columns})


_SQL_PROFILE = f"""{SEGMENT_BASE} SELECT acquisition_channel, count(*) AS n, round(avg(tenure_days), 4) AS tenure_days,
  round(avg(monthly_frequency), 4) AS monthly_frequency, round(avg(monthly_amount), 4) AS monthly_amount,
  round(avg(response_rate), 4) AS response_rate FROM base GROUP BY acquisition_channel"""


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("x")
    )


def assign_nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector to the nearest mean vector of the labels."""
    vectors = _vectors(spark, sf)
    means = (
        vectors.select("label", F.posexplode("x").alias("i", "v"))
        .groupBy("label", "i").agg(F.avg("v").alias("v"))
        .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
    )
    centroids = [(r["label"], [p["v"] for p in r["c"]]) for r in means.orderBy("label").collect()]
    return vectors.select("vec_id", cluster.nearest_centroid(F.col("x"), centroids).alias("nearest"))


_SQL_NEAREST = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT label, i, avg(x[i]) AS m FROM v, range(1, (SELECT max(len(x)) FROM v) + 1) r(i) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY label)
SELECT vec_id, arg_min(c.label, list_distance(x, c)) AS nearest FROM v, c GROUP BY vec_id"""


def silhouette_squared(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf).select(array_to_vector("x").alias("features"), F.col("label").alias("prediction"))
    value, measure = cluster.silhouette(rows.persist())
    rows.unpersist()
    return spark.createDataFrame([(round(value, 6), measure)], "silhouette double, measure string")


_SQL_SILHOUETTE = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT label, count(*) AS size FROM v GROUP BY label),
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x) ** 2) AS total
  FROM v a, v b GROUP BY ALL),
s AS (SELECT vec_id, own, any_value(o.size) AS own_size,
    sum(total) FILTER (own = other) / nullif(any_value(o.size) - 1, 0) AS a, min(total / n.size) FILTER (own <> other) AS b
  FROM d JOIN n ON n.label = other JOIN n o ON o.label = own GROUP BY vec_id, own)
SELECT round(avg(CASE WHEN own_size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
  'squaredEuclidean' AS measure FROM s"""


def kmeans_segments(spark: SparkSession, sf: str) -> DataFrame:
    return sm.segment_clients(cut_lineage(_features(spark, sf))).clients.select(
        "client_id", "cluster_id", "segment", F.round("priority_score", 4).alias("priority_score")
    )


def choose_k(spark: SparkSession, sf: str) -> DataFrame:
    base = cut_lineage(_features(spark, sf))
    return sm.segment_clients(base).choice.table(base)


def score_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Clients outside the trained population scored with the stored statistics of that population."""
    base = cut_lineage(_features(spark, sf))
    trained = sm.segment_clients(base.where(F.col("acquisition_channel") != "MACHINERY"), (4,), starts=2)
    return trained.model.score(base.where(F.col("acquisition_channel") == "MACHINERY")).select(
        "client_id", "cluster_id", "segment", "priority_score"
    )


def score_new_priority(spark: SparkSession, sf: str) -> DataFrame:
    """The priority part of ``score_new_rows``, which does not depend on the clusters found."""
    return score_new_rows(spark, sf).select("client_id", "priority_score")


_NEW_Z = " + ".join(
    f"coalesce(({c} - (SELECT avg({c}) FROM trained)) / nullif((SELECT stddev_samp({c}) FROM trained), 0), 0)"
    for c in PRIORITY_COLUMNS
)
_SQL_NEW = f"""{SEGMENT_BASE.replace('base AS (', 'base AS MATERIALIZED (')},
trained AS (SELECT * FROM base WHERE acquisition_channel <> 'MACHINERY')
SELECT client_id, round({_NEW_Z}, 4) AS priority_score FROM base WHERE acquisition_channel = 'MACHINERY'"""


# Groups by client number, far apart in every number of the segmentation table, of one city and one state of
# the card each: the clusters are known. Channels are as they were.
PLANTED = 4


def _planted_value(column: str, place: int) -> str:
    """The column, squeezed to less than one around zero, moved by its group's own multiple of twenty."""
    x = f"coalesce(CAST({column} AS DOUBLE), 0e0)"
    return f"{x} / (1e0 + abs({x})) + 20e0 * (((client_id % {PLANTED} + 1) * {place + 3}) % 11)"


_PLANTED_COLUMNS = [
    *[f"{_planted_value(c, i)} AS {c}" for i, c in enumerate(SEGMENT_NUMERIC)],
    f"concat('city', client_id % {PLANTED}) AS city", f"CAST(client_id % {PLANTED} < 2 AS DOUBLE) AS has_active_virtual",
]


def _planted(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(_features(spark, sf).selectExpr("client_id", "acquisition_channel", *_PLANTED_COLUMNS))


def planted_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster, label and score of every client where the clusters are known."""
    return sm.segment_clients(_planted(spark, sf)).clients.select(
        "client_id", "cluster_id", "segment", F.round("priority_score", 4).alias("priority_score")
    )


def planted_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen number of known clusters with its silhouette."""
    base = _planted(spark, sf)
    chosen = sm.segment_clients(base).choice.table(base).where("chosen")
    return rounded(chosen, {"silhouette": 5})


def planted_centers(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and means of the known clusters in the features' own units."""
    return rounded(sm.segment_clients(_planted(spark, sf), (PLANTED,)).profile(), {c: 6 for c in SEGMENT_NUMERIC})


def planted_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster, label and score of clients outside the trained population."""
    base = _planted(spark, sf)
    trained = sm.segment_clients(base.where(F.col("acquisition_channel") != "MACHINERY"), (PLANTED,), starts=4)
    return trained.model.score(base.where(F.col("acquisition_channel") == "MACHINERY")).select(
        "client_id", "cluster_id", "segment", "priority_score"
    )


def _planted_sql(trained: str) -> str:
    z = " + ".join(
        f"coalesce(({c} - (SELECT avg({c}) FROM trained)) / nullif((SELECT stddev_samp({c}) FROM trained), 0), 0)"
        for c in PRIORITY_COLUMNS
    )
    return f"""{SEGMENT_BASE}, planted AS MATERIALIZED (SELECT client_id, client_id % {PLANTED} AS g, acquisition_channel,
    {', '.join(_PLANTED_COLUMNS)} FROM base),
trained AS MATERIALIZED (SELECT * FROM planted WHERE {trained}),
scored AS MATERIALIZED (SELECT *, {z} AS score FROM planted),
places AS (SELECT g, CAST(row_number() OVER (ORDER BY avg(score) DESC) AS INTEGER) AS place FROM scored WHERE {trained} GROUP BY g)"""


_LABELLED = """client_id, place - 1 AS cluster_id, ['alto_potencial', 'medio_alto', 'medio', 'medio_bajo'][place] AS segment,
  round(score, 4) AS priority_score FROM scored JOIN places USING (g)"""
_SQL_PLANTED = f"{_planted_sql('true')} SELECT {_LABELLED}"
_SQL_PLANTED_NEW = f"""{_planted_sql("acquisition_channel <> 'MACHINERY'")} SELECT {_LABELLED}
WHERE acquisition_channel = 'MACHINERY'"""
_SQL_PLANTED_CENTERS = f"""{_planted_sql('true')} SELECT place - 1 AS cluster_id, count(*) AS n,
  {', '.join(f'round(avg({c}), 6) AS {c}' for c in SEGMENT_NUMERIC)} FROM planted JOIN places USING (g) GROUP BY place"""
# Sums of squared distances to a cluster follow from its size, its sums and its squared lengths.
_SQL_PLANTED_CHOICE = f"""{_planted_sql('true')},
levels AS (SELECT 'c=' || city AS j FROM (SELECT DISTINCT city FROM planted) QUALIFY row_number() OVER (ORDER BY city) > 1
  UNION ALL SELECT 'a=' || acquisition_channel FROM (SELECT DISTINCT acquisition_channel FROM planted)
    QUALIFY row_number() OVER (ORDER BY acquisition_channel) > 1),
raw AS (SELECT client_id, g, unnest([{', '.join(f"'{c}'" for c in SEGMENT_NUMERIC)}]) AS j, unnest([{', '.join(SEGMENT_NUMERIC)}]) AS v FROM planted),
scale AS (SELECT j, avg(v) AS m, stddev_pop(v) AS d FROM raw GROUP BY j),
x AS MATERIALIZED (SELECT client_id, g, j, (v - m) / CASE WHEN d <= 1e-12 * greatest(1, abs(m)) THEN 1 ELSE d END AS v FROM raw JOIN scale USING (j)
  UNION ALL SELECT client_id, g, 'c=' || city, 1.0 FROM planted WHERE 'c=' || city IN (SELECT j FROM levels)
  UNION ALL SELECT client_id, g, 'a=' || acquisition_channel, 1.0 FROM planted WHERE 'a=' || acquisition_channel IN (SELECT j FROM levels)
  UNION ALL SELECT client_id, g, 'virtual', has_active_virtual FROM planted),
sums AS (SELECT g, j, sum(v) AS s FROM x GROUP BY g, j),
sizes AS (SELECT g, count(DISTINCT client_id) AS n, sum(v * v) AS q FROM x GROUP BY g),
own AS (SELECT client_id, g, sum(v * v) AS q FROM x GROUP BY client_id, g),
dots AS (SELECT client_id, sums.g AS other, sum(v * s) AS d FROM x JOIN sums USING (j) GROUP BY client_id, sums.g),
far AS (SELECT o.client_id, o.g, other, z.n, z.n * o.q - 2 * d + z.q AS total FROM own o JOIN dots USING (client_id) JOIN sizes z ON z.g = other),
ab AS (SELECT client_id, sum(total / nullif(n - 1, 0)) FILTER (g = other) AS a, min(total / n) FILTER (g <> other) AS b FROM far GROUP BY client_id)
SELECT CAST({PLANTED} AS INTEGER) AS k, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette,
  'squaredEuclidean' AS measure, true AS chosen FROM ab"""


def model_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose score changes when the model is saved and loaded: all counts should agree."""
    base = cut_lineage(_features(spark, sf))
    model = sm.segment_clients(base, (3,), starts=2).model
    folder = stage_path(spark, "model")
    model.save(spark, folder)
    before = model.score(base).select("client_id", "cluster_id", "segment", "priority_score")
    after = sm.SegmentModel.load(spark, folder).score(base)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("cluster_id", "segment", "priority_score")]
    return before.alias("a").join(after.alias("b"), "client_id").agg(
        F.count("*").alias("n"), F.count_if(same[0] & same[1] & same[2]).alias("n_same")
    )


def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Clients of known clusters as JSON requests through the scoring stream, in several batches; some lack a
    field and are rejected. One row for each request."""
    base = _planted(spark, sf)
    model = sm.segment_clients(base, (PLANTED,), starts=4).model
    folder = stage_path(spark, "stream")
    whole, partial = (F.struct("client_id", *model.required[k:]) for k in (0, 1))
    body = F.when(F.col("client_id") % 10 == 0, F.to_json(partial, {"ignoreNullFields": "false"})).otherwise(
        F.to_json(whole, {"ignoreNullFields": "false"})
    )
    base.select(body.alias("value")).repartition(4).write.text(f"{folder}/requests")
    requests = request_stream(spark, f"{folder}/requests", files_per_trigger=2)
    start_scoring(requests, model, f"{folder}/out", f"{folder}/state").awaitTermination()
    client = F.get_json_object("value", "$.client_id").cast("bigint").alias("client_id")
    good = scored(spark, f"{folder}/out").select(
        client, F.lit("scored").alias("status"), "cluster_id", "segment", "priority_score", F.lit("").alias("missing")
    )
    bad = scored(spark, f"{folder}/out", "rejected").select(
        client, F.lit("rejected"), F.lit(-1), F.lit(""), F.lit(0.0), F.array_join("missing", ",")
    )
    return good.union(bad)


_SQL_STREAM = f"""{_planted_sql('true')} SELECT client_id, CASE WHEN client_id % 10 = 0 THEN 'rejected' ELSE 'scored' END AS status,
  CAST(CASE WHEN client_id % 10 = 0 THEN -1 ELSE place - 1 END AS INTEGER) AS cluster_id,
  CASE WHEN client_id % 10 = 0 THEN '' ELSE ['alto_potencial', 'medio_alto', 'medio', 'medio_bajo'][place] END AS segment,
  CASE WHEN client_id % 10 = 0 THEN 0.0 ELSE round(score, 4) END AS priority_score,
  CASE WHEN client_id % 10 = 0 THEN '{sm.SEGMENT_FEATURES.all[0]}' ELSE '' END AS missing
FROM scored JOIN places USING (g)"""


def reject_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as JSON requests; some lack a field, some hold a value of the wrong type."""
    body = F.concat(
        F.lit('{"age_years": '),
        F.when(F.col("c_custkey") % 7 == 0, F.lit('"abc"')).when(F.col("c_custkey") % 7 == 1, F.lit("null"))
        .when(F.col("c_custkey") % 7 == 2, F.lit('{"x": 1}')).otherwise(F.col("c_acctbal").cast("string")),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.lit(', "city": "x"')), F.lit("}"),
    )
    requests = load(spark, sf, "customer").select("c_custkey", body.alias("value"))
    valid, rejected = sm.parse_requests(requests, "value", ("age_years", "city"))
    return valid.select(
        "c_custkey", F.lit(True).alias("accepted"), F.lit("").alias("missing"), F.lit("").alias("unreadable")
    ).union(rejected.select(
        "c_custkey", F.lit(False), F.array_join("missing", ","), F.array_join("unreadable", ",")
    ))


_SQL_REJECT = """SELECT c_custkey, c_custkey % 5 <> 0 AND c_custkey % 7 NOT IN (0, 2) AS accepted,
  CASE WHEN c_custkey % 5 = 0 THEN 'city' ELSE '' END AS missing,
  CASE WHEN c_custkey % 7 IN (0, 2) THEN 'age_years' ELSE '' END AS unreadable FROM customer"""


def lookup_clients(spark: SparkSession, sf: str) -> DataFrame:
    """Stored scores for every client id that occurs in the events or orders, as text."""
    client, card, tx, _ = trusted(spark, sf)
    stored = sb.transaction_rates(client, card, tx, SEGMENT).select("client_id", "n_transactions")
    requests = (
        load(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("client_id"))
        .union(load(spark, sf, "events").select((F.col("user_id") + 5_000_000).cast("string")))
        .distinct()
    )
    found = sm.lookup_clients(requests, stored)
    return found.withColumn("n_transactions", F.coalesce("n_transactions", F.lit(-1)).cast("bigint"))


def bucketed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a bucketed store, to which only the requests are shuffled."""
    client, card, tx, _ = trusted(spark, sf)
    store = BucketedStore(stage_path(spark, "lookup"), 8)
    store.save(sb.transaction_rates(client, card, tx, SEGMENT).select("client_id", "n_transactions"), "client_id")
    requests = (
        load(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("client_id"))
        .union(load(spark, sf, "events").select((F.col("user_id") + 5_000_000).cast("string")))
        .distinct()
    )
    return store.many(requests, "client_id").withColumn("n_transactions", F.coalesce("n_transactions", F.lit(-1)).cast("bigint"))


_SQL_LOOKUP = f"""{SEGMENT_BASE}, wanted AS (SELECT CAST(o_custkey AS VARCHAR) AS client_id FROM orders
  UNION SELECT CAST(user_id + 5000000 AS VARCHAR) FROM events)
SELECT w.client_id, e.client_id IS NOT NULL AS found,
  CASE WHEN e.client_id IS NULL THEN -1 ELSE coalesce(etx.n, 0) END AS n_transactions
FROM wanted w LEFT JOIN eligible e ON CAST(e.client_id AS VARCHAR) = w.client_id
LEFT JOIN etx ON etx.client_id = e.client_id"""


def write_and_read(spark: SparkSession, sf: str) -> DataFrame:
    """The segmentation table written as Parquet, replaced once, and read back."""
    path = f"{stage_path(spark, 'table')}/segment_base.parquet"
    write_table(spark.range(1), path)
    write_table(_features(spark, sf), path)
    return rounded(spark.read.parquet(path), _DIGITS)


QUERIES = {
    "eligible_client_rates": (eligible_client_rates, _SQL_RATES),
    "segment_features": (segment_features, _SQL_SEGMENT),
    "eligibility_report": (eligibility_report, _SQL_ELIGIBILITY),
    "observation_window_coverage": (observation_window_coverage, _SQL_COVERAGE),
    "priority_score": (priority_score, f"{_SCORED} SELECT client_id, round(score, 5) AS priority_score FROM scored"),
    "rank_segments": (rank_segments, _SQL_RANK),
    "label_segments": (label_segments, _SQL_LABEL),
    "cluster_profile": (cluster_profile, _SQL_PROFILE),
    "assign_nearest_centroid": (assign_nearest_centroid, _SQL_NEAREST),
    "silhouette_squared": (silhouette_squared, _SQL_SILHOUETTE),
    "kmeans_segments": (kmeans_segments, None),
    "choose_k": (choose_k, None),
    "score_new_rows": (score_new_rows, None),
    "planted_segments": (planted_segments, _SQL_PLANTED),
    "planted_choice": (planted_choice, _SQL_PLANTED_CHOICE),
    "planted_centers": (planted_centers, _SQL_PLANTED_CENTERS),
    "planted_scoring": (planted_scoring, _SQL_PLANTED_NEW),
    "score_new_priority": (score_new_priority, _SQL_NEW),
    "model_round_trip": (model_round_trip, f"{ELIGIBLE} SELECT count(*) AS n, count(*) AS n_same FROM eligible"),
    "stream_scores": (stream_scores, _SQL_STREAM),
    "reject_requests": (reject_requests, _SQL_REJECT),
    "lookup_clients": (lookup_clients, _SQL_LOOKUP),
    "bucketed_lookup": (bucketed_lookup, _SQL_LOOKUP),
    "write_and_read": (write_and_read, _SQL_SEGMENT),
}
