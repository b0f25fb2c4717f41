"""Ridge, T-learner, segmentation and scoring against direct computations."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pilotlab.operators import cluster, ranking, ridge
from pilotlab.operators.features import FeatureColumns, fit_features, with_features
from pilotlab.plans import effect_model, segment_model
from pilotlab.plans.spec import EFFECT_BOOLEAN, EFFECT_NUMERIC, SEGMENT_NUMERIC
from pilotlab.sources.tables import BucketedStore
from pilotlab.streaming.scoring import batch_writer, request_stream, scored, start_scoring


@pytest.fixture(scope="module")
def clients(spark):
    """Random segmentation rows with some nulls."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(3, len(SEGMENT_NUMERIC))) * 4
    rows = []
    for i in range(240):
        numeric = [float(v) for v in centers[i % 3] + rng.normal(size=len(SEGMENT_NUMERIC))]
        if i % 40 == 5:
            numeric[4] = None
        city = None if i % 50 == 7 else f"city{i % 4}"
        rows.append((i, *numeric, city, ["app", "web"][i % 2], float(i % 5 != 0)))
    columns = ["client_id", *SEGMENT_NUMERIC, "city", "acquisition_channel", "has_active_virtual"]
    types = ["long", *["double"] * len(SEGMENT_NUMERIC), "string", "string", "double"]
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(columns, types)))


def vectors(df):
    return np.array([r["features"].toArray() for r in df.orderBy("client_id").collect()])


def test_features(spark, clients):
    columns = segment_model.SEGMENT_FEATURES
    x = vectors(with_features(clients, fit_features(clients, columns)))
    pdf = clients.orderBy("client_id").toPandas()
    expected = []
    for c in columns.numeric:
        v = pdf[c].fillna(pdf[c].median())
        expected.append((v - v.mean()) / v.std(ddof=0))
    for c in columns.categorical:
        v = pdf[c].fillna("desconocido")
        expected += [(v == level).astype(float) for level in sorted(v.unique())[1:]]
    expected.append(pdf["has_active_virtual"])
    assert np.allclose(x, np.array(expected).T)


def test_features_of_unknown_and_constant_values(spark):
    train = spark.createDataFrame([(1, 5.0, "a", True), (2, 5.0, "b", True), (3, None, "c", None)],
                                  "client_id long, x double, c string, b boolean")
    prepared = fit_features(train, FeatureColumns(("x",), ("c",), ("b",)))
    new = spark.createDataFrame([(1, 7.0, "z", False), (2, None, None, None), (3, 5.0, "c", True)], train.schema)
    assert vectors(with_features(new, prepared)).tolist() == [
        [2.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 1.0, 1.0]
    ]


def solve_ridge(x, y, alpha):
    centered = x - x.mean(axis=0)
    w = np.linalg.solve(centered.T @ centered + alpha * np.eye(x.shape[1]), centered.T @ (y - y.mean()))
    return w, y.mean() - x.mean(axis=0) @ w


def test_ridge(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5)) + [0, 5, 0, 1, 0]
    y = x @ [1.0, -2.0, 0.0, 3.0, 0.5] + rng.normal(size=80) + 10
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, y double")
    model = ridge.fit_ridge(df.select(array_to_vector("x").alias("features"), "y"), "y", alpha=7.0)
    w, b = solve_ridge(x, y, 7.0)
    assert np.allclose(model.coefficients.toArray(), w) and model.intercept == pytest.approx(b)


def test_ridge_on_many_categories(spark):
    """Wider than the normal-equation solver takes: the iterative one finds the same minimum."""
    n = ridge.NORMAL_FEATURES + 300
    df = spark.range(3 * n).select(
        (F.col("id") % n).cast("string").alias("c"), ((F.col("id") % 7) + (F.col("id") % n) / F.lit(float(n))).alias("y")
    )
    ready = with_features(df, fit_features(df, FeatureColumns((), ("c",)))).persist()
    model = ridge.fit_ridge(ready, "y", alpha=1.0)
    assert model.numFeatures == n - 1
    # With one dummy a row, each coefficient is its level's residual sum over its size plus the penalty.
    rows = ready.select("features", "y").collect()
    hot = np.array([r["features"].indices[0] if len(r["features"].indices) else -1 for r in rows])
    y = np.array([r["y"] for r in rows])
    w, b = model.coefficients.toArray(), model.intercept
    sums = np.bincount(hot + 1, weights=y - b, minlength=n)[1:]
    assert np.allclose(w, sums / 4, atol=2e-3)
    ready.unpersist()


def test_features_of_a_column_without_numbers(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 4.0)], "client_id long, x double, z double")
    assert vectors(with_features(df, fit_features(df, FeatureColumns(("x", "z"))))).tolist() == [[0.0, -1.0], [0.0, 1.0]]


@pytest.fixture(scope="module")
def causal(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        numeric = [float(v) for v in rng.normal(size=len(EFFECT_NUMERIC))]
        arm = int(i % 3 == 0)
        y = numeric[0] + 2 * numeric[1] + 1.5 * arm + rng.normal() * 0.1
        rows.append((i, arm, *numeric, f"city{i % 3}", "app", i % 2 == 0, i % 7 != 0, float(y), float(100 * y)))
    names = ["client_id long", "treated int", *[f"{c} double" for c in EFFECT_NUMERIC], "city string",
             "acquisition_channel string", *[f"{c} boolean" for c in EFFECT_BOOLEAN], "y_frequency double",
             "y_amount double"]
    return spark.createDataFrame(rows, ", ".join(names))


def test_effect_against_numpy(spark, causal):
    result = effect_model.measure_effect(causal, replicates=200)
    found = {r["client_id"]: r["effect"] for r in result.effects["y_frequency"].collect()}
    control = causal.where("treated = 0")
    prepared = fit_features(control, effect_model.EFFECT_FEATURES)
    y = np.array([r[0] for r in control.orderBy("client_id").select("y_frequency").collect()])
    w, b = solve_ridge(vectors(with_features(control, prepared)), y, 1.0)
    treated = causal.where("treated = 1").orderBy("client_id")
    actual = np.array([r[0] for r in treated.select("y_frequency").collect()])
    expected = actual - (vectors(with_features(treated, prepared)) @ w + b)
    ids = [r[0] for r in treated.select("client_id").collect()]
    assert np.allclose([found[i] for i in ids], expected)

    rows = {r["variable"]: r for r in result.decisions.collect()}
    row = rows["y_frequency"]
    assert row["mean"] == pytest.approx(expected.mean()) and row["q50"] == pytest.approx(np.median(expected))
    assert row["significant"] and row["interval_excludes_zero"] and row["ci_low"] < row["mean"] < row["ci_high"]
    assert row["pct_positive"] == pytest.approx((expected > 0).mean() * 100)
    assert {(r["arm"], r["outcome"]) for r in result.learner.r2.collect()} == {
        (a, o) for a in ("control", "treated") for o in ("y_frequency", "y_amount")
    }
    assert all(r["r2"] > 0.8 for r in result.learner.r2.collect())
    cate = result.learner.conditional_effect(causal, "y_frequency").agg(F.avg("cate")).first()[0]
    assert cate == pytest.approx(1.5, abs=0.2)


def test_effect_does_not_depend_on_layout(spark, causal):
    runs = []
    for layout in (causal.repartition(1), causal.repartition(13).orderBy(F.desc("client_id"))):
        learner = ridge.fit_t_learner(
            layout, "treated", "client_id", effect_model.EFFECT_FEATURES, ["y_frequency"]
        )
        runs.append(sorted((r["arm"], round(r["r2"], 8)) for r in learner.r2.collect()))
    assert runs[0] == runs[1]


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 4)) + (np.arange(120) % 3)[:, None] * 1.5
    c = np.arange(120) % 3
    c[0] = 9
    df = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, c)], "x array<double>, prediction int")
    df = df.select(array_to_vector("x").alias("features"), "prediction")
    distance = np.linalg.norm(x[:, None] - x[None], axis=2) ** 2
    values = []
    for i in range(120):
        own = (c == c[i]).sum()
        if own == 1:
            values.append(0.0)
            continue
        a = distance[i, c == c[i]].sum() / (own - 1)
        b = min(distance[i, c == k].mean() for k in set(c) if k != c[i])
        values.append((b - a) / max(a, b))
    value, measure = cluster.silhouette(df)
    assert value == pytest.approx(np.mean(values)) and measure == "squaredEuclidean"


def lloyd(x, centers):
    while True:
        nearest = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[nearest == i].mean(axis=0) if (nearest == i).any() else centers[i] for i in range(len(centers))])
        if np.allclose(moved, centers, atol=1e-12):
            return ((x - centers[nearest]) ** 2).sum()
        centers = moved


def test_kmeans_against_plain_restarts(spark):
    """No separation: the cost of ten starts is about the least that plain restarts find."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(6)
    found = cluster.best_kmeans(df, (2, 5), starts=10)
    for k, best in found.items():
        nearest = ((x[:, None] - best.points) ** 2).sum(axis=2)
        assert best.cost == pytest.approx(nearest.min(axis=1).sum())
        plain = min(lloyd(x, x[rng.choice(len(x), k, replace=False)]) for _ in range(25))
        assert best.cost <= 1.02 * plain
    again = cluster.best_kmeans(df.repartition(1).sort("features"), (2, 5), starts=10)
    assert all(np.allclose(again[k].points, found[k].points) for k in found)


def test_kmeans_sees_rows_outside_the_sample(spark, monkeypatch):
    """First centres come from few rows, costs and silhouettes from all."""
    monkeypatch.setattr(cluster, "START_ROWS", 50)
    rng = np.random.default_rng(14)
    group = np.arange(3000) % 3
    x = rng.normal(size=(3000, 2)) * 0.2 + np.array([[0, 0], [5, 0], [0, 5]])[group]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(6)
    choice = cluster.choose_k(df, (2, 3, 4), starts=4)
    assert choice.k == 3
    expected = sorted(x[group == g].mean(axis=0).round(6).tolist() for g in range(3))
    assert sorted(choice.model.points.round(6).tolist()) == expected
    rows = choice.model.assign(df).select(array_to_vector("features").alias("features"), "prediction")
    assert dict((k, s) for k, s, _ in choice.scores)[3] == pytest.approx(cluster.silhouette(rows)[0])


def test_kmeans_of_few_distinct_rows(spark):
    df = spark.createDataFrame([([1.0, 1.0],)] * 5 + [([2.0, 2.0],)] * 3, "features array<double>")
    best = cluster.best_kmeans(df, (3,), starts=2)[3]
    assert sorted(best.points.tolist()) == [[1.0, 1.0], [2.0, 2.0]] and best.cost == 0
    assert cluster.silhouettes(df, {3: best})[3] == 1.0
    one = cluster.best_kmeans(df.limit(3), (2,), starts=1)
    assert cluster.silhouettes(df.limit(3), one) == {2: None}
    with pytest.raises(ValueError, match="no rows"):
        cluster.best_kmeans(df.limit(0), (2,))


def test_labels():
    assert ranking.priority_labels(3) == ["alto_potencial", "medio_alto", "medio"]
    assert ranking.priority_labels(5)[-1] == "bajo_potencial"
    assert ranking.priority_labels(6) == [f"prioridad_{i}" for i in range(1, 7)]


@pytest.fixture(scope="module")
def segmentation(spark, clients):
    return segment_model.segment_clients(clients, candidates=(2, 3, 4), starts=3)


def test_segmentation(spark, clients, segmentation):
    assert segmentation.choice.k == 3
    rows = segmentation.clients.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["cluster_id"], set()).add(r["client_id"] % 3)
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2]]
    means = [r["mean_score"] for r in segmentation.ranking.orderBy("cluster_id").collect()]
    assert means == sorted(means, reverse=True)
    assert {r["n"] for r in segmentation.profile().collect()} == {80}
    assert segmentation.modes().count() == 6
    assert sum(r["n"] for r in segmentation.distribution().collect()) == 240
    pdf = clients.toPandas()
    z = sum(((pdf[c] - pdf[c].mean()) / pdf[c].std()).fillna(0) for c in segmentation.model.priority)
    score = {r["client_id"]: r["priority_score"] for r in rows}
    assert np.allclose([score[i] for i in pdf["client_id"]], z)


def test_scoring(spark, clients, segmentation, tmp_path):
    segmentation.model.save(spark, str(tmp_path / "model"))
    model = segment_model.SegmentModel.load(spark, str(tmp_path / "model"))
    before = segmentation.model.score(clients).orderBy("client_id").collect()
    assert model.score(clients).orderBy("client_id").collect() == before
    with pytest.raises(ValueError, match="city"):
        model.score(clients.drop("city"))
    unknown = segment_model.SegmentModel(model.pipeline, {}, model.means, dict.fromkeys(model.stds, 0.0))
    row = unknown.score(clients).first()
    assert row["segment"] == "desconocido" and row["priority_score"] == 0.0

    requests = tmp_path / "requests"
    requests.mkdir()
    body = {c: None for c in model.required}
    lines = [json.dumps(r.asDict()) for r in clients.orderBy("client_id").collect()]
    incomplete = json.dumps({c: v for c, v in body.items() if c != "city"})
    (requests / "a.json").write_text("\n".join([*lines, json.dumps(body)]))
    unreadable = [json.dumps(body | {"age_years": v}) for v in ("abc", {"x": 1}, True)]
    (requests / "b.json").write_text("\n".join([incomplete, "no json", "[1]", *unreadable]))
    start_scoring(request_stream(spark, str(requests)), model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    scored = spark.read.parquet(str(tmp_path / "out" / "scored"))
    assert scored.count() == len(lines) + 1
    expected = sorted((r["cluster_id"], r["segment"], r["priority_score"]) for r in before)
    got = scored.where("age_years IS NOT NULL").select("cluster_id", "segment", "priority_score").collect()
    assert sorted(map(tuple, got)) == expected
    rejected = spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()
    assert sorted(len(r["missing"]) for r in rejected) == [0, 0, 0, 1, len(model.required), len(model.required)]
    assert [r["unreadable"] for r in rejected if not r["missing"]] == [["age_years"]] * 3

    # Files that arrive later are scored by the next run, earlier ones are not scored again.
    (requests / "c.json").write_text(lines[0])
    start_scoring(request_stream(spark, str(requests)), model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "scored")).count() == len(lines) + 2


def test_a_batch_that_runs_again_changes_nothing(spark, clients, segmentation, tmp_path):
    """Both writers of a batch are run twice, and once more after the second one failed."""
    model, out = segmentation.model, str(tmp_path / "out")
    lines = [(json.dumps(r.asDict()),) for r in clients.orderBy("client_id").limit(20).collect()] + [("no json",)]
    batch = spark.createDataFrame(lines, "value string")
    other = spark.createDataFrame(lines[:3], "value string")
    write = batch_writer(model, out)
    write(batch, 0)
    write(other, 1)
    rows = lambda name: sorted(map(str, scored(spark, out, name).collect()))
    before = rows("scored"), rows("rejected")
    assert (len(before[0]), len(before[1])) == (23, 1)
    write(batch, 0)
    assert (rows("scored"), rows("rejected")) == before
    # The run that fails between the two tables is repeated under its own number.
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(f"{out}/scored/batch=1")
    write(other, 1)
    assert (rows("scored"), rows("rejected")) == before


def test_requests_are_parsed_once(spark, clients, segmentation, tmp_path):
    """Rows that the source gives out, counted over both tables of a batch."""
    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    lines = [(json.dumps(r.asDict()),) for r in clients.limit(30).collect()]
    batch = spark.createDataFrame(lines, "value string").mapInArrow(counted, "value string")
    batch_writer(segmentation.model, str(tmp_path / "out"))(batch, 0)
    assert counter.value == 30


def test_bucketed_store(spark, clients, tmp_path):
    store = BucketedStore(str(tmp_path / "store"), 8)
    store.save(clients, "client_id")
    store.save(clients.withColumn("city", F.lit("new")), "client_id")
    store = BucketedStore.open(spark, str(tmp_path / "store"))
    one = store.one(spark, "17")
    assert [(r["client_id"], r["city"]) for r in one.collect()] == [(17, "new")]
    wanted = spark.createDataFrame([("5", 1), ("5", 2), ("none", 3), (None, 4)], "client_id string, place int")
    found = store.many(wanted, "client_id")
    rows = {r["place"]: r for r in found.collect()}
    assert [rows[i]["found"] for i in (1, 2, 3, 4)] == [True, True, False, False] and rows[1]["age_years"] is not None
    # The stored side has no exchange above its scan.
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in final
    # One key reads one bucket: the others are spoilt, and only reading all of them fails.
    home = one.select(F.input_file_name()).first()[0].rsplit("/", 1)[1]
    for file in (tmp_path / "store" / "rows").glob("part-*"):
        if file.name != home:
            file.write_bytes(b"spoilt")
    assert store.one(spark, "17").count() == 1
    with pytest.raises(Exception, match="spoilt|CANNOT_READ|FAILED_READ|not a Parquet|footer"):
        store.rows(spark).agg(F.sum("age_years")).collect()


def test_lookup(spark, segmentation):
    wanted = spark.createDataFrame([("5",), ("none",)], "client_id string")
    rows = {r["client_id"]: r for r in segment_model.lookup_clients(wanted, segmentation.clients).collect()}
    assert rows["5"]["found"] and rows["5"]["segment"] and not rows["none"]["found"]


def test_passes_of_kmeans_read_blocks_of_many_rows_kept_in_memory(spark, monkeypatch):
    df = spark.range(3_000).selectExpr("array(double(id % 3) * 50, double(id) / 3000) AS features")
    real, seen = cluster._gathered, []
    monkeypatch.setattr(cluster, "_gathered", lambda rows, stacks: seen.append((rows.count(), rows.is_cached)) or real(rows, stacks))
    found = cluster.best_kmeans(df, (3,), starts=2)[3]
    assert sorted(round(x) for x in found.points[:, 0]) == [0, 50, 100]
    assert all(n < 100 and cached for n, cached in seen)
