"""Linear models from sums of products against direct computations over the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pilotlab.operators import gram, ridge
from pilotlab.operators.features import FeatureColumns, fit_features, with_features
from pilotlab.operators.gram import Products, Terms

COLUMNS = FeatureColumns(("x", "z", "flat"), ("city", "web"), ("b",))


@pytest.fixture(scope="module")
def people(spark):
    """Nulls in every kind of column, a far-off number, a constant, a category that one fold alone has."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        x, z = rng.normal(), 1e6 + rng.normal()
        arm = int(i % 3 == 0)
        y = 2 * x - (z - 1e6) + arm * 1.5 + rng.normal() * 0.3 + i % 4
        rows.append((
            i, arm, None if i % 17 == 0 else x, float("nan") if i % 23 == 0 else z, 3.0,
            "rare" if i == 37 else None if i % 29 == 0 else f"c{i % 4}", f"w{i % 2}",
            None if i % 31 == 0 else i % 5 == 0, y, 1e5 + 10 * y,
        ))
    rows.append((900, None, 1.0, 1.0, 3.0, "c1", "w1", True, 1.0, 1.0))
    rows.append((901, 1, 1.0, 1.0, 3.0, "c1", "w1", True, None, 1.0))
    return spark.createDataFrame(
        rows, "id long, arm int, x double, z double, flat double, city string, web string, b boolean, y double, w double"
    ).repartition(5)


def design(fit_on, apply_to):
    """Prepared features by plain pandas."""
    parts = []
    for c in COLUMNS.numeric:
        median = fit_on[c].median()
        filled = fit_on[c].fillna(median)
        deviation = filled.std(ddof=0)
        parts.append((apply_to[c].fillna(median) - filled.mean()) / (deviation if deviation > 1e-12 else 1.0))
    seen = fit_on["b"].dropna().astype(bool)
    parts.append(apply_to["b"].astype("float").fillna(float(seen.mean() > 0.5)))
    for c in COLUMNS.categorical:
        for level in sorted(fit_on[c].fillna("desconocido").unique())[1:]:
            parts.append((apply_to[c].fillna("desconocido") == level).astype(float))
    return np.array(parts, dtype=float).T


def solved(x, y, alpha=1.0):
    centered = x - x.mean(axis=0)
    w = np.linalg.solve(centered.T @ centered + alpha * np.eye(x.shape[1]), centered.T @ (y - y.mean()))
    return w, y.mean() - x.mean(axis=0) @ w


def test_t_learner_against_pandas(spark, people):
    learner = ridge.fit_t_learner(people, "arm", "id", COLUMNS, ["y", "w"])
    pdf = people.withColumn("held", ridge.holdout("id", 42)).orderBy("id").toPandas()
    pdf = pdf[pdf["arm"].notna() & pdf["y"].notna()]
    assert learner.residual < 1e-9
    scores = {(r["arm"], r["outcome"]): r["r2"] for r in learner.r2.collect()}
    for value, name, model in ((0, "control", learner.control), (1, "treated", learner.treated)):
        own = pdf[pdf["arm"] == value]
        training, held = own[~own["held"]], own[own["held"]]
        for outcome in ("y", "w"):
            w, b = solved(design(training, training), training[outcome].to_numpy())
            error = held[outcome].to_numpy() - (design(training, held) @ w + b)
            expected = 1 - (error**2).sum() / ((held[outcome] - held[outcome].mean()) ** 2).sum()
            assert scores[name, outcome] == pytest.approx(expected, abs=1e-6)
            w, b = solved(design(own, own), own[outcome].to_numpy())
            rows = model.predict(people.where("y IS NOT NULL AND arm IS NOT NULL"), outcome, "e").orderBy("id").collect()
            assert np.allclose([r["e"] for r in rows], design(own, pdf) @ w + b, rtol=1e-7)


def test_an_unknown_category_counts_as_none(spark, people):
    learner = ridge.fit_t_learner(people.where("city <> 'rare' OR city IS NULL"), "arm", "id", COLUMNS, ["y"])
    row = people.where("id = 38")
    one = learner.control.predict(row.withColumn("city", F.lit("nowhere")), "y", "e").first()["e"]
    first = learner.control.predict(row.withColumn("city", F.lit("c0")), "y", "e").first()["e"]
    assert one == pytest.approx(first)


def test_arms_without_rows_or_without_held_out_ones(spark, people):
    with pytest.raises(ValueError, match="treated"):
        ridge.fit_t_learner(people.where("arm = 0"), "arm", "id", COLUMNS, ["y"])
    none_held = people.where(~ridge.holdout("id", 42))
    assert {r["r2"] for r in ridge.fit_t_learner(none_held, "arm", "id", COLUMNS, ["y"]).r2.collect()} == {None}


def test_sums_of_groups_add_up(spark, people):
    terms = Terms(COLUMNS, ("y",), {"x": 0.1, "z": 1e6, "flat": 0.0, "y": 1.0})
    parts = gram.sums_by_group(people, F.col("arm"), terms)
    whole = gram.sums_by_group(people, F.when(F.col("arm").isNotNull(), 0), terms)[0]
    both = parts[0] + parts[1]
    assert np.allclose(both.dense, whole.dense) and both.pairs == whole.pairs
    assert both.levels.keys() == whole.levels.keys()
    assert all(np.allclose(both.levels[k], whole.levels[k]) for k in whole.levels)
    again = gram.sums_by_group(people.repartition(1), F.col("arm"), terms)
    assert np.allclose(again[1].dense, parts[1].dense) and again[1].pairs == parts[1].pairs


def test_rows_are_read_once(spark, people, tmp_path):
    """One scan for all groups, outcomes and parts."""
    people.write.parquet(str(tmp_path / "people"))
    terms = Terms(COLUMNS, ("y", "w"), {})
    stored = spark.read.parquet(str(tmp_path / "people"))
    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    watched = stored.mapInArrow(counted, stored.schema)
    assert set(gram.sums_by_group(watched, F.col("arm") * 2 + ridge.holdout("id", 42).cast("int"), terms)) == {0, 1, 2, 3}
    assert counter.value == people.count()


def test_many_categories_by_both_solvers(spark, monkeypatch):
    """Two columns of hundreds of categories, some shared by few rows."""
    df = spark.range(3000).select(
        "id", (F.col("id") % 2).cast("int").alias("arm"), (F.col("id") % 7 / 7).alias("x"),
        F.concat(F.lit("a"), F.col("id") * 7 % 211).alias("a"), F.concat(F.lit("b"), F.col("id") * 11 % 307).alias("b"),
        ((F.col("id") * 37) % 101 / 10).alias("y"),
    )
    columns = FeatureColumns(("x",), ("a", "b"))
    direct = ridge.fit_t_learner(df, "arm", "id", columns, ["y"])
    monkeypatch.setattr(gram, "DIRECT_FEATURES", 10)
    steps = ridge.fit_t_learner(df, "arm", "id", columns, ["y"])
    assert steps.residual < 1e-9
    for arm in ("control", "treated"):
        one, other = (getattr(x, arm).outcomes["y"] for x in (direct, steps))
        assert np.allclose(one.coefficients, other.coefficients, atol=1e-9)
        assert one.intercept == pytest.approx(other.intercept)
    found = {r["id"]: r["e"] for r in direct.control.predict(df, "y", "e").select("id", "e").collect()}
    control = df.where("arm = 0")
    ready = with_features(control, fit_features(control, columns))
    x = np.array([r["features"].toArray() for r in ready.orderBy("id").collect()])
    y = np.array([r["y"] for r in control.orderBy("id").collect()])
    w, b = solved(x, y)
    ids = [r["id"] for r in control.orderBy("id").collect()]
    assert np.allclose([found[i] for i in ids], x @ w + b)


def test_no_penalty_and_products_match_rows(spark, people):
    terms = Terms(COLUMNS, ("y",), {"z": 1e6})
    sums = gram.sums_by_group(people, F.when(F.col("arm") == 0, 0), terms)[0]
    medians = {"x": 0.0, "z": 1e6, "flat": 3.0}
    prepared, w, b = gram.fit(sums, terms, medians, 0.0)
    products = Products(sums, prepared)
    assert np.abs(products.residuals(w, b, 0.0)).max() < 1e-6
    assert np.allclose(products.matrix() @ w[:, 0], products.times(w[:, 0]))
