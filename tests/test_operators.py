"""Operators against brute force, under repartitioning and with heavy keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pilotlab.operators import cleaning, dedup, flags, ordering, profile, skew, tests
from pilotlab.sources.tables import cut_lineage


def heavy_events(spark):
    """30,000 events, a third of them on one key and a tenth without a key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 500)
    return spark.range(30_000).select(key.cast("long").alias("k"), "id", (F.col("id") % 13).alias("v"))


def test_heavy_keys(spark):
    found = dict(skew.heavy_keys(heavy_events(spark), "k", rows_per_slice=1_500))
    assert set(found) == {7, None} and found[7] == 7 and found[None] >= 1
    assert skew.heavy_keys(heavy_events(spark).limit(0), "k") == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_equals_plain_join(spark, how):
    events = heavy_events(spark)
    dims = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    plain = events.join(dims, "k", how)
    sliced = skew.spread_join(events, dims, "k", ["id"], how, dims_rows=10**9, rows_per_slice=1_000)
    assert "_slice" in sliced._jdf.queryExecution().analyzed().toString()
    for other in (sliced, skew.spread_join(events, dims, "k", ["id"], how)):
        assert other.select(*plain.columns).exceptAll(plain).count() == 0
        assert other.count() == plain.count()


def test_aggregate_by_key_with_slices(spark, monkeypatch):
    events = heavy_events(spark)
    dims = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 13).alias("low"))
    aggregates = {"n": F.count_if(F.col("v") >= F.col("low")), "kinds": F.count_distinct("v")}

    def run():
        return skew.aggregate_by_key(
            events, dims, "k", ["low"], aggregates, {"n": 0, "kinds": 0}, ["id"], rows_per_slice=1_000
        ).orderBy("k").collect()

    broadcast = run()
    monkeypatch.setattr(skew, "SMALL_DIMS_ROWS", 0)
    assert run() == broadcast
    assert len(broadcast) == 600 and broadcast[599]["n"] == 0


def test_flag_orphans_null_keys(spark):
    child = spark.createDataFrame([(1, "a"), (9, "b"), (None, "c")], "k int, v string")
    master = spark.createDataFrame([(1,), (1,), (None,)], "k int")

    def orphans(null_is_orphan):
        out = flags.flag_orphans(child, "k", master, "k", "orphan", null_is_orphan)
        return {r["v"]: r["orphan"] for r in out.collect()}

    assert orphans(True) == {"a": False, "b": True, "c": True}
    assert orphans(False) == {"a": False, "b": True, "c": False}


def test_flag_summary_and_unknown_conditions(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (None, 1)], "a int, b int")
    out = flags.flag_summary(df.withColumn("f", flags.flag(F.col("a") < F.col("b"))), "t", ["f"]).first()
    assert (out["n"], out["total"], round(out["pct"], 4)) == (1, 3, 33.3333)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "y"), (1, None)], "a int, b string")
    assert sorted(map(tuple, dedup.drop_exact_duplicates(df).collect()), key=str) == [(1, None), (2, "x"), (2, "y")]
    row = dedup.duplicate_summary(df).first()
    assert (row["rows_in"], row["rows_out"], row["removed"], row["pct"]) == (5, 3, 2, 40.0)
    assert profile.duplicate_count(df).first()[0] == 2
    empty = dedup.duplicate_summary(df.limit(0)).first()
    assert (empty["rows_in"], empty["pct"]) == (0, 0.0)


def test_exclusion_counts_follow_each_other(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, None)], "a boolean, b boolean")
    rows = dedup.exclusion_counts(df, "t", [("a", F.col("a")), ("b", F.col("b"))]).orderBy("stage").collect()
    assert [(r["n_before"], r["n_excluded"], r["pct"]) for r in rows] == [(4, 2, 50.0), (2, 1, 50.0)]


def test_quality_report(spark):
    values = [f"bad{i:03d}" for i in range(60)] + ["f"] * 5 + ["bad000"] * 3 + ["N/A", None]
    df = spark.createDataFrame([(v,) for v in values], "kind string")
    plan = [("kind", (cleaning.text_step(), cleaning.prefix_step({"f": "physical"})))]
    for layout in (df.repartition(1), df.repartition(17)):
        text_row, prefix_row = cleaning.quality_report(layout, "t", plan).orderBy("position").collect()
        assert (text_row["rows_in"], text_row["nulls_in"], text_row["nulls_out"]) == (70, 1, 2)
        assert text_row["warnings"] == ["1 placeholders turned into null"]
        assert (prefix_row["nulls_in"], prefix_row["nulls_out"], prefix_row["n_unrecognised"]) == (2, 65, 63)
        listed = prefix_row["unrecognised"]
        assert len(listed) == 50 and listed["bad000"] == 4 and "bad049" in listed and "bad050" not in listed
    empty = cleaning.quality_report(df.limit(0), "t", plan).orderBy("position").collect()
    assert [r["rows_in"] for r in empty] == [0, 0]
    clean = cleaning.clean_table(df, plan)
    assert clean.where("kind = 'physical'").count() == 5 and clean.columns == ["kind"]


def test_unrecognised_top_list_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("x",)], "kind string")
    report = cleaning.quality_report(df, "t", [("kind", (cleaning.number_step(),))])
    assert "WindowGroupLimit" in report._jdf.queryExecution().executedPlan().toString()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    x, y = np.round(rng.normal(size=3_001), 2), rng.exponential(size=3_001)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    columns = {"x": F.col("x"), "y": F.col("y"), "one": F.lit(4), "none": F.lit(None)}
    found = ordering.exact_quantiles(df, columns, probs).collect()
    got = {(r["variable"], r["p"]): r["value"] for r in found}
    assert len(found) == len(got) == 4 * len(probs)
    assert all(got["none", p] is None and got["one", p] == 4.0 for p in probs)
    for name, values in (("x", x), ("y", y)):
        assert np.allclose([got[name, p] for p in probs], np.quantile(values, probs), atol=1e-12)


def test_describe_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "x double")
    row = ordering.describe(df, ["x"]).first()
    assert (row["count"], row["min"], row["q50"], row["max"]) == (3, 1.0, 2.0, 4.0)


def signed_ranks(x):
    x = x[x != 0]
    size = np.abs(x)
    ranks = np.array([(size < v).sum() + ((size == v).sum() + 1) / 2 for v in size])
    return ranks[x > 0].sum(), ranks[x < 0].sum()


def test_quantiles_of_empty_and_missed_brackets(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    empty = ordering.exact_quantiles(df.limit(0), {"x": F.col("x")}, [0.5]).collect()
    assert [tuple(r) for r in empty] == [("x", 0.5, None)]
    # Cuts of one poor approximate percentile miss ranks between two values.
    monkeypatch.setattr(ordering, "BRACKET", 0.0)
    monkeypatch.setattr(ordering, "ACCURACY", 10)
    row = ordering.exact_quantiles(df, {"x": F.col("x")}, [0.333]).first()
    assert row["value"] == pytest.approx(0.333 * 999)


def test_missed_brackets_never_rank_more_than_the_bound(spark, monkeypatch):
    """Poor cuts over ties, a long tail and infinities: more rounds, and no larger ranking."""
    monkeypatch.setattr(ordering, "BRACKET", 0.2)
    monkeypatch.setattr(ordering, "ACCURACY", 3)
    monkeypatch.setattr(ordering, "MAX_RANKED", 20)
    sizes, rounds = [], []
    ranked, narrowed = ordering._ranked, ordering._narrowed

    def watched(df, segments, *rest):
        inside = df.select(F.explode(ordering._inside(segments, *rest)).alias("x")).groupBy("x.s").count()
        sizes.extend(r["count"] for r in inside.collect())
        return ranked(df, segments, *rest)

    monkeypatch.setattr(ordering, "_ranked", watched)
    monkeypatch.setattr(ordering, "_narrowed", lambda *a: rounds.append(1) or narrowed(*a))
    rng = np.random.default_rng(7)
    x = np.concatenate([np.full(300, 2.5), np.exp(rng.normal(size=500) * 9), [np.inf, -np.inf, -0.0, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    probs = [0.0, 0.003, 0.2, 0.5, 0.77, 0.999]
    got = {r["p"]: r["value"] for r in ordering.exact_quantiles(df, {"x": F.col("x")}, probs).collect()}
    assert len(rounds) > 2 and 0 < max(sizes) <= 20
    order = np.sort(x)
    for p in probs:
        i = (len(x) - 1) * p
        low, high = order[int(np.floor(i))], order[int(np.ceil(i))]
        assert got[p] == (low if low == high else pytest.approx(low + (high - low) * (i - np.floor(i))))


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(v), None if g == "b" else float(v) * 3) for g in ("a", "b", None) for v in rng.normal(size=101)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(4)
    found = ordering.exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, [0.25, 0.5], by="g").collect()
    assert len(found) == 12
    for r in found:
        own = [row[1 if r["variable"] == "x" else 2] for row in rows if row[0] == r["g"]]
        expected = None if r["g"] == "b" and r["variable"] == "y" else pytest.approx(np.quantile(own, r["p"]))
        assert r["value"] == expected


@pytest.mark.parametrize("buckets", [None, 16])
def test_wilcoxon_against_brute_force(spark, buckets):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0.1, 1.0, 2_000), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(9)
    row = tests.wilcoxon_statistic(df, "x", buckets=buckets).first()
    plus, minus = signed_ranks(x)
    assert (row["w_plus"], row["w_minus"], row["n_nonzero"]) == (plus, minus, (x != 0).sum())
    assert 0 < row["p_wilcoxon"] < 1


def test_exact_signed_rank_tail(spark):
    # All 2^n sign patterns of n ranks.
    n, w = 9, 8
    ranks = np.arange(1, n + 1)
    sums = [(ranks * [(m >> i) & 1 for i in range(n)]).sum() for m in range(1 << n)]
    assert tests.signed_rank_two_sided(w, n) == pytest.approx(2 * np.mean(np.array(sums) <= w))
    df = spark.createDataFrame([(float(v),) for v in (1.5, -2.5, 3.5, 4.0, 5.0)], "x double")
    assert tests.wilcoxon_statistic(df, "x").first()["p_wilcoxon"] == pytest.approx(0.1875)


def test_t_test(spark):
    # Closed forms of the two-sided tail for one, two and four degrees of freedom.
    for t in (0.3, 1.0, 2.5, 12.0):
        assert tests.t_two_sided(t, 1) == pytest.approx(1 - 2 / np.pi * np.arctan(t), rel=1e-10)
        assert tests.t_two_sided(t, 2) == pytest.approx(1 - t / np.sqrt(2 + t * t), rel=1e-8)
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0)], "x double")
    row = tests.t_statistic(df, "x").first()
    assert row["t"] == pytest.approx(2 * np.sqrt(3)) and row["p_t"] == pytest.approx(0.0741799, abs=1e-6)


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(2.0, 1_500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    row = tests.bootstrap_interval(df.repartition(3), "x", "id", 500).first()
    again = tests.bootstrap_interval(df.repartition(11), "x", "id", 500).first()
    assert row["ci_low"] == pytest.approx(again["ci_low"]) and row["ci_high"] == pytest.approx(again["ci_high"])
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert row["ci_low"] == pytest.approx(x.mean() - half, abs=half / 4)
    assert row["ci_high"] == pytest.approx(x.mean() + half, abs=half / 4)


def test_winsorize(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)] + [(None,)], "x double")
    out = [r["h"] for r in tests.winsorize(df, "x", "h").orderBy("x").collect()]
    assert out[0] is None and out[1] == 1.0 and out[2] == 1.0 and out[-1] == 99.0 and out[50] == 49.0


def test_cardinality_lists_few_values_only(spark):
    df = spark.range(100).select(
        (F.col("id") % 3).cast("string").alias("few"), F.col("id").cast("string").alias("many"),
        F.lit(None).cast("string").alias("none"),
    )
    rows = {r["column"]: r for r in profile.cardinality(df).collect()}
    assert rows["few"]["values"] == ["0", "1", "2"] and rows["many"]["values"] is None
    assert rows["many"]["n_distinct"] == 100 and rows["many"]["high_cardinality"]
    assert rows["none"]["n_distinct"] == 0


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "z")], "g string, c string")
    assert {r["g"]: r["c"] for r in profile.mode_by_group(df, "g", "c").collect()} == {"g": "a", "h": "z"}


def test_profiles_of_tables_without_such_columns(spark):
    numbers = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert profile.cardinality(numbers).collect() == []
    assert profile.date_format_profile(numbers).collect() == []
    assert profile.null_profile(numbers).collect() == []


def test_a_cleaner_that_fails_is_reported_and_the_others_go_on(spark):
    def unable(c, dtype):
        raise TypeError("cannot")

    df = spark.createDataFrame([(" A ", [1]), (None, None)], "kind string, many array<int>")
    plan = [("kind", (cleaning.Step("unable", unable), cleaning.text_step())), ("many", (cleaning.number_step(),))]
    rows = cleaning.quality_report(df, "t", plan).orderBy("position").collect()
    assert [r["ok"] for r in rows] == [False, True, False]
    assert rows[0]["errors"] == ["TypeError: cannot"] and rows[0]["nulls_in"] == rows[0]["nulls_out"] == 1
    assert len(rows[2]["errors"]) == 1 and rows[2]["formats"] is None
    assert [tuple(r) for r in cleaning.clean_table(df, plan).collect()] == [("a", [1]), (None, None)]


def test_report_of_an_empty_table(spark):
    df = spark.createDataFrame([], "kind string, day string")
    plan = [("kind", (cleaning.text_step(),)), ("day", (cleaning.date_step(F.lit("2020-01-01").cast("timestamp_ntz")),))]
    rows = cleaning.quality_report(df, "t", plan).orderBy("position").collect()
    assert [(r["rows_in"], r["nulls_out"], r["n_out_of_range"], r["ok"]) for r in rows] == [(0, 0, 0, True)] * 2


def test_reports_are_compiled(spark):
    """No stage of a report falls back from generated code."""
    import __spark_entry__ as entry_point

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert entry_point.queries()["quality_report"](spark, "/root/testdata/sf0.001").count() == 6
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_all_unrecognised_values_are_kept(spark):
    df = spark.createDataFrame([("x" * (i + 1),) for i in range(70)] + [("xx",), ("7",)], "kind string")
    plan = [("kind", (cleaning.number_step(),))]
    watched = cleaning.Watched(df, plan)
    stored = cut_lineage(watched.frame)
    assert stored.columns == ["kind", "_lost"] and stored.where("kind = 7.0 AND _lost IS NULL").count() == 1
    lost = cleaning.unread(stored)
    found = cleaning.unrecognised_values(lost, "t", plan)
    assert found.count() == 70 and found.where("value = 'xx'").first()["n"] == 2
    report = watched.report(lost, "t", listed=5).first()
    assert len(report["unrecognised"]) == 5 and report["n_unrecognised"] == 71
