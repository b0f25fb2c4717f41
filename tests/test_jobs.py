"""The whole path from raw tables under the bank's names to segments, on tables with injected defects."""

import pytest
from pyspark.sql import functions as F

from pilotlab.functions.dates import ntz
from pilotlab.plans import cleaning, jobs
from pilotlab.plans import effect_base as eb
from pilotlab.plans.spec import EffectSpec
from pilotlab.sources import bindings, testviews
from pilotlab.sources.tables import Zones, read_table

SF = "/root/testdata/sf0.001"


def noisy_date(c):
    """ISO, day-first, or epoch milliseconds, by a hash of the date."""
    pick = F.pmod(F.xxhash64(c), F.lit(3))
    millis = F.timestamp_diff("MILLISECOND", ntz("1970-01-01 00:00:00"), c).cast("string")
    return (
        F.when(pick == 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
        .when(pick == 1, F.date_format(c, "dd/MM/yyyy HH:mm")).otherwise(millis)
    )


@pytest.fixture(scope="module")
def zones(spark, tmp_path_factory):
    zones = Zones(str(tmp_path_factory.mktemp("zones")))
    client, card, tx, contact = (testviews.view(spark, SF, v) for v in ("client", "card", "tx", "contact"))
    minute = lambda c: F.date_trunc("minute", c).cast("timestamp_ntz")
    raw = {
        "client": client.select(
            F.concat(F.lit("CHK-"), F.col("client_id")).alias("client_id"),
            F.concat(F.substring("national_id", 1, 9), F.lit("-"), F.substring("national_id", 10, 1)).alias("national_id"),
            noisy_date(F.col("birth_ts")).alias("birth_ts"), noisy_date(F.col("registered_ts")).alias("registered_ts"),
            F.upper("city").alias("city"),
            F.when(F.col("client_id") % 9 == 0, "N/A").otherwise(F.col("acquisition_channel")).alias("acquisition_channel"),
            F.lit(" Activa ").alias("account_status"),
        ),
        "card": card.select(
            F.concat(F.lit("CHK-"), F.when(F.col("card_id") % 40 == 0, -1).otherwise(F.col("client_id"))).alias("client_id"),
            F.when(F.col("card_type") == "physical", "FÍSICA").otherwise("v").alias("card_type"),
            F.lit(1).alias("status_code"), noisy_date(F.col("issued_ts")).alias("issued_ts"),
            noisy_date(F.col("activated_ts")).alias("activated_ts"),
        ),
        "tx": tx.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "ts", "amount").alias("tx_id"),
            F.concat(F.lit("CHK-"), F.col("client_id")).alias("client_id"), noisy_date(F.col("ts")).alias("ts"),
            F.when(F.col("tx_type") == "1-URGENT", "CASH_IN").when(F.col("tx_type") == "2-HIGH", "Cash  Out")
            .otherwise(F.col("tx_type")).alias("tx_type"),
            F.concat(F.lit("$"), F.format_number("amount", 2)).alias("amount"),
            F.when(F.col("merchant_code") % 2 == 0, F.col("merchant_code").cast("string")).alias("merchant_code"),
            F.when(F.col("is_refund"), "Sí").otherwise("0").alias("is_refund"),
        ),
        "contact": contact.select(
            F.concat(F.lit("CHK-"), F.col("client_id")).alias("client_id"),
            noisy_date(minute(F.col("contacted_ts"))).alias("contacted_ts"),
            F.when(F.col("campaign") == "signup", "Piloto_Tarjeta_Fisica_Q2").otherwise(F.col("campaign")).alias("campaign"),
            F.lit("SMS").alias("channel"), F.coalesce(F.col("responded").cast("string"), F.lit("nan")).alias("responded"),
        ),
        "merchant": spark.range(0, 10, 4).select(F.col("id").cast("string").alias("merchant_code"), F.lit("X_y").alias("category")),
    }
    for table, df in raw.items():
        doubled = df.union(df.where(F.pmod(F.xxhash64(*df.columns), F.lit(5)) == 0))
        name = bindings.TABLE_NAMES[table]
        bindings.to_source_names(doubled, table).write.parquet(zones.table("raw", name))
    cleaning.run_cleaning(spark, zones, as_of=ntz("2000-06-01 00:00:00"))
    return zones


def trusted(spark, zones, table):
    df = read_table(spark, zones.table("trusted", bindings.TABLE_NAMES[table]))
    return bindings.to_package_names(df, table)


def test_cleaning_restores_the_original_columns(spark, zones):
    client = trusted(spark, zones, "client")
    original = testviews.view(spark, SF, "client")
    joined = client.join(
        original.withColumn("client_id", F.concat(F.lit("CHK-"), F.col("client_id"))).alias("o"), "client_id"
    )
    assert joined.count() == client.count() == original.count()
    # Milliseconds of dates around the start of 1970 also fit the range of seconds, which comes first.
    ambiguous = F.col("o.birth_ts").between(ntz("1969-12-06 00:00:00"), ntz("1970-02-18 00:00:00"))
    assert joined.where(ambiguous).count() < 5
    assert joined.where(~ambiguous).where(
        (client["birth_ts"] != F.col("o.birth_ts")) | (client["registered_ts"] != F.col("o.registered_ts"))
        | (client["national_id"] != F.col("o.national_id")) | (client["city"] != F.translate(F.lower("o.city"), "_", " "))
    ).count() == 0
    tx, flags = trusted(spark, zones, "tx"), testviews.view(spark, SF, "tx")
    assert tx.count() == flags.distinct().count()
    assert tx.agg(F.round(F.sum("amount"), 2)).first() == flags.distinct().agg(F.round(F.sum("amount"), 2)).first()
    assert tx.where("is_refund").count() == flags.distinct().where("is_refund").count()
    assert {r[0] for r in tx.select("tx_type").distinct().collect()} >= {"cash in", "cash out"}
    assert "cliente_id" in read_table(spark, zones.table("trusted", "transacciones")).columns


def test_reports(spark, zones):
    quality = read_table(spark, zones.table("reports", "quality_report")).collect()
    # Five tables, and the steps of each.
    assert len(quality) == 5 + 6 + 4 + 5 + 5 + 1
    for r in quality:
        if r["function"] == "drop_exact_duplicates":
            assert r["rows_in"] > r["rows_out"] or r["table"] == "merchant"
        else:
            assert r["rows_in"] == r["rows_out"] and r["n_unrecognised"] == 0
            if r["formats"]:
                assert sum(r["formats"].values()) == r["rows_in"]
    summary = {(r["table"], r["flag"]): r for r in read_table(spark, zones.table("reports", "flag_summary")).collect()}
    assert len(summary) == 15
    assert summary["card", "flag_orphan_client"]["n"] > 0 and summary["tx", "flag_orphan_client"]["n"] == 0
    assert summary["tx", "flag_future"]["n"] > 0
    tx = trusted(spark, zones, "tx")
    expected = tx.where("merchant_code IS NOT NULL AND NOT merchant_code IN ('0', '4', '8')").count()
    assert summary["tx", "flag_orphan_merchant"]["n"] == expected > 0


def test_modelling_jobs(spark, zones):
    jobs.build_segment_base(spark, zones)
    base = read_table(spark, zones.table("modelling", "base_segmentacion"))
    assert base.columns[:3] == ["cliente_id", "edad", "antiguedad_cliente"] and base.count() > 20
    result = jobs.run_segmentation(spark, zones, (3,), starts=2)
    stored = read_table(spark, zones.table("modelling", "clientes_segmentados"))
    assert stored.columns[:4] == ["cliente_id", "cluster_id", "segmento_prioridad", "puntaje_prioridad_individual"]
    assert stored.count() == base.count()
    some = result.clients.first()["client_id"]
    found = jobs.find_clients(spark, zones, spark.createDataFrame([(some,), ("CHK-x",)], "client_id string"))
    assert sorted(r["found"] for r in found.collect()) == [False, True]
    assert [r["client_id"] for r in jobs.find_client(spark, zones, some).collect()] == [some]
    assert jobs.find_client(spark, zones, "CHK-none").count() == 0
    model = jobs.load_model(spark, zones)
    assert model.score(result.clients.select("client_id", *model.required)).count() == base.count()

    jobs.build_effect_base(spark, zones, EffectSpec())
    effect = read_table(spark, zones.table("modelling", "base_modelo"))
    assert effect.columns[:5] == ["cliente_id", "T", "t0", "Y_frecuencia", "Y_monto"] and effect.count() > 5
    sizes = read_table(spark, zones.table("reports", "cohort_sizes")).first()
    assert sizes["cohort"] == sizes["active_before"] + sizes["treated"] + sizes["control"]
    windows = {r["window_days"]: r for r in read_table(spark, zones.table("reports", "window_sensitivity")).collect()}
    assert windows[60]["n_valid"] == effect.count() and windows[60]["n_clients"] == sizes["treated"] + sizes["control"]
    direct = eb.effect_base(*(trusted(spark, zones, t) for t in ("client", "card", "tx", "contact")), EffectSpec())
    plain = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert plain(bindings.to_package_names(effect, "effect_base")) == plain(direct)
    by_length = read_table(spark, zones.table("reports", "outcomes_by_window")).collect()
    for days, row in windows.items():
        assert sum(r["n"] for r in by_length if r["window_days"] == days) == row["n_valid"]
    shares = read_table(spark, zones.table("reports", "segment_distribution")).collect()
    assert sum(r["n"] for r in shares) == base.count()


def test_missing_table(spark, tmp_path):
    assert read_table(spark, str(tmp_path / "none.parquet"), required=False) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_table(spark, str(tmp_path / "none.parquet"))


def test_stage_tables_are_removed(spark):
    from pilotlab.sources.tables import cut_lineage, drop_stages, stage_scope

    with stage_scope() as made:
        kept = cut_lineage(spark.range(3))
        other = cut_lineage(spark.range(4))
    outside = cut_lineage(spark.range(5))
    assert len(made) == 2 and kept.count() == 3
    drop_stages(spark, made)
    assert outside.count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        spark.read.parquet(made[1]).count()
    assert other.columns == ["id"]


def folders(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


def test_a_failing_job_leaves_the_old_zone_whole(spark, zones, monkeypatch):
    """The last table fails after all others were written: nothing is replaced, nothing is left behind."""
    from pilotlab.sources.tables import shared_folder

    before = {t: trusted(spark, zones, t).inputFiles() for t in ("client", "card", "tx", "contact", "merchant")}
    kept = folders(spark, shared_folder(spark))

    def fails(*_):
        raise RuntimeError("no report")

    monkeypatch.setattr(cleaning.cleaning, "unrecognised_values", fails)
    with pytest.raises(RuntimeError, match="no report"):
        cleaning.run_cleaning(spark, zones, as_of=ntz("2000-06-01 00:00:00"))
    monkeypatch.undo()
    monkeypatch.setattr(cleaning.flags, "flag_summary", fails)
    with pytest.raises(RuntimeError, match="no report"):
        cleaning.run_cleaning(spark, zones, as_of=ntz("2000-06-01 00:00:00"))
    assert {t: trusted(spark, zones, t).inputFiles() for t in before} == before
    assert folders(spark, shared_folder(spark)) == kept
    assert "_runs" not in folders(spark, zones.root)
    monkeypatch.undo()
    cleaning.run_cleaning(spark, zones, as_of=ntz("2000-06-01 00:00:00"))
    after = {t: trusted(spark, zones, t).inputFiles() for t in before}
    assert all(set(after[t]).isdisjoint(before[t]) for t in before)
    assert folders(spark, shared_folder(spark)) == kept and "_runs" not in folders(spark, zones.root)


def test_a_failing_move_puts_the_old_tables_back(spark, tmp_path, monkeypatch):
    from pilotlab.sources import tables

    root = str(tmp_path)
    for n in (1, 2):
        with tables.publication(spark, root) as out:
            for name in ("a", "b"):
                out.write(spark.range(n), f"{root}/zone/{name}")
    assert spark.read.parquet(f"{root}/zone/b").count() == 2
    move = tables.Publication._move

    def breaks(self, source, final):
        if final.endswith("zone/b"):
            raise OSError("gone")
        move(self, source, final)

    monkeypatch.setattr(tables.Publication, "_move", breaks)
    with pytest.raises(OSError):
        with tables.publication(spark, root) as out:
            for name in ("a", "c", "b"):
                out.write(spark.range(9), f"{root}/zone/{name}")
    monkeypatch.undo()
    assert spark.read.parquet(f"{root}/zone/a").count() == 2 and folders(spark, root) == ["zone"]
    assert folders(spark, f"{root}/zone") == ["a", "b"]


def test_effect_reports(spark, zones):
    result = jobs.run_effect(spark, zones, replicates=50)
    balance = read_table(spark, zones.table("reports", "covariate_balance")).collect()
    gaps = [abs(r["smd"]) for r in balance]
    assert gaps == sorted(gaps, reverse=True)
    counts = read_table(spark, zones.table("reports", "unbalanced_covariates")).first()
    assert (counts["n_unbalanced"], counts["n_covariates"]) == (sum(r["unbalanced"] for r in balance), len(balance))
    city = read_table(spark, zones.table("reports", "category_balance_city"))
    assert city.agg(F.sum("pct_control")).first()[0] == pytest.approx(100, abs=1)
    assert result.decisions.count() == 2 and result.effects["y_amount"].count() > 0
    windows = read_table(spark, zones.table("reports", "window_sensitivity"))
    assert {r["window_days"] for r in windows.collect()} == {30, 45, 60, 90, 120}


def test_clients_by_score_and_range_marks(spark, zones):
    jobs.run_segmentation(spark, zones, (3,), starts=2, by_score=True)
    stored = read_table(spark, zones.table("modelling", "clientes_segmentados"))
    scores = [r[0] for r in stored.select("puntaje_prioridad_individual").collect()]
    assert scores == sorted(scores, reverse=True)
    assert "fecha_nacimiento_fuera_rango" in read_table(spark, zones.table("trusted", "clientes")).columns
    quality = {(r["table"], r["column"]): r for r in read_table(spark, zones.table("reports", "quality_report")).collect()}
    far = quality["client", "birth_ts"]["n_out_of_range"]
    assert far == trusted(spark, zones, "client").where("birth_ts_out_of_range").count()
    assert all(r["ok"] and r["errors"] == [] for r in quality.values())


def files_read(plan):
    """Files that the scans of a finished run opened, from their metrics."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return files_read(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return files_read(plan.plan())
    own = plan.metrics().apply("numFiles").value() if plan.metrics().contains("numFiles") else 0
    children = plan.children()
    return own + sum(files_read(children.apply(i)) for i in range(children.size()))


def test_months_outside_the_bounds_are_not_read(spark, tmp_path):
    from pilotlab.sources.tables import replace_months, within

    path = str(tmp_path / "events")
    day = F.expr("TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(CAST(id % 366 AS INT))")
    events = spark.range(3000).select("id", F.when(F.col("id") % 100 != 7, day).alias("ts"))
    replace_months(events, path, "ts")
    stored = spark.read.parquet(path)
    assert stored.count() == 3000 and stored.where("month IS NULL").count() == 30
    start = stored.agg(F.max("ts")).select(F.expr("`max(ts)` - INTERVAL '40' DAY").alias("b")).scalar()
    part = within(stored, "ts", start, F.lit("2020-12-20 00:00:00").cast("timestamp_ntz"))
    expected = {r["id"] for r in events.where("ts >= '2020-11-21' AND ts < '2020-12-20'").collect()}
    assert {r["id"] for r in part.collect()} == expected
    whole = stored.where("ts >= '2020-11-21'")
    whole.collect()
    few, every = (files_read(df._jdf.queryExecution().executedPlan()) for df in (part, whole))
    assert 0 < few <= every / 4
    # Only the months of the new rows are replaced.
    replace_months(spark.createDataFrame([(-1,)], "id long").select("id", F.lit("2020-03-05 00:00:00").cast("timestamp_ntz").alias("ts")), path, "ts")
    again = spark.read.parquet(path)
    assert again.where("month = '2020-03'").count() == 1
    assert again.where("month <> '2020-03' OR month IS NULL").count() == stored.where("month <> '2020-03' OR month IS NULL").count()
    ordered = [r["ts"] for r in spark.read.parquet(f"{path}/month=2020-05").collect()]
    assert ordered == sorted(ordered)


def test_the_trusted_zone_lies_in_months(spark, zones):
    tx = read_table(spark, zones.table("trusted", "transacciones"))
    assert "month" in tx.columns
    assert tx.where("month <> date_format(fecha, 'yyyy-MM')").count() == 0
