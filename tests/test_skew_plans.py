"""The modelling tables must not change when every client is treated as a heavy key."""

import re
from contextlib import contextmanager
from functools import partial

from pyspark.sql import functions as F

from pilotlab.catalog import common
from pilotlab.operators import flags, ordering, skew
from pilotlab.operators.ordering import few_rows_filter_joins
from pilotlab.plans import effect_base, events, segment_base
from pilotlab.sources.tables import cut_lineage

SF = "/root/testdata/sf0.001"


def test_sliced_tables_equal_broadcast_tables(spark, monkeypatch):
    client, card, tx, contact = (cut_lineage(t) for t in common.trusted(spark, SF))

    def both():
        segment = segment_base.segment_features(client, card, tx, contact, common.SEGMENT)
        effect = effect_base.effect_base(client, card, tx, contact, common.EFFECT)
        digits = {"monthly_amount": 4}, {"y_amount": 2, "amount_pre": 2}
        return [
            common.rounded(df, d).orderBy("client_id").collect() for df, d in zip((segment, effect), digits)
        ]

    plain = both()
    monkeypatch.setattr(skew, "SMALL_DIMS_ROWS", 0)
    sliced = partial(skew.aggregate_by_key, rows_per_slice=5)
    monkeypatch.setattr(segment_base, "aggregate_by_key", sliced)
    monkeypatch.setattr(effect_base, "aggregate_by_key", sliced)
    assert both() == plain and all(plain)


def test_anchors_bound_the_events_that_are_read(spark):
    client, card, tx, contact = (cut_lineage(t) for t in common.trusted(spark, SF))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = effect_base.effect_base(client, card, tx, contact, common.EFFECT)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line and "net_amount" not in line and ",ts#" in line]
    assert [s for s in scans if re.search(r"ts#\d+ >= Sub", s)], scans[0]


def test_the_newest_row_is_exact_wherever_the_probe_ends(spark):
    from pyspark.sql import functions as F

    from pilotlab.operators.ordering import newest

    def latest(rows):
        return rows.limit(1).select(newest(rows, "ts", ["ts", "amount"]).cast("string")).first()

    start = F.lit("2001-01-01").cast("timestamp_ntz")
    rows = spark.range(50_000).select(
        (start + F.make_dt_interval(secs=F.expr("id * 7919 % 50000 + 0.000001BD"))).alias("ts"), (F.col("id") % 90.0).alias("amount")
    )
    assert latest(rows)[0] == "2001-01-01 13:53:19.000001"
    # The last rows are not valid, or hardly any row is there to be probed, or none.
    assert latest(rows.where("ts < '2001-01-01 00:00:02'"))[0] == "2001-01-01 00:00:01.000001"
    assert newest(rows.limit(0), "ts", ["ts"])._jc.toString().startswith("CAST(NULL")


def test_no_scan_of_the_transactions_is_unbounded_when_the_segmentation_table_is_made(spark):
    client, card, tx, contact = (cut_lineage(t) for t in common.trusted(spark, SF))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = segment_base.segment_features(client, card, tx, contact, common.SEGMENT)._jdf.queryExecution().executedPlan().toString()
    rates = segment_base.transaction_rates(client, card, tx, common.SEGMENT)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for text in (plan, rates):
        scans = [line for line in text.splitlines() if "FileScan" in line and re.search(r"\bts#", line)]
        assert scans and all(re.search(r"GreaterThanOrEqual\(ts,\d", s) for s in scans), scans


def test_events_of_other_clients_go_before_the_orphan_check(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_DIMS_ROWS", 0)
    client, card, tx, contact = common.trusted(spark, SF)
    table = effect_base.window_aggregates(client, card, tx, contact, common.EFFECT)
    plan = table._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi = [i for i, line in enumerate(plan) if "Join LeftSemi" in line]
    assert len(semi) >= 3
    # Joins above the first filter: with the anchors and with the known clients.
    assert any("Join" in line for line in plan[: semi[0]])


def test_orphan_flags_do_not_run_the_tables_that_they_are_added_to(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_DIMS_ROWS", 0)
    counted = []
    monkeypatch.setattr(skew, "heavy_keys", lambda events, *_: counted.append(events) or [])
    common.trusted(spark, SF)
    assert not counted
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    common.trusted(spark, SF)
    spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    assert len(counted) == 3


def test_spark_cuts_the_rows_of_a_heavy_key_when_orphans_are_flagged(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_DIMS_ROWS", 0)
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    key = F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id") % 500)
    child = spark.range(60_000).select(key.cast("long").alias("k"), "id")
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        out = flags.flag_orphans(child, "k", spark.range(400).toDF("k"), "k", "orphan", True)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert "skew=true" in plan
    assert len(rows) == 60_000 and all(r["orphan"] == (r["k"] is None or r["k"] >= 400) for r in rows)


def test_tables_joined_to_the_newest_rows_are_filtered_before_they_move(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_DIMS_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    _, _, tx, _ = common.trusted(spark, SF)
    plans = []

    @contextmanager
    def watched(session):
        with few_rows_filter_joins(session):
            few = tx.where("pmod(xxhash64(ts, amount), 1024) = 0").agg(F.max("ts"))
            plans.append(few._jdf.queryExecution().optimizedPlan().toString())
            yield

    monkeypatch.setattr(ordering, "few_rows_filter_joins", watched)
    rule = "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold"
    before = spark.conf.get(rule)
    last = tx.limit(1).select(events.last_transaction(tx).cast("string")).first()[0]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert last == tx.where("NOT flag_orphan_client AND NOT flag_future").agg(F.max("ts").cast("string")).first()[0]
    assert len(plans) == 2 and all("might_contain" in p for p in plans)
    assert spark.conf.get(rule) == before
