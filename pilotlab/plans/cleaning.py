"""Raw tables to trusted tables: deduplicate, clean, flag and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, flags
from ..operators.cleaning import boolean_step, date_step, id_step, number_step, prefix_step, text_step
from ..operators.dedup import drop_exact_duplicates, duplicate_summary
from ..sources import bindings
from ..sources.tables import Zones, cut_lineage, publication, read_tables


def bank_plans(
    card_prefixes: dict[str, str] = bindings.CARD_PREFIXES, as_of: Column | None = None
) -> dict[str, cleaning.Plan]:
    """Cleaning chains of the five tables, in package column names; ``as_of`` sets the plausible dates."""
    return {
        "client": [
            ("birth_ts", (date_step(as_of),)),
            ("registered_ts", (date_step(as_of),)),
            ("acquisition_channel", (text_step(),)),
            ("city", (text_step(),)),
            ("account_status", (text_step(),)),
            ("national_id", (id_step(),)),
        ],
        "card": [
            ("issued_ts", (date_step(as_of),)),
            ("activated_ts", (date_step(as_of),)),
            ("card_type", (text_step(), prefix_step(card_prefixes))),
        ],
        "tx": [
            ("ts", (date_step(as_of),)),
            ("is_refund", (text_step(), boolean_step())),
            ("tx_type", (text_step(),)),
            ("amount", (number_step(),)),
        ],
        "contact": [
            ("contacted_ts", (date_step(as_of),)),
            ("campaign", (text_step(),)),
            ("channel", (text_step(),)),
            ("responded", (text_step(), boolean_step())),
        ],
        "merchant": [("category", (text_step(),))],
    }


# Event tables lie in months of these columns.
TIMES = {"tx": "ts", "contact": "contacted_ts"}

FLAGS = {
    "client": ["flag_minor", "flag_invalid_id", "birth_ts_out_of_range", "registered_ts_out_of_range"],
    "card": ["flag_activation_order", "flag_orphan_client", "issued_ts_out_of_range", "activated_ts_out_of_range"],
    "tx": ["flag_orphan_client", "flag_future", "flag_orphan_merchant", "ts_out_of_range"],
    "contact": ["flag_future", "flag_orphan_client", "contacted_ts_out_of_range"],
}


def add_flags(tables: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """Business-rule flags on cleaned tables; ``as_of`` is the time after which a date is future."""
    out = dict(tables)
    client = out["client"].withColumns({
        "flag_minor": flags.minor_at(F.col("registered_ts"), F.col("birth_ts")),
        "flag_invalid_id": flags.invalid_id(F.col("national_id")),
    })
    out["client"] = client

    def orphans(df: DataFrame) -> DataFrame:
        return flags.flag_orphans(df, "client_id", client, "client_id", "flag_orphan_client", True)

    if "card" in out:
        out["card"] = orphans(out["card"].withColumn(
            "flag_activation_order",
            flags.activated_before_issue(F.col("activated_ts"), F.col("issued_ts")),
        ))
    if "tx" in out:
        tx = orphans(out["tx"]).withColumn("flag_future", flags.in_future(F.col("ts"), as_of))
        if "merchant" in out:
            tx = flags.flag_orphans(
                tx, "merchant_code", out["merchant"], "merchant_code", "flag_orphan_merchant", False
            )
        out["tx"] = tx
    if "contact" in out:
        out["contact"] = orphans(
            out["contact"].withColumn("flag_future", flags.in_future(F.col("contacted_ts"), as_of))
        )
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def run_cleaning(
    spark: SparkSession, zones: Zones, as_of: Column | None = None, required: bool = True
) -> None:
    """Batch job: raw zone in, trusted zone and report tables out, under the bank's own names.

    Each deduplicated table is cleaned once; the numbers of its report are counted while that is
    stored, and only what could not be read is stored with it. Flags are added from there. Tables and
    reports replace the old ones together at the end, or none does.
    """
    as_of = F.current_timestamp().cast("timestamp_ntz") if as_of is None else as_of
    names = bindings.TABLE_NAMES
    raw = read_tables(spark, zones, "raw", list(names.values()), required)
    raw = {t: bindings.to_package_names(raw[n], t) for t, n in names.items() if n in raw}
    plans = bank_plans(as_of=as_of)
    reports, unread, cleaned = [], [], {}
    with publication(spark, zones.root) as out:
        for table, df in raw.items():
            watched = cleaning.Watched(drop_exact_duplicates(df), plans[table])
            stored = cut_lineage(watched.frame)
            cleaned[table], lost = stored.drop("_lost"), cleaning.unread(stored)
            reports.append(cleaning.dedup_report(duplicate_summary(df, stored), table))
            reports.append(watched.report(lost, table))
            unread.append(cleaning.unrecognised_values(lost, table, plans[table]))
        flagged = add_flags(cleaned, as_of)
        summaries = []
        for table, df in flagged.items():
            path = zones.table("trusted", names[table])
            time = {v: k for k, v in bindings.COLUMN_NAMES[table].items()}.get(TIMES.get(table, ""))
            out.write(bindings.to_source_names(df, table), path, time)
            if table in FLAGS:
                stored = bindings.to_package_names(spark.read.parquet(out.path(path)), table)
                summaries.append(flags.flag_summary(
                    stored, table, [f for f in FLAGS[table] if f in stored.columns]
                ))
        out.write(_union(reports), zones.table("reports", "quality_report"))
        out.write(_union(unread), zones.table("reports", "unrecognised_values"))
        out.write(_union(summaries), zones.table("reports", "flag_summary"))
