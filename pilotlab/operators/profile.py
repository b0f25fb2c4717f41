"""Profiling of raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.dates import date_format
from .skew import spread_join

MAX_LISTED = 30


def columns_named(schema: StructType, *parts: str) -> list[str]:
    """Columns whose name contains one of the parts, in any case."""
    return [f.name for f in schema.fields if any(p.lower() in f.name.lower() for p in parts)]


def text_columns(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, StringType)]


def date_columns(schema: StructType) -> list[str]:
    return columns_named(schema, "fecha", "date")


def table_shape(df: DataFrame, table: str) -> DataFrame:
    """One row per column: position, name and type, with the row and column counts of the table."""
    fields = df.schema.fields
    return df.agg(F.count("*").alias("n_rows")).select(F.inline(F.array(*[
        F.struct(
            F.lit(table).alias("table"),
            F.lit(i).cast("bigint").alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("n_rows"),
            F.lit(len(fields)).cast("bigint").alias("n_columns"),
        )
        for i, f in enumerate(fields)
    ])))


def null_profile(df: DataFrame) -> DataFrame:
    """``column, nulls, pct`` of the columns that have nulls; order by pct when showing it."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.select("_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns
    ]))).where("nulls > 0").select(
        "column", "nulls", F.round(F.col("nulls") * 100.0 / F.col("_rows"), 2).alias("pct")
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row in every column."""
    groups = df.groupBy(*df.columns).agg((F.count("*") - 1).alias("_repeats"))
    return groups.agg(F.coalesce(F.sum("_repeats"), F.lit(0)).cast("bigint").alias("duplicates"))


def cardinality(df: DataFrame, columns: list[str] | None = None, max_listed: int = MAX_LISTED) -> DataFrame:
    """Distinct values per text column, with the sorted values where there are at most ``max_listed``.

    Distinct (column, value) pairs are counted in parallel. Only columns already known to have few
    values are then collected into sets, which are combined before the shuffle.
    """
    columns = columns if columns is not None else text_columns(df.schema)
    if not columns:
        schema = "column string, n_distinct bigint, high_cardinality boolean, values array<string>"
        return df.sparkSession.createDataFrame([], schema)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    counted = (
        df.select(F.explode(pairs).alias("p")).select("p.*").distinct()
        .groupBy("column").agg(F.count("value").alias("n")).collect()
    )
    sizes = {r["column"]: r["n"] for r in counted}
    few = [c for c in columns if sizes.get(c, 0) <= max_listed]
    values = df.agg(
        F.count("*").alias("_rows"), *[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in few]
    )
    return values.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.lit(sizes.get(c, 0)).cast("bigint").alias("n_distinct"),
            F.lit(c not in few).alias("high_cardinality"),
            (F.col(c) if c in few else F.lit(None).cast("array<string>")).alias("values"),
        )
        for c in columns
    ])))


def date_format_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, format, n``; values that no format reads are counted under ``unparsed``."""
    columns = columns if columns is not None else date_columns(df.schema)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, format string, n bigint")
    formats = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.when(F.col(c).isNull(), F.lit("null"))
            .otherwise(F.coalesce(date_format(F.col(c)), F.lit("unparsed"))).alias("format"),
        )
        for c in columns
    ])
    return (
        df.select(F.explode(formats).alias("f")).select("f.*")
        .groupBy("column", "format").agg(F.count("*").alias("n"))
    )


def crosstab_nulls(df: DataFrame, group: str, column: str) -> DataFrame:
    """Rows with and without a value of ``column`` per group."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count_if(F.col(column).isNotNull()).alias("present"),
        F.count_if(F.col(column).isNull()).alias("missing"),
    )


def null_rate_by_group(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        (F.avg(F.col(column).isNull().cast("double")) * 100).alias("pct_null")
    )


def key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per candidate key: is it unique, how many values repeat, and how many rows they cover."""
    pairs = F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys
    ])
    counts = (
        df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL")
        .groupBy("key", "value").agg(F.count("*").alias("n"))
    )
    return counts.groupBy("key").agg(
        F.count("*").alias("n_values"),
        F.count_if(F.col("n") > 1).alias("repeated_values"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("rows_covered"),
    ).withColumn("is_unique", F.col("repeated_values") == 0)


def first_by_key(df: DataFrame, key: str, value: Column, order_by: str) -> DataFrame:
    """First ``value`` per key by ``order_by``, the least one (null first) on ties; the key itself may repeat."""
    place = F.struct(F.col(order_by), value.alias("value"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, place).alias("first_value"))


def foreign_key_report(relations: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per relation: distinct child ids, how many are missing from the master, and the percentage."""
    out = None
    for name, child, child_key, master, master_key in relations:
        ids = child.select(F.col(child_key).alias("id")).where("id IS NOT NULL").distinct()
        known = (
            master.select(F.col(master_key).alias("id")).where("id IS NOT NULL").distinct()
            .withColumn("_known", F.lit(True))
        )
        row = ids.join(known, "id", "left").agg(
            F.count("*").alias("ids"), F.count_if(F.col("_known").isNull()).alias("orphans")
        ).select(
            F.lit(name).alias("relation"),
            "ids",
            "orphans",
            F.coalesce(F.try_divide(F.col("orphans") * 100.0, F.col("ids")), F.lit(0.0)).alias("pct"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def category_shares(df: DataFrame, columns: list[str], within: list[str] | None = None) -> DataFrame:
    """Counts and proportions of a category, overall or within groups; rows without a group are left out.

    The proportions use the counted rows, so the raw rows are shuffled once.
    """
    within = within or []
    for c in within:
        df = df.where(F.col(c).isNotNull())
    counts = df.groupBy(*within, *columns).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*within).agg(F.sum("n").alias("_total"))
    if within:
        counts = counts.join(totals, within)
        total = F.col("_total")
    else:
        total = totals.scalar()
    return counts.select(*within, *columns, "n", (F.col("n") / total).alias("share"))


def mix_by_ownership(
    events: DataFrame, key: str, category: str, owners: DataFrame, spread_by: list[str]
) -> DataFrame:
    """Share of each event category among owners and others (``owners`` lists the owning keys)."""
    owning = owners.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_owner", F.lit(True))
    marked = spread_join(events.select(key, category, *[c for c in spread_by if c not in (key, category)]),
                         owning, key, spread_by)
    grouped = marked.withColumn("owner", F.coalesce("_owner", F.lit(False)))
    return category_shares(grouped, [category], ["owner"])


def mode_by_group(df: DataFrame, group: str, column: str) -> DataFrame:
    """Most frequent value per group, the smallest one on ties."""
    counts = (
        df.where(F.col(group).isNotNull() & F.col(column).isNotNull())
        .groupBy(group, column).agg(F.count("*").alias("n"))
    )
    best = Window.partitionBy(group).orderBy(F.desc("n"), column)
    return counts.withColumn("_place", F.row_number().over(best)).where("_place = 1").select(group, column, "n")
