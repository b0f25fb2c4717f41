"""Equi-join of a large event table with one row per key, safe when a key holds much of the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.tables import cut_lineage

ROWS_PER_SLICE = 2_000_000
SKETCH_ITEMS = 1_000
SKETCH_GROUPS = 256
# Largest side that is broadcast: a key and a few fixed-width columns per row.
SMALL_DIMS_ROWS = 100_000


def heavy_keys(
    events: DataFrame, key: str, rows_per_slice: int = ROWS_PER_SLICE
) -> list[tuple[object, int]]:
    """``(key, slices)`` of keys with more than ``rows_per_slice`` rows; the null key included.

    One scan of the key column with frequent-items sketches, merged in ``SKETCH_GROUPS`` groups whose
    top items are then added up. The keys found are at most rows / ``rows_per_slice``. The estimates only decide how finely a key is cut, never which rows are kept: a key
    that is missed is joined uncut.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS))
    sketch = F.expr(f"approx_top_k(`{key}`, {SKETCH_ITEMS}, {10 * SKETCH_ITEMS})")
    item_type = events.schema[key].dataType.simpleString()
    null_item = F.struct(F.lit(None).cast(item_type).alias("item"), F.col("nulls").alias("count"))
    counts = (
        events.select(key)
        .groupBy(group.alias("_group"))
        .agg(sketch.alias("top"), F.count_if(F.col(key).isNull()).alias("nulls"))
        .select(F.explode(F.concat("top", F.array(null_item))).alias("t"))
        .groupBy("t.item").agg(F.sum("t.count").alias("n"))
        .where(F.col("n") > rows_per_slice)
    )
    return [(r["item"], -(-r["n"] // rows_per_slice)) for r in counts.collect()]


def splits_skewed_joins(spark: SparkSession) -> bool:
    """Whether Spark itself cuts partitions of a shuffle join that are far larger than the others."""
    rules = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(r).lower() == "true" for r in rules)


def spread_join(
    events: DataFrame,
    dims: DataFrame,
    key: str,
    spread_by: list[str],
    how: str = "left",
    dims_rows: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``events`` joined (``left`` or ``inner``) to ``dims``, which holds each key at most once.

    ``dims`` is counted first (or its bound is given as ``dims_rows``): up to ``SMALL_DIMS_ROWS`` rows
    are broadcast, and the events are not shuffled. Larger ones are joined by shuffle. There, the rows
    of a heavy key are cut into slices by a hash of ``spread_by`` and that key's single ``dims`` row is
    repeated once per slice; the list of heavy keys is bounded, see ``heavy_keys``.
    """
    if (dims.count() if dims_rows is None else dims_rows) <= SMALL_DIMS_ROWS:
        return events.join(F.broadcast(dims), key, how)
    heavy = heavy_keys(events, key, rows_per_slice)
    if not heavy:
        return events.join(dims, key, how)

    null_slices = max((n for k, n in heavy if k is None), default=1)
    schema = StructType([events.schema[key], StructField("_slices", IntegerType())])
    listed = F.broadcast(
        events.sparkSession.createDataFrame([(k, n) for k, n in heavy if k is not None], schema)
    )
    slices = F.when(F.col(key).isNull(), F.lit(null_slices)).otherwise(F.coalesce("_slices", F.lit(1)))
    cut_events = (
        events.join(listed, key, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*spread_by), slices).cast("int"))
        .drop("_slices")
    )
    cut_dims = (
        dims.join(listed, key, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
        .drop("_slices")
    )
    return cut_events.join(cut_dims, [key, "_slice"], how).drop("_slice")


def of_keys(events: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    """The events of the keys in ``dims``, a stored table. The filter moves below the joins that ``events`` was made
    by, to the table that has the key, so that those joins move only such rows; up to ``SMALL_DIMS_ROWS`` keys are
    broadcast."""
    keys = dims.select(key)
    return events.join(F.broadcast(keys) if dims.count() <= SMALL_DIMS_ROWS else keys, key, "left_semi")


def aggregate_by_key(
    events: DataFrame,
    dims: DataFrame,
    key: str,
    carry: list[str],
    aggregates: dict[str, Column],
    defaults: dict[str, object],
    spread_by: list[str],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Every ``dims`` row with aggregates over its events; ``defaults`` where there are none.

    The events see only the ``carry`` columns of ``dims``. Slices of a heavy key are partly aggregated
    where they are and only their partial results meet. ``dims`` is written once, because it is
    counted, joined to the events and joined to their aggregates.
    """
    dims = cut_lineage(dims)
    joined = spread_join(
        events, dims.select(key, *carry), key, spread_by, "inner", rows_per_slice=rows_per_slice
    )
    found = joined.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])
    return dims.join(found, key, "left").fillna(defaults)
