"""Ranks, running counts and exact quantiles without moving a whole column into one task."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage

# Distinct values of a bucket of a distributed ranking.
RUNS_PER_BUCKET = 1_000_000
# A quantile is looked for between the approximate percentiles this far below and above it, and ranked
# among at most this many rows.
BRACKET, ACCURACY = 3e-4, 10_000
MAX_RANKED = 200_000
# A bound for the newest row is taken from one row in so many.
PROBED = 1024


@contextmanager
def few_rows_filter_joins(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside let Spark filter the large side of a join by a Bloom filter of the filtered side's keys,
    whatever the sizes that it expects before the filter. It drops rows before they are shuffled, never matches."""
    rule = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {f"{rule}enabled": "true", f"{rule}applicationSideScanSizeThreshold": "0", f"{rule}creationSideThreshold": "1PB"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def newest(df: DataFrame, time: str, by: list[str]) -> Column:
    """The exact maximum of ``time``, a timestamp without zone; null without rows. It runs two jobs.

    The first takes the maximum of the rows in one of ``PROBED`` parts by a hash of ``by``, which the
    true one cannot be below; the second takes the maximum of all rows from there on. Where ``by`` and
    ``time`` come from one table, both conditions reach its scan, so joins that made ``df`` move few rows
    of it, and few of the tables joined to it. The bound is a literal, and so is the result.
    """
    def latest(rows: DataFrame) -> Column | None:
        with few_rows_filter_joins(df.sparkSession):
            text = rows.agg(F.max(time).cast("string")).first()[0]
        return None if text is None else F.lit(text).cast(df.schema[time].dataType)

    bound = latest(df.where(F.pmod(F.xxhash64(*by), F.lit(PROBED)) == 0))
    found = latest(df if bound is None else df.where(F.col(time) >= bound))
    return F.lit(None).cast(df.schema[time].dataType) if found is None else found


def value_runs(df: DataFrame, columns: dict[str, Column], **extra: Column) -> DataFrame:
    """``(variable, value, n, ...)``: how often each distinct value occurs, nulls left out.

    ``extra`` are aggregates over the rows of a run. Equal values are combined before the shuffle.
    """
    if not columns:
        raise ValueError("no columns are given")
    pairs = F.array(
        *[F.struct(F.lit(k).alias("variable"), c.cast("double").alias("value")) for k, c in columns.items()]
    )
    keep = [c for c in df.columns if extra]
    long = df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    aggregates = [F.count("*").alias("n"), *[c.alias(k) for k, c in extra.items()]]
    return long.groupBy("variable", "value").agg(*aggregates)


def _bucket_of(runs: DataFrame, buckets: int) -> DataFrame:
    """Adds ``bucket``: how many of the row's sorted ``cuts`` lie below its value, by binary search.

    One projection per step keeps the search inside generated code.
    """
    out = runs.withColumn("bucket", F.lit(0))
    step = 1 << (buckets - 1).bit_length()
    while step > 1:
        step //= 2
        cut = F.get("cuts", F.col("bucket") + (step - 1))
        out = out.withColumn("bucket", F.col("bucket") + F.when(cut < F.col("value"), step).otherwise(0))
    return out.drop("cuts")


def with_rows_before(runs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Adds ``before``, the number of rows with a smaller value of the same variable.

    Values are cut into buckets at approximate quantiles, counted within each bucket, and shifted by
    the totals of the lower buckets. The cut points only balance the work; the counts are exact. The
    bucketed runs are written once, because the totals and the running counts must see the same cuts.
    There is a bucket for each ``RUNS_PER_BUCKET`` runs, and both broadcast frames have a row for each.
    """
    runs = cut_lineage(runs)
    buckets = buckets or max(2, -(-runs.count() // RUNS_PER_BUCKET))
    grid = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = runs.groupBy("variable").agg(F.percentile_approx("value", grid, 10_000).alias("cuts"))
    bucketed = cut_lineage(_bucket_of(runs.join(F.broadcast(cuts), "variable"), buckets))
    below = Window.partitionBy("variable").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("variable", "bucket").agg(F.sum("n").alias("size"))
        .select("variable", "bucket", F.coalesce(F.sum("size").over(below), F.lit(0)).alias("offset"))
    )
    earlier = (
        Window.partitionBy("variable", "bucket").orderBy("value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        bucketed.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(F.broadcast(offsets), ["variable", "bucket"])
        .withColumn("before", F.col("offset") + F.col("inside"))
        .drop("offset", "inside", "bucket")
    )


def _numbers(columns: dict[str, Column]) -> dict[str, Column]:
    """The columns as doubles, with nulls for what is no number."""
    doubles = {n: c.cast("double") for n, c in columns.items()}
    return {n: F.when(~F.isnan(c), c) for n, c in doubles.items()}


@dataclass
class _Segment:
    """Values of one column and group strictly between ``low`` and ``high`` (none: open), and the ranks in it.

    ``below`` rows of the column are smaller; ``cuts`` are ascending values inside.
    """

    group: object
    column: int
    low: float | None
    high: float | None
    below: int
    rows: int
    ranks: set[int]
    cuts: list[float]


def _inside(segments: list[_Segment], values: list[Column], by: str | None) -> Column:
    """Array of ``(s, value)`` for the segments that a row's values lie in."""
    found = []
    for s, segment in enumerate(segments):
        value = values[segment.column]
        holds = value.isNotNull()
        if by is not None:
            holds &= F.col(by).eqNullSafe(F.lit(segment.group))
        if segment.low is not None:
            holds &= value > segment.low
        if segment.high is not None:
            holds &= value < segment.high
        found.append(F.when(holds, F.struct(F.lit(s).alias("s"), value.alias("value"))))
    return F.array_compact(F.array(*found))


def _narrowed(df: DataFrame, segments: list[_Segment], values: list[Column], by: str | None) -> tuple[dict, list[_Segment]]:
    """One round: exact counts between and at the cuts. Ranks at a cut are found; the others go on in
    the space between two cuts, which has at least one distinct value less."""
    rows = df.select(F.explode(_inside(segments, values, by)).alias("x")).select("x.*")
    cuts = df.sparkSession.createDataFrame([(s, x.cuts) for s, x in enumerate(segments)], "s int, cuts array<double>")
    most = max(len(x.cuts) for x in segments) + 1
    placed = _bucket_of(rows.join(F.broadcast(cuts), "s").withColumn("all_cuts", F.col("cuts")), most)
    at = F.coalesce(F.get("all_cuts", F.col("bucket")) == F.col("value"), F.lit(False))
    counts: dict[int, list[tuple[int, bool, int]]] = {}
    for r in placed.groupBy("s", "bucket", at.alias("at")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["s"], []).append((r["bucket"], r["at"], r["n"]))
    found, rest = {}, []
    for s, segment in enumerate(segments):
        below = segment.below
        for bucket, at_cut, n in sorted(counts.get(s, [])):
            ranks = {r for r in segment.ranks if below <= r < below + n}
            if ranks and at_cut:
                found.update({(segment.group, segment.column, r): segment.cuts[bucket] for r in ranks})
            elif ranks:
                low = segment.cuts[bucket - 1] if bucket else segment.low
                high = segment.cuts[bucket] if bucket < len(segment.cuts) else segment.high
                rest.append(_Segment(segment.group, segment.column, low, high, below, n, ranks, []))
            below += n
    return found, rest


def _ranked(df: DataFrame, segments: list[_Segment], values: list[Column], by: str | None) -> dict:
    """The values at the ranks of segments with at most ``MAX_RANKED`` rows each."""
    runs = df.select(F.explode(_inside(segments, values, by)).alias("x")).select("x.*").groupBy("s", "value").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("s").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = df.sparkSession.createDataFrame(
        [(s, r, r - x.below) for s, x in enumerate(segments) for r in sorted(x.ranks)], "s int, rank bigint, place bigint"
    )
    before = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    hit = before.join(F.broadcast(ranks), "s").where("before <= place AND place < before + n")
    return {(segments[r["s"]].group, segments[r["s"]].column, r["rank"]): r["value"] for r in hit.collect()}


def _near(position: float) -> tuple[float, float]:
    return max(0.0, position - BRACKET), min(1.0, position + BRACKET)


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float], by: str | None = None) -> DataFrame:
    """``(variable, p, value)``: quantiles with linear interpolation between order statistics.

    Every asked variable has a row for each probability; the value is null if it has no numbers. With
    ``by``, a column of few values (nulls are one), each of its groups has its own rows and the column comes first.

    Approximate percentiles on both sides of each wanted rank cut the values; an aggregate counts the
    rows between and at the cuts, and the space that holds the rank is cut again until it has at most
    ``MAX_RANKED`` rows. Only those are ranked. Poor cuts cost rounds, never a larger ranking. The jobs
    run before this returns; the driver sees a few numbers for each variable, group and probability.
    """
    values, probs = _numbers(columns), [float(p) for p in probs]
    spark, listed, names = df.sparkSession, list(values.values()), list(values)
    schema = "variable string, p double, value double"
    if by is not None:
        schema = f"`{by}` {df.schema[by].dataType.simpleString()}, {schema}"
    if not values or not probs:
        return spark.createDataFrame([], schema)
    grid = F.array(*[F.lit(x) for p in probs for x in _near(p)])
    first = df.groupBy(*([by] if by is not None else [])).agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(listed)],
        *[F.percentile_approx(c, grid, ACCURACY).alias(f"q{i}") for i, c in enumerate(listed)],
    ).collect()
    groups = [(r[by] if by is not None else None, r) for r in first]
    open_segments = [
        _Segment(
            g, i, None, None, 0, r[f"n{i}"],
            {f((r[f"n{i}"] - 1) * p) for p in probs for f in (math.floor, math.ceil)}, sorted(set(r[f"q{i}"])),
        )
        for g, r in groups for i in range(len(listed)) if r[f"n{i}"]
    ]
    found: dict = {}
    small: list[_Segment] = []
    while open_segments:
        hit, rest = _narrowed(df, open_segments, listed, by)
        found.update(hit)
        small += [s for s in rest if s.rows <= MAX_RANKED]
        open_segments = [s for s in rest if s.rows > MAX_RANKED]
        if open_segments:
            rows = df.select(F.explode(_inside(open_segments, listed, by)).alias("x")).select("x.*")
            grids = [sorted({x for r in s.ranks for x in _near((r - s.below) / s.rows)}) for s in open_segments]
            cuts = rows.agg(*[
                F.percentile_approx(F.when(F.col("s") == s, F.col("value")), F.array(*[F.lit(x) for x in g]), ACCURACY).alias(f"q{s}")
                for s, g in enumerate(grids)
            ]).first()
            for s, segment in enumerate(open_segments):
                segment.cuts = sorted(set(cuts[f"q{s}"]))
    if small:
        found.update(_ranked(df, small, listed, by))
    out = []
    for g, r in groups:
        for i, name in enumerate(names):
            for p in probs:
                value, position = None, (r[f"n{i}"] - 1) * p
                if r[f"n{i}"]:
                    low, high = found[g, i, math.floor(position)], found[g, i, math.ceil(position)]
                    value = low + (high - low) * (position - math.floor(position)) if high != low else low
                out.append((*([g] if by is not None else []), name, p, value))
    return spark.createDataFrame(out, schema)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    quartiles = (
        exact_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
        .groupBy("variable")
        .agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
               for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    )
    values = F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns
    ])
    moments = (
        df.select(F.explode(values).alias("v")).select("v.*")
        .groupBy("variable")
        .agg(
            F.count("value").alias("count"), F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        )
    )
    return moments.join(F.broadcast(quartiles), "variable", "left").select(
        "variable", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )
