"""Declarative cleaning of a table: chains of column steps, and the quality report of a run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import dates, ids, numbers, text
from ..sources.tables import cut_lineage

LISTED = 50  # values shown in a report's maps; the complete table is ``unrecognised_values``


def _as_is(c: Column) -> Column:
    return c


@dataclass(frozen=True)
class Step:
    """One cleaner.

    ``apply(column, type name)`` does the work once per value; ``value`` and ``format`` read its
    outcome, and ``formats`` lists what the latter can be. ``unrecognised(source, value, type name)`` marks
    values the cleaner could not read. ``beyond(value, column name)`` marks values outside their plausible
    range, which stay as they are; the mark becomes a column ``<name>_out_of_range``.
    """

    name: str
    apply: Callable[[Column, str], Column]
    value: Callable[[Column], Column] = _as_is
    format: Callable[[Column], Column] | None = None
    formats: tuple[str, ...] = ()
    unrecognised: Callable[[Column, Column, str], Column] | None = None
    out_type: str = "string"
    beyond: Callable[[Column, str], Column] | None = None


def _lost(source: Column, value: Column, dtype: str) -> Column:
    return source.isNotNull() & value.isNull()


def text_step() -> Step:
    return Step("normalize_text", lambda c, t: text.collapse_text(c), text.drop_placeholders)


def date_step(as_of: Column | None = None) -> Step:
    """Dates; with ``as_of``, the present, they are held against the plausible range of the column's role."""

    def beyond(value: Column, column: str) -> Column:
        return dates.out_of_range(value, *dates.plausible_range(dates.role_of(column), as_of))

    return Step(
        "parse_date", lambda c, t: dates.parse_date(c), lambda d: d["value"], lambda d: d["format"],
        (*dates.DATE_FORMATS, "none"), _lost, "timestamp_ntz", None if as_of is None else beyond,
    )


def boolean_step() -> Step:
    return Step(
        "parse_boolean", text.parse_boolean, unrecognised=text.boolean_unrecognised, out_type="boolean"
    )


def prefix_step(labels: dict[str, str]) -> Step:
    return Step("classify_prefix", lambda c, t: text.classify_prefix(c, labels), unrecognised=_lost)


def number_step() -> Step:
    def apply(c: Column, t: str) -> Column:
        return numbers.parse_number(c) if t == "string" else c.cast("double")

    return Step("parse_number", apply, unrecognised=_lost, out_type="double")


def id_step() -> Step:
    return Step(
        "format_id", lambda c, t: ids.format_id(c), unrecognised=lambda c, v, t: ids.id_unrecognised(v)
    )


# A plan lists (column, chain of steps) in the order in which they are reported.
Plan = list[tuple[str, tuple[Step, ...]]]


@dataclass(frozen=True)
class _Stage:
    position: int
    level: int
    column: str
    step: Step
    source: Column
    source_type: str
    outcome: Column
    result: Column
    error: str | None = None


def _fault(out: DataFrame, step: Step, source: Column, dtype: str) -> str | None:
    """Why a step cannot work on this column, if so; found by analysis, without a job."""
    try:
        value = step.value(F.col("_outcome"))
        found = [value.alias("_value")]
        if step.format is not None:
            found.append(step.format(F.col("_outcome")).alias("_format"))
        if step.unrecognised is not None:
            found.append(step.unrecognised(source, value, dtype).alias("_unread"))
        out.select("*", step.apply(source, dtype).alias("_outcome")).select(*found).schema
    except Exception as error:  # whatever a cleaner raises is reported, and the others go on
        return f"{type(error).__name__}: {str(error).splitlines()[0]}"
    return None


def _staged(df: DataFrame, plan: Plan) -> tuple[DataFrame, list[_Stage]]:
    """``df`` with the result of every step as a column, one projection per depth of the chains.

    A step that cannot work on its column leaves it as it is and is marked with the error.
    """
    stages: list[_Stage] = []
    depth = max((len(chain) for _, chain in plan), default=0)
    out = df
    current = {column: (F.col(column), df.schema[column].dataType.typeName()) for column, _ in plan}
    for level in range(depth):
        outcomes, results = {}, {}
        for position, (column, chain) in enumerate(plan):
            if level < len(chain):
                source, dtype = current[column]
                step, name = chain[level], f"{position}_{level}"
                error = _fault(out, step, source, dtype)
                if error is not None:
                    stages.append(_Stage(position, level, column, step, source, dtype, source, source, error))
                    continue
                outcome = F.col(f"_outcome_{name}")
                outcomes[f"_outcome_{name}"] = step.apply(source, dtype)
                results[f"_result_{name}"] = step.value(outcome)
                current[column] = (F.col(f"_result_{name}"), step.out_type)
                stages.append(_Stage(position, level, column, step, source, dtype, outcome, current[column][0]))
        out = out.select("*", *[c.alias(n) for n, c in outcomes.items()])
        out = out.select("*", *[c.alias(n) for n, c in results.items()])
    return out, sorted(stages, key=lambda s: (s.position, s.level))


def _cleaned(df: DataFrame, stages: list[_Stage]) -> list[Column]:
    """Every column of ``df`` after its chain, then the marks of implausible values."""
    final = {s.column: s.result for s in stages}
    columns = [final[c].alias(c) if c in final else F.col(c) for c in df.columns]
    return columns + [
        s.step.beyond(s.result, s.column).alias(f"{s.column}_out_of_range")
        for s in stages if s.step.beyond is not None and s.error is None
    ]


def clean_table(df: DataFrame, plan: Plan) -> DataFrame:
    """Every column of ``df`` with its chain of steps applied, and a mark for each dated column whose step
    knows the plausible range. A step that cannot work on its column leaves it as it is."""
    staged, stages = _staged(df, plan)
    return staged.select(*_cleaned(df, stages))


def date_audit(df: DataFrame, columns: list[str], as_of: Column) -> DataFrame:
    """Adds ``<c>_value``, ``<c>_format`` and ``<c>_out_of_range`` for each date column."""
    out = df
    for c in columns:
        low, high = dates.plausible_range(dates.role_of(c), as_of)
        parsed = dates.parse_date(F.col(c))
        out = out.select(
            "*", parsed["value"].alias(f"{c}_value"), parsed["format"].alias(f"{c}_format")
        ).withColumn(f"{c}_out_of_range", dates.out_of_range(F.col(f"{c}_value"), low, high))
    return out


def _unread(stage: _Stage) -> Column | None:
    if stage.step.unrecognised is None or stage.error is not None:
        return None
    return stage.step.unrecognised(stage.source, stage.result, stage.source_type)


def _lost_values(stages: list[_Stage]) -> Column:
    """``array<struct<position, value>>`` of what the steps could not read; null for most rows."""
    found = []
    for i, s in enumerate(stages):
        unread = _unread(s)
        if unread is not None:
            found.append(F.when(unread, F.struct(F.lit(i).alias("position"), s.source.cast("string").alias("value"))))
    if not found:
        return F.lit(None).cast("array<struct<position:int,value:string>>")
    values = F.array_compact(F.array(*found))
    return F.when(F.size(values) > 0, values)


def _counts(stages: list[_Stage]) -> list[Column]:
    """The numbers of a report, as aggregates over the staged rows."""
    out = [F.count(F.lit(1)).alias("rows")]
    for i, s in enumerate(stages):
        out += [F.count_if(s.source.isNull()).alias(f"nulls_in_{i}"), F.count_if(s.result.isNull()).alias(f"nulls_out_{i}")]
        unread = _unread(s)
        if unread is not None:
            out.append(F.count_if(unread).alias(f"lost_{i}"))
        if s.error is None and s.step.format is not None:
            found = F.coalesce(s.step.format(s.outcome), F.lit("none"))
            out += [F.count_if(found == name).alias(f"format_{i}_{j}") for j, name in enumerate(s.step.formats)]
        if s.error is None and s.step.beyond is not None:
            out.append(F.count_if(s.step.beyond(s.result, s.column)).alias(f"beyond_{i}"))
    return out


class Watched:
    """A cleaned table whose report is counted while it is written.

    ``frame`` has the columns of ``clean_table`` and ``_lost``, what could not be read of each row. Write it, or
    rows chosen from it, without a shuffle on the way, so that a task that is run again is counted
    once; then ask for ``report``.
    """

    def __init__(self, df: DataFrame, plan: Plan) -> None:
        staged, self.stages = _staged(df, plan)
        self._observation = Observation()
        watched = staged.observe(self._observation, *_counts(self.stages))
        self.frame = watched.select(*_cleaned(df, self.stages), _lost_values(self.stages).alias("_lost"))

    def report(self, lost: DataFrame, table: str, listed: int = LISTED) -> DataFrame:
        """One row per (column, step), in plan order; its maps show the ``listed`` most frequent values of
        ``lost``, which holds the rows of ``unread``."""
        counts = self._observation.get
        rows = []
        for i, s in enumerate(self.stages):
            n = counts["rows"]
            formats = {
                name: counts[f"format_{i}_{j}"] for j, name in enumerate(s.step.formats) if counts.get(f"format_{i}_{j}")
            }
            rows.append((
                i, table, s.step.name, s.column, n, n, counts[f"nulls_in_{i}"], counts[f"nulls_out_{i}"], formats or None,
                counts.get(f"lost_{i}", 0), counts.get(f"beyond_{i}", 0), [s.error] if s.error else [],
            ))
        facts = lost.sparkSession.createDataFrame(
            rows, "position int, table string, function string, column string, rows_in long, rows_out long, nulls_in long,"
            " nulls_out long, formats map<string,bigint>, n_unrecognised long, n_out_of_range long, errors array<string>",
        )
        top = Window.partitionBy("position").orderBy(F.desc("n"), "value")
        values = (
            lost.groupBy("position", "value").agg(F.count("*").alias("n"))
            .withColumn("place", F.row_number().over(top)).where(F.col("place") <= listed)
            .groupBy("position")
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("unrecognised"))
        )
        return _report_columns(facts.join(values, "position", "left"))


def unread(stored: DataFrame) -> DataFrame:
    """``position``, ``value``: a row for each value that a step could not read, from a stored ``Watched.frame``."""
    return stored.where("_lost IS NOT NULL").select(F.inline("_lost"))


def unrecognised_values(lost: DataFrame, table: str, plan: Plan) -> DataFrame:
    """``table, column, function, value, n``: every value that a step could not read."""
    listed = [(column, step.name) for column, chain in plan for step in chain]
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(f).alias("function")) for c, f in listed])
    return lost.groupBy("position", "value").agg(F.count("*").alias("n")).withColumn("_step", F.get(names, "position")).select(
        F.lit(table).alias("table"), "_step.column", "_step.function", "value", "n"
    )


def quality_report(df: DataFrame, table: str, plan: Plan, listed: int = LISTED) -> DataFrame:
    """The report of a run over ``df``, from one pass that stores only what could not be read (nearly all nulls).
    The pass is made before this returns."""
    watched = Watched(df, plan)
    return watched.report(unread(cut_lineage(watched.frame.select("_lost"))), table, listed)


def _report_columns(report: DataFrame) -> DataFrame:
    n, far, new_nulls = F.col("n_unrecognised"), F.col("n_out_of_range"), F.col("nulls_out") - F.col("nulls_in")
    warnings = F.array_compact(F.array(
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" values not recognised"))),
        F.when(
            (F.col("function") == "normalize_text") & (new_nulls > 0),
            F.concat(new_nulls.cast("string"), F.lit(" placeholders turned into null")),
        ),
        F.when(far > 0, F.concat(far.cast("string"), F.lit(" dates outside the plausible range, marked and kept"))),
    ))
    return report.select(
        "position", "table", "function", "column", "rows_in", "rows_out", "nulls_in", "nulls_out",
        "formats", "unrecognised", "n_unrecognised", "n_out_of_range", warnings.alias("warnings"),
        "errors", (F.size("errors") == 0).alias("ok"),
    )


def dedup_report(summary: DataFrame, table: str) -> DataFrame:
    """The duplicate summary of a table in the shape of the quality report."""
    removed = F.col("removed")
    return summary.select(
        F.lit(-1).alias("position"),
        F.lit(table).alias("table"),
        F.lit("drop_exact_duplicates").alias("function"),
        F.lit(table).alias("column"),
        "rows_in",
        "rows_out",
        F.lit(0).cast("bigint").alias("nulls_in"),
        F.lit(0).cast("bigint").alias("nulls_out"),
        F.expr("CAST(NULL AS map<string,bigint>)").alias("formats"),
        F.expr("CAST(NULL AS map<string,bigint>)").alias("unrecognised"),
        F.lit(0).cast("bigint").alias("n_unrecognised"),
        F.lit(0).cast("bigint").alias("n_out_of_range"),
        F.array_compact(F.array(F.when(
            removed > 0, F.format_string("%d exact duplicates removed (%.2f%%)", removed, F.col("pct"))
        ))).alias("warnings"),
        F.array().cast("array<string>").alias("errors"),
        F.lit(True).alias("ok"),
    )
