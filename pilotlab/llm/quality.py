"""Quality verdicts by a learned decision list.

Text statistics are integers. Sequential covering learns rules for the rejected class from labelled
documents: a rule grows by the threshold with the best information gain, is pruned on held-out rows,
and is kept while it is precise there. All counts are Spark aggregates over every labelled row; the
driver sees histograms of bounded integers only. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .text import lines, without, words, SPACES

SYMBOLS = "#*$%&|<>"
SMALL_REPEATS = 64

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "f_length", "f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_distinct",
    "f_upper", "f_marks", "f_digits", "f_line_words",
]

MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.95  # of a rule on the rows held out for pruning
MIN_COVERED = 3  # rejected rows that a rule must find among those it grows on


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``BASE`` and ``FEATURES`` of every whole text; a null text has no words.

    ``n_repeat_words`` counts the words inside 3-word windows that occur at least twice. Windows are
    64-bit hashes. With few repeated hashes each window is looked up among them; with more, the
    windows are sorted with their places, so that no text takes quadratic time.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    known = docs.columns
    step = docs.select("*", t.alias("_t"), words(t).alias("_w"))
    step = step.select(
        *known, "_t", "_w", F.size("_w").alias("_n"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        F.filter(lines(F.col("_t")), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("_l"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 3),
        lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)),
    )
    no_longs = F.array().cast("array<bigint>")
    step = step.withColumn("_g", F.when(F.col("_n") >= 3, windows).otherwise(no_longs))
    step = step.withColumn("_s", F.sort_array("_g"))
    step = step.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, i: x == F.get("_s", i - 1))))
    placed = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    step = step.withColumn("_p", F.when(F.size("_d") > SMALL_REPEATS, placed))
    looked_up = F.filter(
        F.transform("_g", lambda g, i: F.when(F.array_contains("_d", g), i)), lambda i: i.isNotNull()
    )
    repeated = F.filter(
        "_p", lambda x, i: (x.g == F.get("_p", i - 1).g) | (x.g == F.get("_p", i + 1).g)
    )
    step = step.withColumn(
        "_i",
        F.when(F.size("_d") == 0, F.array().cast("array<int>"))
        .when(F.size("_d") <= SMALL_REPEATS, looked_up)
        .otherwise(F.sort_array(F.transform(repeated, lambda x: x.i))),
    )
    covered = F.aggregate(
        F.transform("_i", lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get("_i", i - 1)))),
        F.lit(0), lambda a, b: a + b,
    )
    long = lambda c: c.cast("long")
    step = step.select(
        *known, "_t", "_w", "_l",
        long(F.col("_n")).alias("n_words"),
        long(F.length(without(F.col("_t"), SPACES))).alias("word_chars"),
        long(F.length("_t") - F.length(without(F.col("_t"), SYMBOLS))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        long(covered).alias("n_repeat_words"),
        long(F.size(F.array_distinct("_h"))).alias("_distinct"),
        long(F.size("_l")).alias("_lines"),
        long(F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}+", ""))).alias("_upper"),
        long(F.length("_t") - F.length(without(F.col("_t"), "!?|"))).alias("_marks"),
        long(F.length("_t") - F.length(without(F.col("_t"), "0123456789"))).alias("_digits"),
    )

    def per_mille(part: Column, whole: str) -> Column:
        return F.least(F.lit(1000), F.floor(1000 * part / F.greatest(F.lit(1), F.col(whole)))).cast("int")

    return step.select(
        *known, *BASE,
        F.floor(20 * F.log2(F.col("n_words") + F.lit(1.0))).cast("int").alias("f_length"),
        F.least(F.lit(1000), F.floor(10 * F.col("word_chars") / F.greatest(F.lit(1), F.col("n_words")))).cast("int").alias("f_word_length"),
        per_mille(F.col("n_symbols"), "word_chars").alias("f_symbols"),
        per_mille(F.col("n_dup_lines"), "_lines").alias("f_dup_lines"),
        per_mille(F.col("n_repeat_words"), "n_words").alias("f_repeats"),
        per_mille(F.col("_distinct"), "n_words").alias("f_distinct"),
        per_mille(F.col("_upper"), "word_chars").alias("f_upper"),
        per_mille(F.col("_marks"), "n_words").alias("f_marks"),
        per_mille(F.col("_digits"), "word_chars").alias("f_digits"),
        F.least(F.lit(1000), F.floor(F.col("n_words") / F.greatest(F.lit(1), F.col("_lines")))).cast("int").alias("f_line_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.at_least else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold}"


@dataclass
class DecisionList:
    """Rules in order; a row that meets all conditions of one is rejected, the rest is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def keeps(self) -> Column:
        verdict = F.lit(True)
        for rule in reversed(self.rules):
            verdict = F.when(_all(rule), F.lit(False)).otherwise(verdict)
        return verdict

    def __str__(self) -> str:
        return "\n".join([*["reject if " + " and ".join(map(str, r)) for r in self.rules], "keep otherwise"])


def _all(conditions: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in conditions], F.lit(True))


def labelled(statistics: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Statistics with ``bad`` (1: rejected) and ``held`` (1: for pruning), by a hash of the key.

    Null keys and null labels take no part; the label of a repeated key is the majority, kept on a tie.
    """
    votes = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("_key")).agg((F.avg(F.col(label).cast("double")) < 0.5).cast("int").alias("bad"))
    )
    held = (F.pmod(F.xxhash64(F.col(key)), F.lit(3)) == 0).cast("int").alias("held")
    return statistics.join(votes, F.col(key) == F.col("_key")).select(*FEATURES, "bad", held)


def fit(rows: DataFrame) -> DecisionList:
    """Decision list from the rows of ``labelled``; one with no rules if a class is missing."""
    rows = cut_lineage(rows)
    found = DecisionList()
    while len(found.rules) < MAX_RULES:
        left = rows.where(found.keeps())
        rule = _grow(left)
        rule = rule and _prune(left, rule)
        if not rule:
            break
        found.rules.append(rule)
    return found


def _histogram(rows: DataFrame, held: int) -> dict[str, list[tuple[int, int, int]]]:
    """For each feature its ``(value, kept, bad)`` counts by value; features are small integers."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES]))
    counts = (
        rows.where(F.col("held") == held).select(pairs.alias("x"), "bad")
        .groupBy("x.f", "x.v").agg(F.sum(1 - F.col("bad")).alias("kept"), F.sum("bad").alias("bad"))
    )
    out: dict[str, list[tuple[int, int, int]]] = {f: [] for f in FEATURES}
    for r in counts.collect():
        out[r["f"]].append((r["v"], r["kept"], r["bad"]))
    return {f: sorted(v) for f, v in out.items()}


def _grow(rows: DataFrame) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        histogram = _histogram(rows.where(_all(rule)), 0)
        kept = sum(k for _, k, _ in histogram[FEATURES[0]])
        bad = sum(b for _, _, b in histogram[FEATURES[0]])
        if not bad or not kept:
            break
        before = log2(bad / (bad + kept))
        best: tuple[float, Condition] | None = None
        for feature in FEATURES:
            values = histogram[feature]
            low_kept = low_bad = 0
            for (v, k, b), (above, _, _) in zip(values, values[1:]):
                low_kept, low_bad = low_kept + k, low_bad + b
                middle = (v + above) // 2
                for at_least, p, n in (
                    (False, low_bad, low_kept), (True, bad - low_bad, kept - low_kept)
                ):
                    if p < MIN_COVERED:
                        continue
                    gain = p * (log2(p / (p + n)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, Condition(feature, at_least, middle + 1 if at_least else middle)
        if best is None:
            break
        rule.append(best[1])
    return rule


def _prune(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The shortest beginning of the rule that is best on the held-out rows; none if it is not precise."""
    lengths = range(1, len(rule) + 1)
    sums = [
        F.sum(F.when(_all(rule[:n]), value).otherwise(0)).alias(f"{name}{n}")
        for n in lengths for name, value in (("p", F.col("bad")), ("n", 1 - F.col("bad")))
    ]
    r = rows.where("held = 1").agg(*sums).first()
    worth = [(r[f"p{n}"] or 0, r[f"n{n}"] or 0) for n in lengths]
    precise = [n for n, (p, q) in zip(lengths, worth) if p and p / (p + q) >= MIN_PRECISION]
    if not precise:
        return []
    return rule[: max(precise, key=lambda n: (worth[n - 1][0] - worth[n - 1][1], -n))]


def assess(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DecisionList]:
    """``key``, ``BASE``, ``base_failed`` and ``kept`` of every row, and the list that was learned.

    Rules are learned on labelled rows that pass the base rule, which they need not repeat. A null or
    blank text has no words and fails the base rule. Repeated rows are judged each. Without
    labels, or with one class only, the base rule alone decides. Other columns are left out.
    """
    statistics = cut_lineage(add_statistics(docs.select(key, text), text).drop(text))
    failed = base_failed()
    rules = fit(labelled(statistics.where(~failed), labels, key))
    return statistics.select(key, *BASE, failed.alias("base_failed"), (~failed & rules.keeps()).alias("kept")), rules


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their own columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    at = names[docs.columns.index(key)]
    staged = cut_lineage(add_statistics(renamed, names[docs.columns.index(text)]), "zstd")
    passed = staged.where(~base_failed())
    rules = fit(labelled(passed.withColumnRenamed(at, key), labels, key))
    return passed.where(rules.keeps()).select(*names).toDF(*docs.columns)
