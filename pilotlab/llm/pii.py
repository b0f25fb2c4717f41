"""Personal data: exact base patterns, and candidates selected by gradient boosting.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. High-recall generators
propose further, overlapping spans: anything around an ``@``, runs of digit groups, long mixed tokens,
values that follow a word such as "password" and a sign.
Boosted trees score each candidate by its form and its context. They are trained here on a bounded
sample of distinct candidates of each kind: those that overlap a base span, or that have a known key
form or follow a word such as "password" and a sign, are positive, and the others negative. For each
kind the threshold is the least score from which all held-out candidates are precise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .text import let

# The base patterns, in order. Possessive repeats and starts at a run's edge (or where
# the last match ended) match the same spans as the plain patterns, without retries inside a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"

GENERATORS = {
    "contact": r"[^\s@]{0,64}+@[^\s@]{1,64}+",
    "number": r"[+(]?[0-9](?:[\x20().\-/]{0,2}+[0-9]){6,40}+",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+",
}
# The value after a key word and a sign, of any length: what stands in quotes, or a run without closing punctuation.
ASSIGNED = (
    r"(?i)(?:password|passwd|secret|token|api[_-]?key)[\"']?\s*+[=:]\s*+"
    r"(?:\"([^\"\r\n]++)\"|'([^'\r\n]++)'|[\"']?+([^\s\"']*[^\s\"'.,;:!?)\]}>]))"
)
KINDS = [*BASE, *GENERATORS]
KEY_FORM = r"^(?:AKIA|ASIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,}$"
KEY_WORD = r"(?i)(?:password|passwd|secret|token|api[_-]?key)[\"']?\s*[=:]\s*[\"']?$"
CONTEXT = 32
CHECKED = 512  # longer digit strings have no check digit

SAMPLE_ROWS = 20_000  # candidates that the trees are trained on, by hash of their form
TREES, DEPTH = 20, 3
PRECISION = 0.99
FEATURES = [
    "length", "digits", "upper", "lower", "other", "distinct", "at", "dots", "groups",
    "plus", "hex", "keyword", "assigned", "quoted", "digit_before", "checksum",
]


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all matches, in code points, end exclusive.

    Starts are running sums of what lies between the matches, in blocks of 256.
    """
    block = 256

    def places(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        steps = F.transform(
            hits, lambda h, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0)
        )
        return let(F.struct(hits.alias("hits"), steps.alias("steps")), summed)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, b: a + b)

    def summed(x: Column) -> Column:
        steps = x["steps"]
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")),
            lambda b: total(F.slice(steps, b * block + 1, F.lit(block))),
        )
        return let(F.struct(x["hits"].alias("hits"), steps.alias("steps"), blocks.alias("blocks")), spans)

    def spans(x: Column) -> Column:
        def span(h: Column, i: Column) -> Column:
            b = F.floor(i / block).cast("int")
            start = total(F.slice(x["blocks"], F.lit(1), b)) + total(F.slice(x["steps"], b * block + 1, i % block + 1))
            return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("match"))

        return F.transform(x["hits"], span)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    cut = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return let(cut, lambda x: F.when(F.size(x["hits"]) == 0, none).otherwise(places(x)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def weighed(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    places = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), weighed)
    return F.aggregate(places, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind) of the base matches, by start, then kind as listed."""
    def spans(rank: int, kind: str) -> Column:
        kept = F.filter(found(text, BASE[kind]), lambda m: _valid(kind, m["match"]))
        return F.transform(kept, lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")
        ))

    return F.sort_array(F.concat(*[spans(rank, kind) for rank, kind in enumerate(BASE)]))


def _count(match: Column, pattern: str) -> Column:
    return F.length(match) - F.length(F.regexp_replace(match, pattern, ""))


def _assigned(text: Column) -> Column:
    """Array of (start, end, match) of the values after key words."""
    def value(m: Column) -> Column:
        parts = [F.regexp_extract(m["match"], ASSIGNED, i) for i in (1, 2, 3)]
        quoted = (F.length(parts[0]) > 0) | (F.length(parts[1]) > 0)
        end = m["end"] - quoted.cast("int")
        return let(F.concat(*parts), lambda v: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("match")))

    return F.transform(found(text, ASSIGNED), value)


def candidates(text: Column) -> Column:
    """Array of (start, rank, end, kind, match, before) of what the generators propose, each once."""
    def spans(rank: int, kind: str, proposed: Column) -> Column:
        return F.transform(proposed, lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"),
            m["match"].alias("match"),
            F.substring(text, F.greatest(F.lit(1), m["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), m["start"])).alias("before"),
        ))

    listed = [spans(rank, kind, found(text, GENERATORS[kind])) for rank, kind in enumerate(GENERATORS, len(BASE))]
    # A value that the generator of its kind proposes as well is left to it.
    values = F.filter(_assigned(text), lambda v: ~v["match"].rlike(rf"^{GENERATORS['secret']}$"))
    return F.concat(*listed, spans(KINDS.index("secret"), "secret", values))


def _features() -> dict[str, Column]:
    m, before = F.col("match"), F.col("before")
    return {
        "length": F.length(m),
        "digits": _count(m, "[0-9]+"), "upper": _count(m, r"\p{Lu}+"), "lower": _count(m, r"\p{Ll}+"),
        "other": _count(m, r"[^0-9\p{L}]+"),
        "distinct": F.size(F.array_distinct(F.split(m, ""))),
        "at": _count(m, "@"), "dots": _count(m, r"\."), "groups": F.size(F.split(m, r"[\s().\-/]+")),
        "plus": m.startswith("+").cast("int"), "hex": m.rlike("^[0-9a-f]+$").cast("int"),
        "keyword": before.rlike(r"(?i)(?:pass|secret|token|key|mail|phone|tel|call|card|account|id)\W*$").cast("int"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("int"), "quoted": before.rlike("[\"']$").cast("int"),
        "digit_before": before.rlike("[0-9]$").cast("int"),
        "checksum": let(_digits(m), lambda d: F.when(F.length(d).between(8, CHECKED), _luhn(d)).otherwise(False)).cast("int"),
    }


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_row`` (a number of its own for each row), ``pii_base`` and ``pii_candidates``.

    To be stored before it is joined, so that the row numbers stay as they are.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    numbered = docs.withColumn("pii_row", F.monotonically_increasing_id())
    return numbered.withColumn("pii_base", base_spans(t)).withColumn("pii_candidates", candidates(t))


def _covered(base: Column, start: Column, end: Column, match: Column) -> Column:
    """Whether all letters and digits of a match lie in base spans (which are sorted by start)."""
    over = F.filter(base, lambda b: (b["start"] < end) & (b["end"] > start))

    def between(state: Column, to: Column) -> Column:
        return F.concat(state["out"], F.substring(match, state["at"] - start + 1, F.greatest(F.lit(0), to - state["at"])))

    def add(state: Column, b: Column) -> Column:
        return F.struct(F.greatest(state["at"], b["end"]).alias("at"), between(state, b["start"]).alias("out"))

    nothing = F.struct(start.alias("at"), F.lit("").alias("out"))
    return ~F.aggregate(over, nothing, add, lambda state: between(state, end)).rlike(r"[\p{L}\p{N}]")


def proposals(scanned: DataFrame) -> DataFrame:
    """One row for each candidate with ``match`` and ``before``, ``positive`` (see above), ``inside`` (it overlaps a
    base span), ``covered`` (base spans hold all its letters and digits), ``form`` (a hash of all that its features and
    class come from) and ``held`` (not for training, by form)."""
    one = scanned.select("pii_row", "pii_base", F.explode("pii_candidates").alias("c")).select("pii_row", "pii_base", "c.*")
    inside = F.exists("pii_base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    known = (F.col("kind") == "secret") & (F.col("match").rlike(KEY_FORM) | F.col("before").rlike(KEY_WORD))
    one = one.withColumn("inside", inside).withColumn("form", F.xxhash64("kind", "match", "before", "inside"))
    return one.select(
        "pii_row", "start", "rank", "end", "kind", "match", "before", "inside", "form",
        F.when(F.col("inside"), _covered(F.col("pii_base"), F.col("start"), F.col("end"), F.col("match"))).otherwise(False).alias("covered"),
        (F.pmod("form", F.lit(3)) == 0).alias("held"),
        (F.col("inside") | known).cast("double").alias("positive"),
    )


def training_sample(proposed: DataFrame) -> DataFrame:
    """At most ``SAMPLE_ROWS`` candidates that are not held out, each form once, drawn by hash.

    Kinds get equal shares; what a rare kind leaves of its share goes to the others.
    """
    forms = cut_lineage(proposed.where(~F.col("held")).select("kind", "form").distinct())
    counts = {r["kind"]: r["count"] for r in forms.groupBy("kind").count().collect()}
    drawn, left = [], SAMPLE_ROWS
    for i, kind in enumerate(sorted(counts, key=lambda k: (counts[k], k))):
        share = min(counts[kind], left // (len(counts) - i))
        drawn.append(forms.where(F.col("kind") == kind).orderBy(F.xxhash64("form", F.lit(7)), "form").limit(share))
        left -= share
    if not drawn:
        return proposed.limit(0)
    chosen = cut_lineage(reduce(DataFrame.unionAll, drawn))
    return proposed.join(F.broadcast(chosen), ["kind", "form"], "left_semi").dropDuplicates(["form"])


def select(proposed: DataFrame) -> DataFrame:
    """``pii_row`` and (start, rank, end, kind) of the candidates whose score reaches their kind's threshold.

    Those that add no letter or digit to the base spans are left out. The trees see a sample; the thresholds come from all held-out candidates. With candidates of one
    class only nothing is learned or selected.
    """
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features")

    def featured(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("match", "before")]
        return assembled.transform(rows.select(*kept, *[c.cast("double").alias(n) for n, c in _features().items()]))

    # In a fixed order, so that the trees do not depend on how the rows are dealt out.
    training = cut_lineage(featured(training_sample(proposed)).select("form", "features", "positive").coalesce(1).sortWithinPartitions("form"))
    nothing = proposed.select("pii_row", "start", "rank", "end", "kind").where(F.lit(False))
    if training.select("positive").distinct().count() < 2:
        return nothing
    model = GBTClassifier(
        labelCol="positive", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=1
    ).fit(training)

    p = F.get(vector_to_array("probability"), 1)
    scored = model.transform(featured(proposed)).withColumn("score", F.floor(p * 100).cast("int"))
    scored = cut_lineage(scored.select("pii_row", "start", "rank", "end", "kind", "covered", "held", "positive", "score"), "zstd")

    # Calibration: counts by kind and score in hundredths.
    bins = scored.where("held").groupBy("kind", "score").agg(F.sum("positive").alias("good"), F.count("*").alias("n")).collect()
    limits: dict[str, int] = {}
    for kind in GENERATORS:
        good = n = 0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["score"]):
            good, n = good + r["good"], n + r["n"]
            if good >= PRECISION * n:
                limits[kind] = r["score"]
    if not limits:
        return nothing
    reached = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("score") >= s) for k, s in limits.items()])
    return scored.where(reached & ~F.col("covered")).select("pii_row", "start", "rank", "end", "kind")


def detect(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of every row, ``pii_base`` and ``pii_spans``: base spans and selected
    candidates, by start, then kind as in ``KINDS``.

    A null text counts as empty and has no spans. Repeated rows are searched each. Positions are code
    points, ends exclusive. No rows give no rows. Columns named ``pii_...`` are reserved.
    """
    keep = docs.columns if keep is None else keep
    scanned = cut_lineage(scan(docs, text).select(*keep, "pii_row", "pii_base", "pii_candidates"), "zstd")
    chosen = select(proposals(scanned))
    span = F.struct("start", "rank", "end", "kind")
    added = chosen.groupBy("pii_row").agg(F.collect_list(span).alias("pii_added"))
    rows = scanned.drop("pii_candidates").join(added, "pii_row", "left")
    every = F.when(F.col("pii_added").isNull(), F.col("pii_base")).otherwise(F.sort_array(F.concat("pii_base", "pii_added")))
    return rows.select(*keep, "pii_base", every.alias("pii_spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in brackets; overlapping spans become
    one, named after the first. A null text stays null."""
    spans = detect(docs, text)

    def add(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        piece = F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"),
        )

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rebuilt = F.aggregate(
        "pii_spans", empty, add,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col(text), s["at"] + 1, F.length(text))),
    )
    new = F.when(F.size("pii_spans") == 0, F.col(text)).otherwise(rebuilt)
    return spans.select(*[new.alias(text) if c == text else F.col(c) for c in docs.columns])
