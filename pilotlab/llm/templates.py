"""Line deduplication by a tree of line templates.

A line's tokens lead it down a tree of fixed depth: the number of tokens, then the leading tokens,
with variable-looking tokens (those with a digit) as wildcards. A leaf whose lines differ in more than
``MAX_CHILDREN`` values at a place takes that place as a wildcard too, unless so few constants would
be left that the lines are not alike. Lines with the same template in different documents recur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .text import SPACES, let, lines

LEADING = 3  # tokens on the way to a leaf
MIN_TOKENS = 6  # shorter lines recur by chance
MAX_CHILDREN = 24  # values at a place before it becomes a wildcard
MIN_CONSTANT = 70  # per cent of its tokens that a template must keep
WILD = "<*>"

# Blanks inside a line other than single spaces; tokens with a digit, from their start.
LOOSE_BLANKS = r"[\x20\x09\x0B-\x0D]{2,}+|[\x09\x0B-\x0D]"
HAS_LOOSE_BLANKS = r"\x20\x20|[\x09\x0B-\x0D]"
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _key(*parts: Column) -> Column:
    """128 bits, as two hashes."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def _document(key: str, text: str) -> Column:
    """What stands for a document: its key and a hash of its text. Equal rows are one document."""
    return F.struct(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))


def _count(line: Column, part: str) -> Column:
    return F.floor((F.length(line) - F.length(F.replace(line, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _masked(line: Column) -> Column:
    """(line, n, wild): the line in its form, its tokens and the wildcards among them.

    Few lines need the patterns, and a test for that costs much less than a replacement.
    """

    def single(x: Column) -> Column:
        return F.when(x.rlike(HAS_LOOSE_BLANKS), F.regexp_replace(x, LOOSE_BLANKS, " ")).otherwise(x)

    def varied(x: Column) -> Column:
        return F.when(x.rlike("[0-9]"), F.regexp_replace(x, VARIABLE, WILD)).otherwise(x)

    def counted(x: Column) -> Column:
        wild = F.when(F.contains(x, F.lit(WILD)), _count(x, WILD)).otherwise(0)
        return F.struct(x.alias("line"), (_count(x, " ") + 1).alias("n"), wild.alias("wild"))

    return let(F.btrim(line, F.lit(SPACES)), lambda x: let(single(x), lambda y: let(varied(y), counted)))


def masked_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, ``place``, ``leaf``, ``line`` of each line that is long enough and constant enough.

    ``line`` has single blanks between its tokens and a wildcard for each token with a digit.
    """
    # Inside the array, because a later filter would be pushed down with a copy of all this.
    named = docs.where(F.col(text).isNotNull()).select(_document(key, text).alias("doc"), F.col(text).alias("text"))
    each = named.select("doc", F.posexplode(F.transform(lines(F.col("text")), _masked)).alias("place", "m"))
    each = each.select("doc", "place", "m.*").where(F.col("n") >= MIN_TOKENS)
    each = each.where(100 * (F.col("n") - F.col("wild")) >= MIN_CONSTANT * F.col("n"))
    leaf = F.xxhash64("n", F.substring_index("line", " ", LEADING))
    return each.select("doc", "place", leaf.alias("leaf"), "line")


def line_templates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, ``place``, ``template`` (a key) of each line that can recur. Stored.

    Tokens are looked at only for leaves with more than ``MAX_CHILDREN`` different lines.
    """
    found = masked_lines(docs, key, text)
    stored = cut_lineage(found.withColumn("template", _key(F.col("line"))), "zstd")
    keyed = stored.select("doc", "place", "leaf", "template")
    broad = (
        keyed.groupBy("leaf", "template").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("n"))
        .where(F.col("n") > MAX_CHILDREN).select("leaf")
    )
    broad = cut_lineage(broad)
    if broad.isEmpty():
        return keyed.drop("leaf")
    kinds = cut_lineage(stored.join(broad, "leaf", "left_semi").select("leaf", "line").distinct(), "zstd")
    kinds = kinds.withColumn("tokens", F.split("line", " "))
    values = kinds.select("leaf", F.posexplode("tokens").alias("at", "value")).distinct()
    wild = values.groupBy("leaf", "at").agg(F.count("*").alias("n")).where(F.col("n") > MAX_CHILDREN)
    places = wild.groupBy("leaf").agg(F.collect_list("at").alias("wild"))  # at most the tokens of a line
    general = F.transform("tokens", lambda t, i: F.when(F.array_contains("wild", i), F.lit(WILD)).otherwise(t))
    merged = kinds.join(places, "leaf").select("line", general.alias("general"))
    kept = F.size(F.filter("general", lambda t: t != WILD))
    merged = merged.where(100 * kept >= MIN_CONSTANT * F.size("general")).select(
        _key(F.col("line")).alias("template"), _key(F.array_join("general", " ")).alias("general")
    )
    joined = keyed.join(merged, "template", "left")
    return cut_lineage(joined.select("doc", "place", F.coalesce("general", "template").alias("template")))


def dropped_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc`` and ``dropped``, the places of its lines whose template an earlier document has.

    A template recurs if its first and last documents differ. The first keeps all its lines with it.
    """
    placed = line_templates(docs, key, text)
    span = placed.groupBy("template").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    recurring = span.where(~F.col("first").eqNullSafe(F.col("last"))).select("template", "first")
    gone = placed.join(recurring, "template").where(~F.col("doc").eqNullSafe(F.col("first")))
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("place")).alias("dropped"))


def drop_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines whose template an earlier document has, and ``n_lines``, ``n_dropped``.

    Documents are ordered by ``key`` (null first), then by a hash of their text; rows equal in both are
    one document and treated alike. A template that occurs in one document only stays there however
    often. Lines of fewer than ``MIN_TOKENS`` tokens stay. No row is removed: a text whose lines all go
    is empty. A null text stays null and has no lines; an empty one has one. Columns named ``n_lines``
    or ``n_dropped`` are replaced.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    rows = docs.toDF(*names)
    gone = cut_lineage(dropped_lines(rows, at[key], at[text]))
    gone = gone.select(F.col("doc.key").alias("_key"), F.col("doc.hash").alias("_hash"), "dropped")
    rows = rows.withColumn("_own", _document(at[key], at[text]))
    joined = rows.join(
        gone, F.col("_own.key").eqNullSafe(F.col("_key")) & (F.col("_own.hash") == F.col("_hash")), "left"
    )
    joined = joined.withColumn("_lines", F.when(F.col("dropped").isNotNull(), lines(F.col(at[text]))))
    kept = F.array_join(F.array_compact(
        F.transform("_lines", lambda x, i: F.when(~F.array_contains("dropped", i), x))
    ), "\n")
    new_text = F.when(F.col("dropped").isNull(), F.col(at[text])).otherwise(kept)
    n_lines = F.when(F.col(at[text]).isNull(), 0).otherwise(_count(F.col(at[text]), "\n") + 1)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[(new_text if c == text else F.col(at[c])).alias(c) for c in own],
        n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
