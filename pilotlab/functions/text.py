"""Text cleaning expressions. All of them are ``Column -> Column`` and stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Lets the Arrow functions below run on workers that do not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Null placeholders and the words read as true or false.
NULL_PLACEHOLDERS = ("n/a", "na", "n\\a", "null", "none", "nan", "-", "s/d", "sin dato", "")
TRUE_WORDS = ("1", "true", "si", "yes", "y", "verdadero", "s")
FALSE_WORDS = ("0", "false", "no", "n", "falso")
NULL_WORDS = ("nan", "none", "null", "n/a", "na", "")

# Unicode blanks plus the four ASCII separators that count as blanks in text data.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
def strip_blanks(c: Column) -> Column:
    return F.trim(c.cast("string"), F.lit(BLANKS))


def collapse_text(c: Column) -> Column:
    """Lower case, underscores to blanks, runs of blanks to one, no blanks at the ends."""
    other = "_" + BLANKS[1:]
    plain = F.translate(F.lower(c.cast("string")), other, " " * len(other))
    return F.trim(F.regexp_replace(plain, "  +", " "))


def drop_placeholders(collapsed: Column) -> Column:
    """Null for a null placeholder. The array form evaluates its argument once."""
    kept = F.array_except(F.array(collapsed), F.array(*[F.lit(p) for p in NULL_PLACEHOLDERS]))
    return F.get(kept, 0)


def normalize_text(c: Column) -> Column:
    """``collapse_text`` with null placeholders turned into real nulls."""
    return drop_placeholders(collapse_text(c))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every BMP character whose compatibility form has exactly one ASCII character."""
    src, dst = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            src.append(chr(code))
            dst.append(plain)
    return "".join(src), "".join(dst)


def strip_accents(c: Column, exact: bool = False) -> Column:
    """ASCII text without accents.

    The default covers every character with a one-letter ASCII form and drops the other non-ASCII
    ones. ``exact=True`` also expands ligatures and fractions, through an Arrow UDF.
    """
    if exact:
        return _strip_accents_arrow(c.cast("string"))
    src, dst = _accent_table()
    text = c.cast("string")
    ascii_only = F.regexp_replace(F.translate(text, src, dst), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), ascii_only).otherwise(text)


@F.pandas_udf(StringType())
def _strip_accents_arrow(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def _folded(c: Column) -> Column:
    return strip_accents(F.lower(strip_blanks(c)))


def classify_prefix(c: Column, labels: dict[str, str]) -> Column:
    """Label of the first prefix the folded text starts with; null when none does."""
    folded = _folded(c)
    out = F.lit(None).cast("string")
    for prefix, label in reversed(list(labels.items())):
        out = F.when(folded.startswith(prefix), F.lit(label)).otherwise(out)
    return out


def parse_boolean(c: Column, dtype: str = "string") -> Column:
    """True/false words to boolean; numbers count only when 0 or 1; anything else is null."""
    if dtype == "boolean":
        return c
    if dtype != "string":
        return F.when(c == 1, F.lit(True)).when(c == 0, F.lit(False))
    folded = _folded(c)
    return F.when(folded.isin(*TRUE_WORDS), F.lit(True)).when(folded.isin(*FALSE_WORDS), F.lit(False))


def boolean_unrecognised(c: Column, value: Column, dtype: str = "string") -> Column:
    """True where ``c`` is present, is no null word and ``value``, its boolean reading, is null."""
    missing = value.isNull() & c.isNotNull()
    return missing & ~_folded(c).isin(*NULL_WORDS) if dtype == "string" else missing
