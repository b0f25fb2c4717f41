"""Numbers out of text with mixed separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(c: Column) -> Column:
    """Double from text such as ``$1,234.50``, ``1.234,50`` or ``12 USD``; null when unreadable.

    With both separators the last one is the decimal mark. A lone comma is decimal when at most two
    characters follow it, otherwise it groups thousands. A lone dot is always decimal.
    """
    kept = F.regexp_replace(c.cast("string"), r"[^0-9,.\-]", "")
    has_dot = F.contains(kept, F.lit("."))
    comma_last = kept.rlike(r",[^.]*$")
    decimal_comma = F.when(has_dot, comma_last).otherwise(kept.rlike(r",[^,]{0,2}$"))
    plain = (
        F.when(~F.contains(kept, F.lit(",")), kept)
        .when(decimal_comma, F.translate(kept, ",.", "."))
        .otherwise(F.translate(kept, ",", ""))
    )
    return plain.try_cast("double")
