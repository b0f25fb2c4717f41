"""National id: format and check digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_blanks


def format_id(c: Column) -> Column:
    """Digits of an id without separators; a lost leading zero of a nine-digit id is put back."""
    no_float_tail = F.regexp_replace(strip_blanks(c), r"\.0$", "")
    bare = F.regexp_replace(no_float_tail, r"(?U)[-.\s\x1c-\x1f]", "")
    return F.regexp_replace(bare, r"^([1-9][0-9]{8})$", "0$1")


def id_unrecognised(formatted: Column) -> Column:
    """True where a formatted id does not have ten digits (the value itself is kept)."""
    return formatted.isNotNull() & ~formatted.rlike(r"^[0-9]{10}$")


def id_is_valid(c: Column) -> Column:
    """Province 01-24, third digit at most 6 and a matching modulo-10 check digit; null is false."""
    text = strip_blanks(c)

    def digit(position: int) -> Column:
        return F.ascii(F.substring(text, position, 1)) - 48

    total = F.lit(0)
    for position in range(1, 10):
        d = digit(position)
        # Odd positions are doubled; a doubled digit of ten or more loses nine.
        total = total + (d * 2 - F.when(d >= 5, 9).otherwise(0) if position % 2 else d)
    province = digit(1) * 10 + digit(2)
    shape_ok = text.rlike(r"^[0-9]{10}$")
    valid = (
        province.between(1, 24)
        & (digit(3) <= 6)
        & ((10 - total % 10) % 10 == digit(10))
    )
    return F.coalesce(F.when(shape_ok, valid), F.lit(False))
