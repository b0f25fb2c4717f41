"""Native column expressions over whole texts. Words are ``[^\\x20\\x09-\\x0D]+``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def words(text: Column) -> Column:
    """The words of a text; none for a null or blank one."""
    trimmed = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(none)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)
