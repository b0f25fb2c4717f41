"""Dates in mixed formats, plausible ranges and whole-day arithmetic on ``timestamp_ntz``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_blanks

# Names of the formats, in the order in which they are tried.
DATE_FORMATS = (
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%d",
    "%d/%m/%Y %H:%M",
    "%d/%m/%Y",
    "%d-%m-%Y",
    "%d.%m.%Y",
    "%m/%d/%Y",
    "%Y%m%d",
    "excel_serial",
    "unix_epoch_segundos",
    "unix_epoch_milisegundos",
)

_D = r"(3[01]|[12][0-9]|0[1-9]|[1-9])"
_M = r"(1[0-2]|0[1-9]|[1-9])"
# Years of nanosecond timestamps; other years match no pattern.
_Y = r"(16(?:7[89]|[89][0-9])|1[7-9][0-9]{2}|2[01][0-9]{2}|22(?:[0-5][0-9]|6[01]))"
_H = r"(2[0-3]|[01][0-9]|[0-9])"
_MS = r"([0-5][0-9]|[0-9])"

# format name -> (shape of the text, rewrite to "year-month-day hour:minute:second")
_SHAPES = {
    "%Y-%m-%dT%H:%M:%S": (f"^{_Y}-{_M}-{_D}[Tt]{_H}:{_MS}:{_MS}$", "$1-$2-$3 $4:$5:$6"),
    "%Y-%m-%d %H:%M:%S": (rf"^{_Y}-{_M}-{_D}\s+{_H}:{_MS}:{_MS}$", "$1-$2-$3 $4:$5:$6"),
    "%Y-%m-%d": (f"^{_Y}-{_M}-{_D}$", "$1-$2-$3"),
    "%d/%m/%Y %H:%M": (rf"^{_D}/{_M}/{_Y}\s+{_H}:{_MS}$", "$3-$2-$1 $4:$5:0"),
    "%d/%m/%Y": (f"^{_D}/{_M}/{_Y}$", "$3-$2-$1"),
    "%d-%m-%Y": (f"^{_D}-{_M}-{_Y}$", "$3-$2-$1"),
    "%d.%m.%Y": (rf"^{_D}\.{_M}\.{_Y}$", "$3-$2-$1"),
    "%m/%d/%Y": (f"^{_M}/{_D}/{_Y}$", "$3-$1-$2"),
    "%Y%m%d": (f"^{_Y}{_M}{_D}$", "$1-$2-$3"),
}

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DAY_SECONDS = 86_400
SERIAL_OF_EPOCH = 25_569
# 1900-01-01 and 2100-01-01 as days since 1899-12-30 and as seconds since 1970-01-01.
SERIAL_RANGE = (2, 73_051)
EPOCH_RANGE = (-2_208_988_800, 4_102_444_800)


def add_seconds(ts: Column, seconds: Column) -> Column:
    """Timestamp plus a (fractional) number of seconds, to the microsecond."""
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, F.round(seconds, 6).cast("decimal(18,6)"))


def add_days(ts: Column, days: Column | float) -> Column:
    days = days if isinstance(days, Column) else F.lit(float(days))
    return add_seconds(ts, days.cast("double") * _DAY_SECONDS)


def whole_days(start: Column, end: Column) -> Column:
    """Days from start to end, rounded down (minus twelve hours is minus one day).

    Interval arithmetic, because ``timestampdiff`` would go through the session time zone.
    """
    span = end - start
    days = F.extract(F.lit("DAY"), span)
    return (days - F.when(span < F.make_dt_interval(days), 1).otherwise(0)).cast("bigint")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _by_shape(text: Column, result: Callable[[str], Column], missing: Column) -> Column:
    """``result(format)`` of the pattern the text fits. Only ``/`` dates fit two: the day comes first.

    A separator at a fixed place rules out most formats before any pattern is tried.
    """

    def first_hit(*names: str) -> Column:
        hit = missing
        for name in reversed(names):
            hit = F.when(text.rlike(_SHAPES[name][0]), result(name)).otherwise(hit)
        return hit

    return (
        F.when(F.substring(text, 5, 1) == "-", first_hit(*DATE_FORMATS[2::-1], "%d-%m-%Y"))
        .when(F.contains(text, F.lit("/")), first_hit("%d/%m/%Y", "%d/%m/%Y %H:%M", "%m/%d/%Y"))
        .when(F.contains(text, F.lit("-")), first_hit("%d-%m-%Y"))
        .otherwise(first_hit("%Y%m%d", "%d.%m.%Y"))
    )


def parse_date(c: Column) -> Column:
    """``struct<value timestamp_ntz, format string>`` of a date in any of ``DATE_FORMATS``.

    The shape of the text picks one pattern, the text is rewritten once and cast once. What no pattern
    reads is tried as a spreadsheet serial, then epoch seconds, then epoch milliseconds.
    """
    text = strip_blanks(c)
    no_text = F.lit(None).cast("string")
    rewritten = _by_shape(text, lambda name: F.regexp_replace(text, *_SHAPES[name]), no_text)
    by_pattern = rewritten.try_cast("timestamp_ntz")

    number = text.try_cast("double")
    serial = number.between(*SERIAL_RANGE)
    epoch = number.between(*EPOCH_RANGE)
    epoch_ms = number.between(EPOCH_RANGE[0] * 1000, EPOCH_RANGE[1] * 1000)
    seconds = (
        F.when(serial, (number - SERIAL_OF_EPOCH) * _DAY_SECONDS)
        .when(epoch, number)
        .when(epoch_ms, number / 1000)
    )
    by_number = F.when(text.rlike(_NUMBER), add_seconds(ntz("1970-01-01 00:00:00"), seconds))
    number_format = F.when(
        text.rlike(_NUMBER),
        F.when(serial, F.lit("excel_serial"))
        .when(epoch, F.lit("unix_epoch_segundos"))
        .when(epoch_ms, F.lit("unix_epoch_milisegundos")),
    )
    return F.struct(
        F.coalesce(by_pattern, by_number).alias("value"),
        F.when(by_pattern.isNotNull(), _by_shape(text, F.lit, no_text)).otherwise(number_format).alias("format"),
    )


def date_value(c: Column) -> Column:
    return parse_date(c)["value"]


def date_format(c: Column) -> Column:
    return parse_date(c)["format"]


def plausible_range(role: str, as_of: Column) -> tuple[Column, Column]:
    """Lowest and highest plausible date of a ``birth``, ``expiry`` or ``other`` column."""
    if role == "birth":
        return add_days(as_of, -110 * 365), add_days(as_of, -18 * 365)
    ahead = 10 * 365 if role == "expiry" else 1
    return ntz("1900-01-01 00:00:00"), add_days(as_of, ahead)


def role_of(column: str) -> str:
    """Role of a date column by its name; the words are fixed values."""
    name = column.lower()
    if any(word in name for word in ("nacimiento", "birth")):
        return "birth"
    if any(word in name for word in ("vencimiento", "expira", "expiry")):
        return "expiry"
    return "other"


def out_of_range(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce((value < low) | (value > high), F.lit(False))
