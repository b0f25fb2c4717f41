"""Literal values through every cleaning expression."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pilotlab.functions import dates, ids, numbers, text


def run(spark, values, expression, dtype="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {dtype}").select("i", expression(F.col("v")).alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


def check(spark, cases, expression, dtype="string"):
    got = run(spark, list(cases), expression, dtype)
    assert dict(zip(cases, got)) == cases


def test_normalize_text(spark):
    check(spark, {
        " CASH_IN ": "cash in", "Cash  In": "cash in", "N/A": None, "Null": None, "-": None, "sin_dato": None,
        "": None, "n\\a": None, "s/d": None, "a  b\t\n": "a b", "__x__y_": "x y", "\x1cz\x1f": "z",
        "ÀÉ": "àé", None: None, "nana": "nana",
    }, text.normalize_text)


DATES = {
    "2024-01-05T10:00:00": (dt.datetime(2024, 1, 5, 10), "%Y-%m-%dT%H:%M:%S"),
    "2024-01-05 10:00:01": (dt.datetime(2024, 1, 5, 10, 0, 1), "%Y-%m-%d %H:%M:%S"),
    "2024-01-05": (dt.datetime(2024, 1, 5), "%Y-%m-%d"),
    " 2024-1-5 ": (dt.datetime(2024, 1, 5), "%Y-%m-%d"),
    "05/01/2024 10:30": (dt.datetime(2024, 1, 5, 10, 30), "%d/%m/%Y %H:%M"),
    "5/1/2024": (dt.datetime(2024, 1, 5), "%d/%m/%Y"),
    "02/13/2024": (dt.datetime(2024, 2, 13), "%m/%d/%Y"),
    "05-01-2024": (dt.datetime(2024, 1, 5), "%d-%m-%Y"),
    "1-12-2020": (dt.datetime(2020, 12, 1), "%d-%m-%Y"),
    "12-1-2020": (dt.datetime(2020, 1, 12), "%d-%m-%Y"),
    "1-2-2020": (dt.datetime(2020, 2, 1), "%d-%m-%Y"),
    "1.12.2020": (dt.datetime(2020, 12, 1), "%d.%m.%Y"),
    "12.1.2020": (dt.datetime(2020, 1, 12), "%d.%m.%Y"),
    "05.01.2024": (dt.datetime(2024, 1, 5), "%d.%m.%Y"),
    "20240105": (dt.datetime(2024, 1, 5), "%Y%m%d"),
    "2024115": (dt.datetime(2024, 11, 5), "%Y%m%d"),
    "202415": (dt.datetime(2024, 1, 5), "%Y%m%d"),
    "45296": (dt.datetime(2024, 1, 5), "excel_serial"),
    "45296.25": (dt.datetime(2024, 1, 5, 6), "excel_serial"),
    "1704412800": (dt.datetime(2024, 1, 5), "unix_epoch_segundos"),
    "1704412800000": (dt.datetime(2024, 1, 5), "unix_epoch_milisegundos"),
    "-86400000000": (dt.datetime(1967, 4, 7), "unix_epoch_milisegundos"),
    "-86400000": (dt.datetime(1967, 4, 7), "unix_epoch_segundos"),
    "1e5": (dt.datetime(1970, 1, 2, 3, 46, 40), "unix_epoch_segundos"),
}


def test_parse_date(spark):
    got = run(spark, list(DATES), dates.parse_date)
    assert {k: (r["value"], r["format"]) for k, r in zip(DATES, got)} == DATES


@pytest.mark.parametrize("bad", ["2024-02-30", "30/02/2024", "abc", "", None, "1600-01-01", "2024-01-05 25:00:00",
                                 "1d", "0x10", "9999999999999999", "1", "05/01/24"])
def test_unparsed_dates(spark, bad):
    row = run(spark, [bad], dates.parse_date)[0]
    # "1" is below the serial range but within the epoch seconds.
    expected = (dt.datetime(1970, 1, 1, 0, 0, 1), "unix_epoch_segundos") if bad == "1" else (None, None)
    assert (row["value"], row["format"]) == expected


def test_whole_days_round_down(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        base = dates.ntz("2024-03-10 12:00:00")
        check(spark, {
            "2024-03-10 00:00:00": -1, "2024-03-09 12:00:00": -1, "2024-03-09 11:59:59": -2,
            "2024-03-12 12:00:00": 2, "2024-03-12 11:59:59.999999": 1, "2024-03-10 12:00:00": 0,
        }, lambda c: dates.whole_days(base, c.cast("timestamp_ntz")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_add_fractional_days(spark):
    got = run(spark, [1.5, -0.25], lambda c: dates.add_days(dates.ntz("2024-01-01 00:00:00"), c), "double")
    assert got == [dt.datetime(2024, 1, 2, 12), dt.datetime(2023, 12, 31, 18)]


def test_plausible_ranges(spark):
    as_of = dates.ntz("2024-06-01 00:00:00")
    for role, values in (
        ("birth", {"1914-06-01 00:00:00": True, "1990-01-01 00:00:00": False, "2010-01-01 00:00:00": True}),
        ("expiry", {"2033-01-01 00:00:00": False, "2035-01-01 00:00:00": True}),
        ("other", {"2024-06-01 12:00:00": False, "2024-06-03 00:00:00": True, "1899-01-01 00:00:00": True}),
    ):
        low, high = dates.plausible_range(role, as_of)
        check(spark, values, lambda c: dates.out_of_range(c.cast("timestamp_ntz"), low, high))
    assert [dates.role_of(c) for c in ("fecha_nacimiento", "Fecha_Vencimiento", "fecha")] == ["birth", "expiry", "other"]


def test_classify_prefix(spark):
    check(spark, {
        "f": "physical", "FÍSICA": "physical", " Fisica": "physical", "V": "virtual", "virtual": "virtual",
        "x": None, None: None,
    }, lambda c: text.classify_prefix(c, {"f": "physical", "v": "virtual"}))


def test_parse_boolean(spark):
    cases = {"1": True, "Sí": True, "TRUE": True, "y": True, "S": True, "0": False, "No": False, "falso": False,
             "N": False, "nan": None, "n/a": None, "2": None, "1.0": None, None: None}
    check(spark, cases, text.parse_boolean)
    lost = run(spark, list(cases), lambda c: text.boolean_unrecognised(c, text.parse_boolean(c)))
    assert [v for v, u in zip(cases, lost) if u] == ["2", "1.0"]
    check(spark, {1.0: True, 0.0: False, 2.0: None}, lambda c: text.parse_boolean(c, "double"), "double")
    check(spark, {True: True, False: False}, lambda c: text.parse_boolean(c, "boolean"), "boolean")


def test_parse_number(spark):
    check(spark, {
        "$1,234.50": 1234.5, "1.234,50": 1234.5, "1,5": 1.5, "1,234": 1234.0, "1.234": 1.234, "1.234,5": 1234.5,
        "1,234.5": 1234.5, "1,234,56": None, "-": None, "abc": None, "1e5": 15.0, "(100)": 100.0, "1.2.3": None,
        "5-": None, "-5": -5.0, ".": None, ",": None, "": None, None: None, "12 USD": 12.0, "1,234,567": 1234567.0,
    }, numbers.parse_number)


def test_ids(spark):
    check(spark, {
        "171003406-5": "1710034065", "912345678": "0912345678", "1710034065.0": "1710034065", "123": "123",
        " 1710.034 065 ": "1710034065", "012345678": "012345678", None: None,
    }, ids.format_id)
    check(spark, {
        "1710034065": True, " 1710034065 ": True, "1710034066": False, "9910034065": False, "1790034065": False,
        "171003406": False, None: False,
    }, ids.id_is_valid)


def test_strip_accents(spark):
    check(spark, {"FÍSICA ñ": "FISICA n", "ascii": "ascii", "日本a": "a"}, text.strip_accents)
    check(spark, {"ﬁ½": "fi12", "é": "e", None: None}, lambda c: text.strip_accents(c, exact=True))
