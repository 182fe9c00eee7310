from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from viewgrain.functions import dates, logic, numbers
from viewgrain.functions import strings as s
from viewgrain.functions.parameters import Parameter, arguments


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


def day(text):
    return F.lit(dt.date.fromisoformat(text))


@pytest.mark.parametrize(
    ("part", "a", "b", "want"),
    [
        ("month", "2024-01-31", "2024-02-01", 1),
        ("month", "2024-02-01", "2024-01-31", -1),
        ("year", "2023-12-31", "2024-01-01", 1),
        ("quarter", "2024-03-31", "2024-04-01", 1),
        ("week", "2024-01-07", "2024-01-08", 1),
        ("week", "2024-01-08", "2024-01-14", 0),
        ("day", "2024-02-28", "2024-03-01", 2),
    ],
)
def test_date_diff_counts_boundaries(value, part, a, b, want):
    assert value(dates.date_diff(part, day(a), day(b))) == want


def test_date_add_clips_month_ends_and_keeps_the_type(value):
    assert value(dates.date_add("month", 1, day("2024-01-31"))) == dt.date(2024, 2, 29)
    assert value(dates.date_add("year", -1, day("2024-02-29"))) == dt.date(2023, 2, 28)
    noon = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert value(dates.date_add("hour", 13, noon)) == dt.datetime(2024, 1, 2, 1)


def test_date_parts(value):
    assert value(dates.date_part("weekday", day("2024-01-07"))) == 1
    assert value(dates.date_part("isoyear", day("2021-01-01"))) == 2020
    assert value(dates.date_part("isoquarter", day("2021-01-01"))) == 4
    assert value(dates.date_name("weekday", day("2024-01-07"))) == "Sunday"
    assert value(dates.date_name("quarter", day("2024-05-07"))) == "2"
    assert value(dates.date_trunc("year", day("2024-05-07"))) == 2024


def test_is_date_and_make(value):
    assert value(dates.is_date(F.lit("2004-04-15"))) and not value(dates.is_date(F.lit("soon")))
    assert value(dates.make_time(F.lit(14), F.lit(3), F.lit(0))) == "14:03:00"
    made = dates.make_datetime(day("2024-01-02"), F.lit("03:04:05"))
    assert value(made) == dt.datetime(2024, 1, 2, 3, 4, 5)


@pytest.mark.parametrize(
    ("text", "sub", "n", "want"),
    [("a-b-c", "-", 2, 4), ("a-b-c", "-", 3, 0), ("aaa", "aa", 1, 1), ("x.y.z", ".", 1, 2), ("", "-", 1, 0), ("a\\Eb\\Ec", "\\E", 2, 5)],
)
def test_find_nth(value, text, sub, n, want):
    assert value(s.find_nth(F.lit(text), sub, n)) == want


def test_strings(value):
    assert value(s.find(F.lit("abcabc"), "b", 3)) == 5
    assert value(s.split_token(F.lit("a-b-c"), "-", -1)) == "c"
    assert value(s.mid(F.lit("abcdef"), 3)) == "cdef"
    assert value(F.length(s.space(3))) == 3
    assert value(s.join_text(F.lit("a"), F.lit(None).cast("string"))) is None


def test_conversion_and_division(value):
    assert value(logic.to_int(F.lit(-3.7))) == -3
    assert value(logic.to_int(F.lit("3.7"))) == 3
    assert value(logic.to_int(F.lit("x"))) is None
    assert value(logic.safe_div(F.lit(1), F.lit(0))) is None
    assert value(logic.safe_div(F.lit(1), F.lit(4))) == 0.25
    assert value(logic.zn(F.lit(None).cast("int"))) == 0
    null = F.lit(None).cast("boolean")
    assert value(logic.iif(null, F.lit("y"), F.lit("n"))) == "n"
    assert value(logic.iif(null, F.lit("y"), F.lit("n"), F.lit("?"))) == "?"


def test_bins_floor_negative_values(value):
    assert value(numbers.bin_numeric(F.lit(-0.5), 10)) == -10
    assert value(numbers.bin_numeric(F.lit(25.0), 10)) == 20


def test_hexbin_gives_the_nearest_centre(spark):
    centres = [
        (i * 3**0.5 + shift * 3**0.5 / 2, 3 * j + shift * 1.5)
        for i in range(-4, 8) for j in range(-4, 8) for shift in (0, 1)
    ]
    points = [(x * 0.37, y * 0.53) for x in range(-10, 12) for y in range(-8, 9)]
    hx, hy = numbers.hexbin(F.col("x"), F.col("y"))
    for r in spark.createDataFrame(points, "x double, y double").withColumns({"hx": hx, "hy": hy}).collect():
        least = min((r.x - a) ** 2 + (r.y - b) ** 2 for a, b in centres)
        assert (r.x - r.hx) ** 2 + (r.y - r.hy) ** 2 == pytest.approx(least, abs=1e-9)


def test_parameters():
    p = Parameter("rate", 0.1, low=0.0, high=1.0, step=0.05)
    assert arguments([p], {}) == {"rate": 0.1} and arguments([p], {"rate": 0.25}) == {"rate": 0.25}
    for bad in (-0.1, 1.05, 0.07):
        with pytest.raises(ValueError):
            p.check(bad)
    with pytest.raises(ValueError):
        Parameter("k", "a", allowed=["a", "b"]).check("c")
