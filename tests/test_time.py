from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayframe.functions import time as T
from stayframe.levels import level_named


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_offsets_are_parsed():
    assert T.parse_offset("3d12h") == (0, 84 * 3600 * 10**6)
    assert T.parse_offset("-2h") == (0, -7200 * 10**6)
    assert T.parse_offset("+1mo2q1y") == (19, 0)
    assert T.parse_offset(timedelta(minutes=5)) == (0, 300 * 10**6)
    for bad in ("", "3", "3 d", "d3", "3x"):
        with pytest.raises(ValueError):
            T.parse_offset(bad)
    with pytest.raises(ValueError):
        T.fixed_micros("1mo")


def test_offsets_follow_the_calendar(spark):
    got = one(spark, T.offset(at("2024-01-31 08:00:00"), "1mo"), T.offset(at("2024-03-01 00:00:00"), "-1d", "-500ms"), T.offset(F.lit(None).cast("timestamp_ntz"), "1d"))
    assert got == (datetime(2024, 2, 29, 8), datetime(2024, 2, 28, 23, 59, 59, 500000), None)


def test_days_may_begin_in_the_morning(spark):
    assert one(spark, T.truncate_to_day(at("2024-05-02 05:59:00"), "6h"), T.truncate_to_day(at("2024-05-02 06:00:00"), "6h")) == (datetime(2024, 5, 1, 6), datetime(2024, 5, 2, 6))


def test_differences_are_signed_and_rounded_down(spark):
    a, b = at("2024-01-01 00:00:00"), at("2024-01-01 01:30:30")
    assert one(spark, T.time_difference(b, a, "m"), T.time_difference(a, b, "m"), T.time_difference(a, b, "h", whole=False)) == (90, -91, pytest.approx(-1.5083333))


@pytest.mark.parametrize(("closed", "low", "high"), [("both", True, True), ("left", True, False), ("right", False, True), ("none", False, False)])
def test_window_bounds(spark, closed, low, high):
    a, b = at("2024-01-01 00:00:00"), at("2024-01-02 00:00:00")
    assert one(spark, T.contains(a, a, b, closed), T.contains(b, a, b, closed)) == (low, high)


def test_null_bounds_are_open(spark):
    none, t = F.lit(None).cast("timestamp_ntz"), at("2024-01-01 00:00:00")
    assert one(spark, T.contains(t, none, none), T.contains(none, t, t), T.relation(t, t, none, none)) == (True, None, "CONTAINED")


def test_windows_know_their_columns():
    w = T.TimeWindow.between(("admission", "-2h"), "discharge").widened("-1h", "1h")
    assert w.needs() == {"admission", "discharge"} and w.fits(["admission", "discharge"]) and not w.fits(["admission"])
    assert w.t_min.offsets == ("-2h", "-1h")


def test_timestamps_are_parsed_or_null(spark):
    got = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02",), ("soon",), (None,)], "t string").select(T.parse_timestamp(F.col("t"))).collect()
    assert [r[0] for r in got] == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2), None, None]


def test_clipping_keeps_nulls(spark):
    df = spark.createDataFrame([(date(1000, 1, 1), "x"), (None, "y")], "d date, s string")
    assert [r["d"] for r in T.clip_timestamps(df).orderBy("s").collect()] == [date(1677, 9, 22), None]


def test_levels_by_name():
    assert level_named("ICU").key == "icu_stay_id" and level_named("hospital_stay").t_min == "hospital_admission" and level_named("procedure").outcome == "hospital_discharge"
    with pytest.raises(ValueError):
        level_named("ward")
