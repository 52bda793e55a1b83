"""Scans in slices of time give what scans of whole keys give, and no task needs a whole key."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayframe.operators import intervals as W

T0 = datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def stays(spark):
    """Key 1 holds half of the rows; times tie, some are null, ends are missing or before their start."""
    rng, rows = random.Random(3), []
    for i in range(600):
        key = 1 if i % 2 else rng.choice([2, 3, 4, None])
        start = T0 + timedelta(hours=rng.randrange(24 * 60)) if rng.random() > 0.03 else None
        end = start + timedelta(hours=rng.choice([-2, 0, 1, 5, 30, 400])) if start and rng.random() > 0.05 else None
        rows.append((i, key, start, end, rng.choice("ab"), float(rng.randrange(100)) if rng.random() > 0.05 else None))
    return spark.createDataFrame(rows, "id long, k long, s timestamp_ntz, e timestamp_ntz, ward string, v double").cache()


SCANS = {
    "episodes": lambda df, n: W.merge_episodes(df, "k", "s", "e", "2h", slices=n),
    "stays": lambda df, n: W.merge_consecutive_stays(df, "k", "s", "e", hours=6, ward="ward", status="ward", lists=["id"], tiebreak=["id"], slices=n),
    "stays by furthest end": lambda df, n: W.merge_consecutive_stays(df, "k", "s", "e", hours=6, ward="ward", lists=["id"], tiebreak=["id"], reference="furthest", slices=n),
    "sessions": lambda df, n: W.merge_sessions(df, "k", "s", "e", "v", gap="3h", tiebreak=["id"], slices=n),
    "ids": lambda df, n: W.sequential_id(df, "k", ["s", "id"], "name", slices=n),
    "ends": lambda df, n: W.impute_end(df, "k", "s", "e", tiebreak=["id"], max_gap="9h", beyond="cap", slices=n),
    "blocks": lambda df, n: W.change_blocks(df, "k", "ward", ["s", "id"], slices=n),
    "rolling": lambda df, n: W.rolling_mean(df, "k", "s", "v", length="1d", slices=n).withColumn("rolling", F.round("rolling", 9)),
}


@pytest.mark.parametrize("length", ["2d"])
@pytest.mark.parametrize("name", sorted(SCANS))
def test_slices_change_nothing(name, length, stays):
    assert rows_of(SCANS[name](stays, length)) == rows_of(SCANS[name](stays, None))
    assert SCANS[name](stays, length).columns == SCANS[name](stays, None).columns
    assert rows_of(SCANS[name](stays.limit(0), length)) == []


@pytest.mark.parametrize("name", sorted(SCANS))
def test_only_one_row_a_slice_is_scanned_by_key(name, stays):
    """A window by key alone stands above an aggregate by key and slice, never above the rows."""
    plan = SCANS[name](stays, "1d")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    by_key = [i for i, line in enumerate(plan) if "Window [" in line and "__of" in line]
    assert all(any("Aggregate [" in x for x in plan[i : i + 4]) for i in by_key)
    by_rows = [line for line in plan if "Window [" in line and "__of" not in line]
    assert by_rows and all("__slice" in line.rsplit("], [", 2)[-2] for line in by_rows)


def test_slices_no_shorter_than_the_rolling_interval(stays):
    with pytest.raises(ValueError):
        W.rolling_mean(stays, "k", "s", "v", length="2d", slices="1d")


def plain_filter(rows, limit):
    """rows: (key, micros, tiebreak, value) in order."""
    last, out = {}, []
    for k, us, tie, v in rows:
        if k not in last:
            last[k] = (us, v)
            out.append((k, tie, None))
            continue
        us0, v0 = last[k]
        if None in (us, us0, v, v0) or us <= us0:
            continue
        rate = (v - v0) / ((us - us0) / 3_600_000_000)
        if not math.isnan(rate) and abs(rate) < limit:
            last[k] = (us, v)
            out.append((k, tie, round(rate, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("piece", "slices"), [(16, "1h"), (256, "5d")])
def test_rate_of_change_equals_a_plain_loop(spark, piece, slices):
    rng, rows = random.Random(8), []
    for i in range(500):
        k = 1 if i % 3 == 0 else rng.choice([2, 3, 4, None])
        t = T0 + timedelta(minutes=30 * rng.randrange(200)) if rng.random() > 0.02 or k == 1 else None
        v = rng.choice([float(rng.randrange(40)), float(rng.randrange(40)), None, float("nan"), float("inf")] if k != 1 else [float(rng.randrange(12))] * 5 + [900.0])
        rows.append((k, t, i, v))
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, id long, v double")
    order = lambda r: (r[1] is not None, r[1] or T0, r[2])
    plain = [(k, (t - T0) // timedelta(microseconds=1) if t else None, i, v) for k, t, i, v in sorted(rows, key=order)]
    found = W.rate_of_change_filter(df, "k", "t", "v", 8.0, tiebreak="id", piece=piece, slices=slices)
    assert found.columns == ["k", "t", "id", "v", "rate"]
    assert sorted(((r["k"], r["id"], r["rate"] if r["rate"] is None else round(r["rate"], 6)) for r in found.collect()), key=repr) == plain_filter(plain, 8.0)
    assert W.rate_of_change_filter(df.limit(0), "k", "t", "v", 8.0).collect() == []


def test_a_chain_of_pieces_that_depend_on_each_other(spark):
    """Every other point is too far from the one kept before it, so each piece's folds differ until the one before it is settled."""
    rows = [(1, T0 + timedelta(hours=i), i, float(100 * (i % 2))) for i in range(12)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, id long, v double")
    found = W.rate_of_change_filter(df, "k", "t", "v", 30.0, tiebreak="id", piece=3)
    plain = plain_filter([(k, i * 3_600_000_000, i, v) for k, _, i, v in rows], 30.0)
    assert sorted(((r["k"], r["id"], r["rate"] if r["rate"] is None else round(r["rate"], 6)) for r in found.collect()), key=repr) == plain


def test_buckets_without_a_limit(spark, monkeypatch):
    monkeypatch.setattr(W, "MAX_BUCKETS", 50)
    df = spark.createDataFrame([(1, T0, T0 + timedelta(days=400), 400.0), (2, T0, T0 + timedelta(days=50), 50.0)], "k long, recordtime timestamp_ntz, recordtime_end timestamp_ntz, value double")
    got = {r["k"]: (r["n"], round(r["v"], 6)) for r in W.interval_bucket(df, "k", every="1d", most=None).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).collect()}
    assert got == {1: (400, 400.0), 2: (50, 50.0)}
    with pytest.raises(Exception, match="too many buckets"):
        W.interval_bucket(df, "k", every="1d", most=100).collect()


def test_bounds_that_are_missing_may_stay_open(spark):
    df = spark.createDataFrame([(1, T0, T0 + timedelta(days=2), 2.0, None, T0 + timedelta(days=1)), (2, T0, T0 + timedelta(days=2), 2.0, None, None)], "k long, recordtime timestamp_ntz, recordtime_end timestamp_ntz, value double, lo timestamp_ntz, hi timestamp_ntz")
    value = lambda missing: {r["k"]: r["value"] for r in W.interval_bucket(df, "k", tmin="lo", tmax="hi", missing=missing).collect()}
    assert value("keep") == {1: 1.0, 2: 2.0} and value("drop") == {}
