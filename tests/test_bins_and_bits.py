"""Interval joins in bins of time and free days in words of bits, against plain Python."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayframe.functions.time import RELATIONS, TimeWindow
from stayframe.operators import aggregates as A
from stayframe.operators import joins as J
from stayframe.operators import outcomes as Q
from stayframe.operators import summary as M

T0 = datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("relations", [None, ("CONTAINED",), ("OVERLAPS_LEFT", "COVERS_WINDOW"), ("OVERLAPS_RIGHT",)])
def test_interval_join_equals_all_pairs(spark, relations):
    rng = random.Random(6)

    def span(odd):
        start = T0 + timedelta(seconds=rng.randrange(90 * 86400))
        end = start + timedelta(seconds=rng.choice([0, 1, 59, 60, 61, 4000, 86400, 9_000_000, -3600]))
        return (start if rng.random() > odd else None, end if rng.random() > odd else None)

    a = spark.createDataFrame([(i, rng.choice([1, 1, 2, None]), *span(0.1)) for i in range(250)], "a long, k long, recordtime timestamp_ntz, recordtime_end timestamp_ntz")
    b = spark.createDataFrame([(i, rng.choice([1, 1, 2, None]), *span(0.15)) for i in range(120)], "b long, k long, tmin timestamp_ntz, tmax timestamp_ntz")
    found, plain = J.interval_join(a, b, "k", relations=relations), J.interval_join(a, b, "k", relations=relations, unit=None)
    assert found.columns == plain.columns and rows_of(found) == rows_of(plain) and found.count() > 0
    assert set(RELATIONS) >= set(relations or ())
    for left, right in ((a.limit(0), b), (a, b.limit(0))):
        assert J.interval_join(left, right, "k").collect() == []


def test_a_key_with_many_of_both_forms_no_product(spark):
    """20,000 intervals and 2,000 windows of one key, of which each window meets 10: 40 million pairs, of which few are looked at."""
    minute = lambda c: F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), c.cast("int"))
    a = spark.range(20_000).select(F.lit(1).alias("k"), "id", minute(F.col("id") * 2).alias("recordtime"), minute(F.col("id") * 2 + 1).alias("recordtime_end"))
    b = spark.range(2_000).select(F.lit(1).alias("k"), F.col("id").alias("w"), minute(F.col("id") * 20).alias("tmin"), minute(F.col("id") * 20 + 19).alias("tmax"))
    found = J.interval_join(a, b, "k")
    assert found.count() == 20_000
    looked = J._binned(a.withColumns(J._span(F.col("recordtime"), F.col("recordtime_end"), 60_000_000)), [5], 60_000_000)
    assert looked.count() <= 3 * 20_000 + 2_000 and looked.groupBy("__at", "__bin").count().agg(F.max("count")).first()[0] <= 20


@pytest.mark.parametrize("method", ["last_event", "day_grid"])
@pytest.mark.parametrize("rule", ["zero_if_dead", "alive_days"])
@pytest.mark.parametrize("with_presence", [False, True])
def test_free_days_of_long_horizons(spark, method, rule, with_presence):
    rng, days = random.Random(9), 150
    hour = lambda h: T0 + timedelta(hours=h)
    obs = [(i, T0, hour(24 * days), hour(rng.randrange(24 * 200)) if i % 3 == 0 else None) for i in range(12)]
    spans = lambda n, longest: [(i, s := rng.randrange(-100, 24 * 160), s + rng.choice([0, 1, 24, 48, longest])) for i in range(11) for _ in range(rng.randrange(n))]
    events, seen = spans(40, 90), spans(12, 1700)
    frame = lambda rows: spark.createDataFrame([(i, hour(a), hour(b)) for i, a, b in rows], "k long, recordtime timestamp_ntz, recordtime_end timestamp_ntz")
    df = spark.createDataFrame(obs, "k long, t0 timestamp_ntz, t1 timestamp_ntz, death timestamp_ntz")
    found = Q.free_days(df, frame(events), "k", TimeWindow.between("t0", "t1"), method=method, death_rule=rule, death="death", presence=frame(seen) if with_presence else None, with_detail=True, recovery="30h")
    wait = 30 if method == "day_grid" else 0
    for r in found.collect():
        i, _, _, death = obs[r["k"]]
        met = [(a, min(b, 24 * days)) for k, a, b in events if k == i and b > 0 and a < 24 * days]
        there = [(a, min(b, 24 * days)) for k, a, b in seen if k == i and b > 0 and a < 24 * days]
        free, unseen = 0, 0
        for day in range(days):
            blocked = any((method == "last_event" or a < 24 * day + 24) and b > 24 * day - wait for a, b in met)
            alive = rule != "alive_days" or death is None or death >= hour(24 * day + 24)
            observed = not with_presence or any(a < 24 * day + 24 and b > 24 * day for a, b in there)
            free += not blocked and alive and observed
            unseen += not blocked and alive and not observed
        dead = rule == "zero_if_dead" and death is not None and death <= hour(24 * days)
        assert r["free_days"] == (0 if dead else free)
        assert (r["free_days_detail"]["n_episodes"], r["free_days_detail"]["unobserved_days"]) == (len(met), unseen)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_are_exact_in_two_scans(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = {"many": rng.normal(size=30_000), "ties": np.repeat([1.0, 2.0, 7.0], [20_000, 5_000, 9_000]), "thousand": rng.random(1000), "next": rng.random(1001), "two": np.array([3.0, 9.0])}
    spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k string, x double").repartition(7).write.parquet(str(tmp_path / "x"))
    points = (0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0)
    found = M.exact_percentiles(spark.read.parquet(str(tmp_path / "x")), ["k"], "x", points, also={"mean": F.avg("v")})
    got = {r["k"]: r for r in found.collect()}
    for k, v in data.items():
        assert got[k]["cuts"] == pytest.approx(np.quantile(v, points).tolist()) and got[k]["mean"] == pytest.approx(v.mean())


def test_spread_percentiles_of_a_hot_key_equal_gathered_ones(spark):
    """A key with a third of the rows and more values than a sketch holds; ties, nulls, NaN, whole numbers, windows and rules of their own."""
    obs = spark.sql("SELECT id AS case_id, TIMESTAMP_NTZ '2024-03-01 00:00:00' AS t0 FROM range(9)")
    base = spark.range(12_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 7 + 1 END AS case_id", "TIMESTAMP_NTZ '2024-03-01 00:00:00' + make_dt_interval(0, 0, id % 3000) AS recordtime",
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 997 = 0 THEN double('NaN') ELSE pmod(hash(id), 5000) / 7 END AS value", "CAST(pmod(hash(id, 1), 40) AS int) AS whole",
    )
    window = TimeWindow.after("t0", "20h")
    wanted = [("mid", "!median value", None), ("low", "!perc(5) value", "value > 40"), ("p", "!perc(90) value, whole", None), ("top", "!perc(100) whole", None), ("rows", "!count value", None), ("half", "!perc(50) value", "whole = 3")]
    features = [A.Feature(name, select, where, window if name != "top" else TimeWindow()) for name, select, where in wanted]
    plain = A.static_features(base, obs, features, "case_id")
    spread = A.static_features(base, obs, features, "case_id", spread=True)
    assert spread.dtypes == plain.select(*spread.columns).dtypes
    shown = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.select(*spread.columns).collect())
    assert shown(spread) == shown(plain) and spread.count() == 9
    only = A.static_features(base, obs, features[:1], "case_id", spread=True)
    assert only.columns == ["case_id", "mid"] and only.where("mid IS NULL").count() == 2  # 0 and 8 have no rows
    assert "collect_list" not in spread._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError, match="numbers"):
        A.static_features(base.withColumn("value", F.lit("x")), obs, features[:1], "case_id", spread=True)
