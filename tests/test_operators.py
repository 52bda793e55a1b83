from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayframe.functions import scalars as S
from stayframe.functions.time import TimeWindow
from stayframe.operators import aggregates as A
from stayframe.operators import classify as C
from stayframe.operators import frames as P
from stayframe.operators import intervals as W
from stayframe.operators import joins as J
from stayframe.operators import outcomes as Q
from stayframe.operators import summary as M

DAY = datetime(2024, 3, 1, 10, 30)


def h(hours):
    return DAY + timedelta(hours=hours)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def series(spark, data):
    return spark.createDataFrame(data, "case_id long, recordtime timestamp_ntz, value double")


def test_asof_counts_a_match_at_the_tolerance(spark):
    main, ref = series(spark, [(1, h(1), 1.0), (1, h(2.5), 2.0), (2, h(1), 3.0), (None, h(1), 4.0)]), series(spark, [(1, h(0), 10.0), (2, h(1), 20.0), (None, h(1), 5.0)])
    got = J.attach_asof_value(main, ref, "r", tolerance="1h", with_matched_time=True)
    assert [(r["value"], r["r"], r["r_recordtime"]) for r in got.orderBy("value").collect()] == [(1.0, 10.0, h(0)), (2.0, None, None), (3.0, 20.0, h(1)), (4.0, None, None)]
    ahead = J.attach_asof_value(series(spark, [(1, h(-1), 1.0)]), ref, "r", strategy="forward", tolerance=None)
    assert ahead.first()["r"] == 10.0
    near = J.attach_asof_value(series(spark, [(1, h(1), 1.0)]), series(spark, [(1, h(0), 1.0), (1, h(2), 2.0)]), "r", strategy="nearest")
    assert near.first()["r"] == 1.0  # the earlier one of two at equal distance
    with pytest.raises(ValueError):
        J.attach_asof_value(main, ref, "value")


def test_remove_asof_is_idempotent(spark):
    main, ref = series(spark, [(1, h(0), 1.0), (1, h(30), 2.0), (2, h(0), 3.0)]), series(spark, [(1, h(0.5), 0.0)])
    once = J.remove_asof(main, ref)
    assert rows(once, "value") == rows(J.remove_asof(once, ref), "value") == [(1, h(30), 2.0), (2, h(0), 3.0)]


def test_asof_has_one_exchange_on_the_key(spark, data_dir):
    from stayframe.jobs.queries import asof_backward

    plan = asof_backward(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


OBS = "icu_stay_id string, admission timestamp_ntz, discharge timestamp_ntz"


def test_features_with_missing_rows_and_open_bounds(spark):
    obs = spark.createDataFrame([("a", h(0), h(10)), ("b", h(0), None), ("c", h(0), h(1))], OBS)
    labs = spark.createDataFrame([("a", h(1), 5.0), ("a", h(2), None), ("a", h(11), 9.0), ("b", h(99), 7.0)], "icu_stay_id string, recordtime timestamp_ntz, value double")
    window = TimeWindow.between("admission", "discharge")
    specs = [A.Feature("f", "!first value", window=window), A.Feature("l", "!last value", window=window), A.Feature("n", "!count value", window=window), A.Feature("s", "!sum value", window=window), A.Feature("x", "!any value", window=window), A.Feature("m", "!last value, recordtime", window=window)]
    got = {r["icu_stay_id"]: r for r in A.static_features(labs, obs, specs, "icu_stay_id").collect()}
    assert (got["a"]["f"], got["a"]["l"], got["a"]["n"], got["a"]["s"], got["a"]["x"]) == (5.0, None, 2, 5.0, True)
    assert got["b"]["l"] == 7.0 and got["b"]["m_recordtime"] == h(99)
    assert (got["c"]["f"], got["c"]["n"], got["c"]["s"], got["c"]["x"]) == (None, None, None, False)
    strict = A.static_features(labs, obs, [A.Feature("l", "!last value", window=window, require_anchor=True)], "icu_stay_id")
    assert {r["icu_stay_id"]: r["l"] for r in strict.collect()} == {"a": None, "b": None, "c": None}


def test_interval_sum_takes_the_share_inside(spark):
    obs = spark.createDataFrame([("a", h(0), h(10)), ("b", h(0), h(10))], OBS)
    doses = spark.createDataFrame([("a", h(-5), h(5), 100.0), ("a", h(3), None, 7.0), ("a", h(4), h(1), 1.0), ("a", h(20), h(30), 50.0)], "icu_stay_id string, recordtime timestamp_ntz, recordtime_end timestamp_ntz, value double")
    spec = [A.Feature("dose", "!sum_interval value", window=TimeWindow.between("admission", "discharge"))]
    assert rows(A.static_features(doses, obs, spec, "icu_stay_id"), "icu_stay_id") == [("a", 58.0), ("b", 0.0)]


def test_selects_are_checked():
    assert A.parse_select("!perc(90) value") == A.Select("perc", ("90",), ("value",))
    assert A.parse_select("!closest(admission, 2h, 1d 2d)").arguments == ("admission", "2h", "1d 2d")
    with pytest.raises(ValueError):
        A.parse_select("!mode value")


def test_conditions(spark):
    df = spark.createDataFrame([("a,b", 1), ("abc", 2), ("xyz", 3)], "s string, n int")
    assert [r["n"] for r in df.where(P.condition("!isin(s, ['a,b', xyz])")).orderBy("n").collect()] == [1, 3]
    assert [r["n"] for r in df.where(P.condition("!endswith(s, [c, z])")).orderBy("n").collect()] == [2, 3]
    with pytest.raises(ValueError):
        P.condition("10 <= value <= 1000")


def test_frames(spark):
    df = spark.createDataFrame([(1, 5.0, "x", 2), (2, None, "y", 3), (3, 50.0, None, 4)], "k int, value double, attributes_a string, attributes_b int")
    assert [r["k"] for r in P.apply_cleaning(df, {"lactate": {"low": 1, "high": 20}}, "lactate").collect()] == [1]
    built = P.build_attributes(df)
    assert built.columns == ["k", "value", "attributes"] and P.unnest(built, "attributes", prefix="p_").columns == ["k", "value", "p_a", "p_b"]
    assert P.unify_columns(df, ["k"]).columns[:4] == ["k", "recordtime", "recordtime_end", "recordtime_relative"]
    assert [r["k"] for r in P.filter_by_condition(df, F.col("value") > 10).orderBy("k").collect()] == [1, 2]
    assert [r["k"] for r in P.filter_by_condition(df, F.col("value") > 10, "keep").collect()] == [3]
    assert rows(P.filter_by_values(df, {"attributes_a": ["x", "y"]}, rename={"value": None, "attributes_b": "b"}), "k") == [(1, "x", 2), (2, "y", 3)]


def test_scalars(spark):
    got = spark.createDataFrame([([1, 1, 2, 2, 1, None, None],)], "a array<int>").select(S.drop_consecutive_duplicates(F.col("a"))).first()[0]
    assert got == [1, 2, 1, None]
    text = spark.createDataFrame([("  Größe\n ÄRZTE ",), (None,), ("NULL",)], "t string").select(S.normalize_text(F.col("t"))).collect()
    assert [r[0] for r in text] == ["groesse aerzte", "", ""]
    codes = spark.createDataFrame([("5-01, 5-02 ,,",)], "t string").select(S.split_codes(F.col("t"))).first()[0]
    assert codes == ["5-01", "5-02"]
    rates = spark.createDataFrame([("1", " mg/kg/min"), ("48", "mg/kg/d"), ("x", "mg/kg/h"), ("3", "ml"), ("99", "mg/kg/h")], "v string, u string").select(S.rate_per_hour(F.col("v"), F.col("u"))).collect()
    assert [r[0] for r in rates] == [None, 2.0, None, None, None]


def test_merging(spark):
    ep = spark.createDataFrame([(1, h(0), h(10)), (1, h(1), h(2)), (1, h(11), h(12)), (1, h(20), h(21)), (1, None, h(3)), (2, h(0), h(1))], "k int, recordtime timestamp_ntz, recordtime_end timestamp_ntz")
    assert rows(W.merge_episodes(ep, "k", "recordtime", "recordtime_end", "1h"), "k", "recordtime") == [(1, h(0), h(12)), (1, h(20), h(21)), (2, h(0), h(1))]
    nested = ep.where("k = 1 AND recordtime IS NOT NULL")
    by_previous = W.merge_consecutive_stays(nested, "k", "recordtime", "recordtime_end", hours=5)
    by_furthest = W.merge_consecutive_stays(nested, "k", "recordtime", "recordtime_end", hours=5, reference="furthest")
    assert by_previous.count() == 3 and by_furthest.count() == 2


def test_rate_filter_compares_with_the_last_kept_point(spark):
    s = series(spark, [(1, h(0), 10.0), (1, h(1), 100.0), (1, h(2), 12.0), (1, h(2), 13.0), (2, h(0), 1.0)])
    assert rows(W.rate_of_change_filter(s, "case_id", "recordtime", "value", 5.0), "case_id", "recordtime") == [(1, h(0), 10.0, None), (1, h(2), 12.0, 1.0), (2, h(0), 1.0, None)]


def test_buckets_keep_the_sum(spark):
    s = spark.createDataFrame([(1, h(0), h(3), 30.0), (1, h(0.5), h(1), 5.0), (1, h(1), h(1), 9.0)], "k int, recordtime timestamp_ntz, recordtime_end timestamp_ntz, value double")
    got = W.interval_bucket(s, "k", every="1h").collect()
    assert sum(r["value"] for r in got) == pytest.approx(35.0) and len(got) == 4
    assert W.interval_bucket(s, "k").first()["value"] == pytest.approx(35.0)
    imputed = W.interval_bucket(s, "k", empty_length="30m").first()["value"]
    assert imputed == pytest.approx(44.0)


FOLLOW = "k int, t0 timestamp_ntz, death timestamp_ntz, censor timestamp_ntz"


def days(spark, spans, death=None, censor=None, **options):
    obs = spark.createDataFrame([(1, DAY, death, censor)], FOLLOW)
    ep = spark.createDataFrame([(1, h(24 * a), h(24 * b)) for a, b in spans], "k int, recordtime timestamp_ntz, recordtime_end timestamp_ntz")
    return Q.free_days(obs, ep, "k", TimeWindow.after("t0", "28d"), death="death", censor="censor", **options).first()["free_days"]


def test_free_days(spark):
    assert days(spark, []) == 28
    assert days(spark, [(0, 5)]) == 23 and days(spark, [(0, 5.5)]) == 22
    assert days(spark, [(0, 2), (10, 12)]) == 16 and days(spark, [(0, 2), (10, 12)], method="day_grid") == 24
    assert days(spark, [(0, 2), (10, 12)], method="day_grid", recovery="24h") == 22
    assert days(spark, [(0, 40)]) == 0 and days(spark, [(-9, -1)]) == 28 and days(spark, [(30, 40)]) == 28
    assert days(spark, [(0, 5)], death=h(24 * 9)) == 0 and days(spark, [(0, 5)], death=h(24 * 9), death_rule="negative_if_death") == -1
    assert days(spark, [(0, 5)], death=h(24 * 9), death_rule="alive_days") == 4
    assert days(spark, [(0, 5)], death=h(24 * 9), censor=h(24 * 20)) is None
    assert days(spark, [(20, 26), (27, 40)], merge_gap="2d") == 0 and days(spark, [(0, 1), (2, 3)], method="day_grid", merge_gap="48h") == 25


def test_free_days_of_an_empty_horizon(spark):
    obs = spark.createDataFrame([(1, DAY)], "k int, t0 timestamp_ntz")
    ep = spark.createDataFrame([], "k int, recordtime timestamp_ntz, recordtime_end timestamp_ntz")
    assert Q.free_days(obs, ep, "k", TimeWindow.between("t0", "t0")).first()["free_days"] == 0


def test_hierarchy_needs_the_child_but_not_its_value(spark):
    nodes = spark.createDataFrame([(1, None, "P", "r"), (2, 1, "P_a", None), (3, None, "P", "r"), (4, 3, "P_b", "x"), (5, 1, "P_b", "1"), (6, 1, "P_b", "2")], "id int, parent_id int, name string, value string")
    assert rows(J.pivot_hierarchy(nodes, "P", ["_a"], ["_b"]), "id") == [(1, None, "2")]


def test_rules_in_order(spark):
    df = spark.createDataFrame([("Tube, oral", True), ("tube", None), ("mask", False), (None, None)], "t string, f boolean")
    rules = [C.Rule("oral", "tube", "high", {"t": "oral"}, subtype="oral"), C.Rule("flag", "flagged", "low", {"t": "."}, {"f": False}), C.Rule("any", "tube", "low", {"t": "tube"})]
    assert [(r["class"], r["rule"]) for r in C.classify_by_rules(df, rules, ["t"], ["f"]).orderBy(F.desc_nulls_last("t")).collect()] == [("tube", "any"), ("flagged", "flag"), ("tube", "oral"), ("unknown", None)]


def test_table_one_text(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, False), ("b", None, None)], "g string, x double, y boolean")
    t = {(r["variable"], r["level"], r["grp"]): r["text"] for r in M.table_one(df, "g").collect()}
    assert t[("x", "", "a")] == "2.0 [1.5, 2.5]" and t[("y", "Yes", "a")] == "1 (50.0)" and t[("x", "Missing", "b")] == "1" and t[("y", "Missing", "Overall")] == "1"
    for kind in ("markdown", "html", "latex"):
        assert "Overall" in M.render(M.table_one(df, "g"), kind)


@pytest.mark.parametrize("strategy", ["backward", "forward", "nearest"])
def test_slices_change_nothing(spark, strategy):
    import random

    rng = random.Random(7)
    make = lambda n: [(rng.randrange(3), h(rng.randrange(-400, 400) / 4), float(i)) for i in range(n)]
    main, ref = series(spark, make(120)), series(spark, make(60))
    whole = J.attach_asof_value(main, ref, "r", strategy=strategy, tolerance=None, tiebreak="value")
    dealt = J.attach_asof_value(main, ref, "r", strategy=strategy, tolerance=None, tiebreak="value", slices="6h")
    assert rows(whole, "value") == rows(dealt, "value")


def test_lookup_by_prefix(spark, tmp_path):
    from stayframe.sources.datasets import read_mapping_csv

    (tmp_path / "m.csv").write_text("code,state\n01,S\n01,B\n10,B\n01,S\n")
    mapping = read_mapping_csv(spark, str(tmp_path / "m.csv"), "code", "state")
    df = spark.createDataFrame([("01067",), ("10115",), ("99999",), (None,)], "postcode string")
    assert rows(J.map_prefix(df, "postcode", mapping, 2, "states"), "postcode") == [(None, None), ("01067", ["B", "S"]), ("10115", ["B"]), ("99999", None)]


def test_status_rules(spark):
    now = F.lit(h(0)).cast("timestamp_ntz")
    cases = [(h(5), h(1)), (None, None), (h(5), None), (h(-24 * 10), None), (h(-24 * 100), None), (h(-9), h(-1)), (h(-9), h(9)), (h(2), h(9)), (None, h(2))]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, b timestamp_ntz, e timestamp_ntz").orderBy("i").select(S.stay_status(F.col("b"), F.col("e"), now)).collect()
    assert [r[0] for r in got] == ["Implausible", "Incomplete", "Planned", "Ongoing", "Incomplete", "Finalised", "Ongoing", "Planned", "Incomplete"]


def test_casts_in_fragments_are_tolerant(spark):
    df = spark.createDataFrame([("<5", "a"), ("7", "cast(x")], "v string, k string")
    assert P.tolerant("CAST (v AS int) + `cast(y)` + 'CAST(' || cast(k as int)") == "TRY_CAST (v AS int) + `cast(y)` + 'CAST(' || TRY_CAST(k as int)"
    got = P.select_sql(df, {"n": "CAST(v AS DOUBLE)", "k": "k"}, "k <> 'CAST(no)'").orderBy("k").collect()
    assert [(r["n"], r["k"]) for r in got] == [(None, "a"), (7.0, "cast(x")]
    assert [r["v"] for r in P.in_order(df, ["k"]).collect()] == ["<5", "7"]


def test_rules_need_no_shuffle(spark):
    df = spark.createDataFrame([("tube", 1)], "t string, class int")
    out = C.classify_by_rules(df, [C.Rule("any", "tube", "low", {"t": "tube"})], ["t"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.first()["class"] == "tube"


def test_exact_percentiles_of_spread_values(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=5000), "b": rng.integers(0, 3, 4000).astype(float), None: np.array([4.0]), "e": np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("none", None)]
    points = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r["k"]: r["cuts"] for r in M.exact_percentiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", points).collect()}
    assert set(got) == {*data, "none"} and got["none"] is None
    for k, v in data.items():
        assert got[k] == pytest.approx(np.quantile(v, points).tolist())


def test_plausible_changes_of_a_long_series(spark):
    """Against a loop, over several Arrow batches, with null keys and values."""
    import random

    r = random.Random(2)
    t0 = datetime(2024, 1, 1)
    rows = [(k, t0 + timedelta(minutes=r.randrange(0, 20_000)), i, None if r.random() < 0.02 else float(r.randrange(0, 30))) for k in (1, 2, None) for i in range(15_000 if k == 1 else 40)]
    df = spark.createDataFrame(rows, "key long, at timestamp_ntz, seq long, v double")
    want = []
    for k in (1, 2, None):
        last = None
        for _, at, i, v in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2])):
            if last is None or (v is not None and last[1] is not None and at > last[0] and abs((v - last[1]) / ((at - last[0]).total_seconds() / 3600)) < 5.0):
                want.append((k, i))
                last = (at, v)
    got = [(x["key"], x["seq"]) for x in W.rate_of_change_filter(df, "key", "at", "v", 5.0, tiebreak="seq").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
