"""Saved cohorts, planned variables and tolerant SQL."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stayframe.functions.time import TimeWindow
from stayframe.jobs import cohort as cohorts
from stayframe.jobs import store
from stayframe.jobs.cohort import Cohort, DynamicSpec, Requirement
from stayframe.levels import ObsLevel
from stayframe.operators import frames, joins
from stayframe.operators.aggregates import Feature
from stayframe.operators.summary import composition_change, reason_overlaps
from stayframe.sources import datasets

T0 = datetime(2024, 1, 1)
COLUMNS = {"case_id": "case", "recordtime": "at", "value": "v"}


def day(n):
    return T0 + timedelta(days=n)


@pytest.fixture
def cohort(spark):
    rows = [(f"c{i}", day(i), day(i + 5), 15 + i, "a" if i % 2 else "b") for i in range(10)]
    return Cohort(spark.createDataFrame(rows, "case_id string, hospital_admission timestamp_ntz, hospital_discharge timestamp_ntz, age int, data_source string"), "hospital_stay")


@pytest.fixture
def labs(spark):
    return spark.createDataFrame([(f"c{i}", day(i + k), float(i * k)) for i in range(10) for k in range(8)], "case string, at timestamp_ntz, v double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_save_into_the_folder_that_was_loaded(cohort, labs, tmp_path, spark):
    folder = str(tmp_path / "c")
    whole = cohort.add_series(labs, DynamicSpec("lab", COLUMNS))
    assert whole.save(folder) == 1
    smaller = Cohort.load(spark, folder).include("age", ">= 18")
    assert smaller.save(folder) == 2
    assert Cohort.load(spark, folder).obs.count() == 7 and rows(Cohort.load(spark, folder).series["lab"]) == rows(whole.series["lab"])
    first = Cohort.load(spark, folder, 1)
    assert first.obs.count() == 10 and first.log == [] and len(Cohort.load(spark, folder).log) == 1
    assert smaller.obs.count() == 7  # still reads the first generation
    assert store.forget_older(spark, folder) == [1] and Cohort.load(spark, folder).obs.count() == 7
    with pytest.raises(FileNotFoundError):
        Cohort.load(spark, folder, 1)
    assert len(list(Path(folder, "generations").iterdir())) == 1


def test_a_save_that_dies_leaves_the_old_cohort(cohort, labs, tmp_path, spark, monkeypatch):
    folder = str(tmp_path / "c")
    cohort.add_series(labs, DynamicSpec("lab", COLUMNS)).save(folder)
    fails = labs.select(F.col("case").alias("case_id"), F.when(F.col("v") > 50, F.raise_error(F.lit("lost"))).otherwise(1).alias("value"))
    with pytest.raises(Exception, match="lost"):
        cohort._with(series={"bad": fails}).include("age", ">= 20").save(folder)
    assert Cohort.load(spark, folder).obs.count() == 10
    # nor does one that dies while its record is being written
    part = Path(folder, "commits", "commit=2")
    part.mkdir()
    (part / "part-0.txt").write_text('{"record": "{\\"tab')
    assert Cohort.load(spark, folder).obs.count() == 10
    assert cohort.include("age", ">= 20").save(str(tmp_path / "other")) == 1


def test_two_saves_of_one_number_don_t_mix(cohort, tmp_path, spark, monkeypatch):
    folder = str(tmp_path / "c")
    cohort.save(folder)
    monkeypatch.setattr(store, "commits", lambda spark, folder: {})  # as if both had looked at the same time
    with pytest.raises(Exception, match="(?i)exists"):
        cohort.include("age", ">= 20").save(folder)
    monkeypatch.undo()
    assert Cohort.load(spark, folder).obs.count() == 10


def test_damage_is_found(cohort, labs, tmp_path, spark):
    folder = str(tmp_path / "c")
    cohort.add_series(labs, DynamicSpec("lab / one", COLUMNS)).save(folder)
    assert list(Cohort.load(spark, folder).series) == ["lab / one"]
    obs = next(Path(folder, "generations").glob("*/obs"))
    spark.read.parquet(str(obs)).withColumn("case_id", F.regexp_replace("case_id", "c0", "x0")).write.parquet(str(tmp_path / "changed"))
    for file in obs.glob("*"):
        file.unlink()
    for crc in obs.glob(".*"):
        crc.unlink()
    for file in (tmp_path / "changed").glob("part-*"):
        file.rename(obs / file.name)
    with pytest.raises(store.DamagedCohort, match="obs has 10 rows"):
        Cohort.load(spark, folder)
    assert Cohort.load(spark, folder, verify=False).obs.count() == 10
    with pytest.raises(FileNotFoundError):
        Cohort.load(spark, str(tmp_path / "nothing"))


def test_own_levels_and_empty_tables(spark, tmp_path):
    level = ObsLevel("visit", "visit", "from", "to")
    obs = spark.createDataFrame([], "visit long, `from` timestamp_ntz, `to` timestamp_ntz, `a.b` map<string,int>")
    for buckets in (None, 3):
        folder = str(tmp_path / str(buckets))
        Cohort(obs, level, series={"none": obs.select("visit")}).save(folder, buckets=buckets)
        back = Cohort.load(spark, folder)
        assert back.level == level and back.obs.schema == obs.schema and back.obs.count() == 0


def exchanges(df, on_scans=True):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_bucketed_tables_need_no_shuffle(cohort, labs, tmp_path, spark):
    folder = str(tmp_path / "c")
    cohort.add_series(labs, DynamicSpec("lab", COLUMNS)).save(folder, buckets=4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        back = Cohort.load(spark, folder)
        window = TimeWindow.after("hospital_admission", "2d")
        assert exchanges(joins.attach_window(back.series["lab"], back.obs, window, "case_id")) == 0
        with_features = back.add_features("lab", [Feature("peak", "!max value", window=window), Feature("mid", "!median value")])
        assert exchanges(with_features.obs) == 0
        plain = cohort.add_series(labs, DynamicSpec("lab", COLUMNS)).add_features("lab", [Feature("peak", "!max value", window=window), Feature("mid", "!median value")])
        assert exchanges(plain.obs) > 0 and rows(with_features.obs) == rows(plain.obs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_diamond_is_planned_once(cohort, labs, monkeypatch):
    made = []
    plain = cohorts.dynamic_series
    monkeypatch.setattr(cohorts, "dynamic_series", lambda base, obs, spec, *a, **k: made.append(spec.name) or plain(base, obs, spec, *a, **k))
    both = lambda rows, required, obs: required["x"].unionByName(required["y"])
    specs = [DynamicSpec(f"{s}0", COLUMNS) for s in "ab"]
    for i in range(1, 7):
        specs += [DynamicSpec(f"{s}{i}", function=both, requires={"x": Requirement(f"a{i - 1}"), "y": Requirement(f"b{i - 1}")}) for s in "ab"]
    shared = []
    got, failed = cohort.add_all({"a0": labs, "b0": labs}, list(reversed(specs)), share=lambda df: shared.append(1) or df)
    assert not failed and len(made) == 14 == len(set(made)) and len(shared) == 12  # the two on top are used by nothing else
    assert got.series["a3"].count() == 8 * got.series["a0"].count()
    other = [DynamicSpec("w", function=both, requires={"x": Requirement("a0", ("0d", "1d")), "y": Requirement("a0", ("0d", "1d"))}), DynamicSpec("a0", COLUMNS)]
    made.clear()
    cohort.add_all({"a0": labs}, other)
    assert sorted(made) == ["a0", "a0", "w"]  # two windows of a0


def test_names_are_columns_of_the_observations_first(cohort, labs):
    seen = {}

    def derive(rows, required, obs):
        seen.update({k: (sorted(df.columns), df.count()) for k, df in required.items()})
        return rows.join(required["years"], "case_id").withColumn("value", F.col("age").cast("double"))

    needs = {"years": Requirement("age", ("-9d", "-8d")), "old": "inherit"}
    spec = DynamicSpec("x", COLUMNS, function=derive, requires=needs, window=TimeWindow.after("hospital_admission", "1d"))
    had = cohort.add_series(labs, DynamicSpec("old", COLUMNS))
    got, failed = had.add_all({"x": labs, "age": labs}, [spec, DynamicSpec("age", COLUMNS)])
    assert not failed and seen["years"] == (["age", "case_id", "data_source"], 10) and seen["old"][1] == had.series["old"].count()
    assert {r["value"] for r in got.series["x"].where("case_id = 'c3'").collect()} == {18.0}
    assert had.add_series(labs, spec).series["x"].count() == got.series["x"].count()
    one, failed = had.add_all({"x": labs}, [DynamicSpec("x", COLUMNS, function=derive, requires=needs, sources=("a",))])
    assert not failed and seen["years"][1] == 5 and {r["case_id"] for r in one.series["x"].collect()} == {"c1", "c3", "c5", "c7", "c9"}
    _, failed = cohort.add_all({"x": labs}, [DynamicSpec("x", COLUMNS, requires=("nowhere",))])
    assert set(failed) == {"x"}


def test_changes_hold_for_one_requirement(cohort, labs):
    counts = {}

    def derive(rows, required, obs):
        counts.update({k: df.count() for k, df in required.items()})
        return rows

    needs = {"plain": Requirement("lab"), "large": Requirement("lab", changes={"cleaning": {"lab": {"low": 10.0}}})}
    _, failed = cohort.add_all({"lab": labs, "x": labs}, [DynamicSpec("x", COLUMNS, function=derive, requires=needs), DynamicSpec("lab", COLUMNS)])
    assert not failed and counts["plain"] == 60 and 0 < counts["large"] < 60


def test_what_requires_a_failed_variable_fails_too(cohort, labs):
    specs = [DynamicSpec("bad", {"value": "nope"}), *(DynamicSpec(f"x{i}", COLUMNS, requires=("bad",) if i == 0 else (f"x{i - 1}", "bad")) for i in range(12)), DynamicSpec("good", COLUMNS)]
    got, failed = cohort.add_all(dict.fromkeys([s.name for s in specs], labs), specs)
    assert set(got.series) == {"good"} and len(failed) == 13


TOLERANT = [
    ("CAST(a AS INT) > 1", "TRY_CAST(a AS INT) > 1"), ("a::INT > 1", "TRY_CAST(a AS INT) > 1"), ("x.a::decimal(10, 2)", "TRY_CAST(x.a AS decimal(10, 2))"),
    ("trim(lower(a))::int + 1", "TRY_CAST(trim(lower(a)) AS int) + 1"), ("'7'::int", "TRY_CAST('7' AS int)"), ("a::string::int", "TRY_CAST(TRY_CAST(a AS string) AS int)"),
    ("'a::int' = b", "'a::int' = b"), ("`a b`::int IN (1)", "TRY_CAST(`a b` AS int) IN (1)"), ("(a || ')')::int", "TRY_CAST((a || ')') AS int)"), ("l[0]::int", "TRY_CAST(l[0] AS int)"),
    ("NOT a::boolean AND cast_a = 'CAST('", "NOT TRY_CAST(a AS boolean) AND cast_a = 'CAST('"), ("a :: INT", "TRY_CAST(a AS INT)"), ("split(a, ',')::array<int>", "TRY_CAST(split(a, ',') AS array<int>)"),
]


@pytest.mark.parametrize(("given", "wanted"), TOLERANT)
def test_casts_are_tolerant(given, wanted):
    assert frames.tolerant(given) == wanted


def test_filters_don_t_fail_on_junk(spark, tmp_path, cohort):
    df = spark.createDataFrame([("x", 1), ("3", 2), (None, 3), ("5", 4)], "v string, i int")
    df.write.parquet(str(tmp_path / "m"))
    for text in ("CAST(v AS INT) > 2", "v::INT > 2", "(v::INT) > 2"):
        assert rows(df.where(frames.condition(text)).select("i")) == [(2,), (4,)]
        assert rows(datasets.read_measurements(spark, str(tmp_path / "m"), ["i"], text)) == [(2,), (4,)]
    plan = datasets.read_measurements(spark, str(tmp_path / "m"), ["i"], "i > 2")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(i), GreaterThan(i,2)]" in plan and "ReadSchema: struct<i:int>" in plan


def test_reasons_and_composition(spark, cohort):
    df = spark.createDataFrame([(1, True, None), (2, True, True), (2, False, True), (None, False, False)], "k int, a boolean, b boolean")
    got = {tuple(r["reasons"]): (r["n_reasons"], r["rows"], r["keys"]) for r in reason_overlaps(df, {"A": F.col("a"), "B": F.col("b")}, "k").collect()}
    assert got == {("A",): (1, 1, 1), ("A", "B"): (2, 1, 1), ("B",): (1, 1, 1), (): (0, 1, 0)}
    with pytest.raises(ValueError):
        reason_overlaps(df, {})
    change = composition_change(df.select("k"), spark.createDataFrame([(2,), (5,), (5,), (None,)], "k int"), "k").first()
    assert tuple(change) == (2, 1, 1, 4, 4)
    assert tuple(composition_change(df.limit(0), df.limit(0), "k").first()) == (0, 0, 0, 0, 0)
    smaller = cohort.include("age", ">= 18")
    assert tuple(smaller.composition().first())[:3] == (7, 0, 0) and tuple(smaller.composition(cohort).first())[:3] == (7, 0, 3)
    assert tuple(smaller._with(obs=smaller.obs.where("age > 20")).composition().first())[:3] == (4, 0, 3)
