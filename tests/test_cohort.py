import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayframe.functions.time import TimeWindow
from stayframe.jobs.cohort import Cohort, DynamicSpec, overridden, resolved_order
from stayframe.operators.aggregates import Feature
from stayframe.operators.joins import add_static
from stayframe.sources import datasets, hospital

T0 = datetime(2024, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


@pytest.fixture
def cohort(spark):
    obs = spark.createDataFrame([(f"c{i}", f"p{i // 2}", day(i), day(i + 5), 15 + i) for i in range(10)], "case_id string, patient_id string, hospital_admission timestamp_ntz, hospital_discharge timestamp_ntz, age int")
    return Cohort(obs, "hospital_stay")


@pytest.fixture
def labs(spark):
    return spark.createDataFrame([(f"c{i}", day(i + k), float(i * k), "mmol") for i in range(10) for k in range(8)] + [("other", day(1), 1.0, "mmol")], "case string, at timestamp_ntz, v double, unit string")


SPEC = DynamicSpec("lactate", {"case_id": "case", "recordtime": "at", "value": "v", "attributes_unit": "unit"}, cleaning={"lactate": {"low": 1.0}})


def test_series_are_windowed_and_cleaned(cohort, labs):
    found = cohort.add_series(labs, SPEC).series["lactate"]
    got = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("m")).orderBy("case_id").collect()
    assert [(r["case_id"], r["n"], r["m"]) for r in got][:2] == [("c1", 5, 5.0), ("c2", 5, 10.0)]
    assert "attributes" in found.columns


def test_selection_is_logged_and_balances(cohort, labs):
    c = cohort.add_series(labs, SPEC).include("age", ">= 18", "adults").exclude("age", "is null").include("lactate", "> 20")
    log = [(r["description"], r["rows_before"], r["rows_after"]) for r in c.attrition().orderBy("step").collect()]
    assert log == [("adults", 10, 7), ("`age` is null", 7, 7), ("`lactate` > 20", 7, 5)]
    profile = c.profile("patient_id")
    assert profile["screened"] == 10 and profile["included"] == 5 and profile["zero_reasons"] == ["`age` is null"] and sum(profile["arms"].values()) == 5
    assert c.consistent() and not c._with(obs=c.obs.limit(1)).consistent()


def test_null_conditions(spark):
    obs = spark.createDataFrame([("a", 1), ("b", None)], "case_id string, x int")
    c = Cohort(obs, "hospital")
    assert c.track("in", F.col("x") == 1).obs.count() == 1 and c.track("out", F.col("x") == 1, "exclude").obs.count() == 1


def test_save_and_load(cohort, labs, tmp_path, spark):
    c = cohort.add_series(labs, SPEC).include("age", ">= 18").set_t_eligible("hospital_admission")
    c.save(str(tmp_path / "c"))
    back = Cohort.load(spark, str(tmp_path / "c"))
    assert back.obs.count() == 7 and back.log == c.log and back.series["lactate"].count() == c.series["lactate"].count() and back.consistent()
    for kind in ("parquet", "csv", "json"):
        c.export(str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "lactate")).count() == c.series["lactate"].count()


def test_features_static_and_horizon(cohort, labs, spark):
    c = cohort.add_series(labs, SPEC).add_features("lactate", [Feature("peak", "!max value")]).add_derived("double_peak", "peak * 2").add_free_days(
        spark.createDataFrame([("c1", day(1), day(3))], "case_id string, recordtime timestamp_ntz, recordtime_end timestamp_ntz"), "vent_free", 7
    )
    r = c.obs.where("case_id = 'c1'").first()
    assert (r["peak"], r["double_peak"], r["vent_free_7d"]) == (5.0, 10.0, 5)
    assert c.table_one("patient_id").count() > 0


def test_static_names(cohort, spark):
    obs = cohort.obs.withColumn("sofa", F.lit(1)).withColumn("sofa_max", F.lit(2))
    data = spark.createDataFrame([("c1", 7)], "case_id string, x int")
    out = add_static(obs, data, "case_id", "x", "sofa")
    assert out.where("case_id = 'c1'").first()["sofa"] == 7 and "sofa_max" in out.columns
    with pytest.raises(ValueError):
        add_static(obs, data.withColumn("y", F.lit(1)), "case_id", "x")
    with pytest.raises(ValueError):
        cohort.add_static(data.unionAll(data), "x")


def test_specs_are_ordered_and_failures_reported(cohort, labs):
    assert resolved_order({"a": ("b",), "b": ("c",), "c": ()}) == ["c", "b", "a"]
    with pytest.raises(ValueError):
        resolved_order({"a": ("b",), "b": ("a",)})
    assert overridden({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    bad = DynamicSpec("bad", {"case_id": "case", "recordtime": "at", "value": "nope"}, requires=("lactate",))
    c, failed = cohort.add_all({"lactate": labs, "bad": labs}, [bad, SPEC])
    assert set(c.series) == {"lactate"} and set(failed) == {"bad"}


def test_missing_anchor_skips_the_time_filter(cohort, labs):
    spec = DynamicSpec("lactate", SPEC.columns, window=TimeWindow.between("surgery_begin", None))
    assert cohort.add_series(labs, spec).series["lactate"].count() == 80


def test_manifest(tmp_path, spark):
    spark.range(3).write.parquet(str(tmp_path / "a" / "one.parquet"))
    spark.range(4).write.parquet(str(tmp_path / "a" / "two.parquet"))
    (tmp_path / "manifest.json").write_text(json.dumps({"dataset": "demo", "reference_now": "2024-01-01", "tables": {"t": {"files": ["a/one.parquet", "a/two.parquet"]}}}))
    found = datasets.read_dataset(spark, str(tmp_path))
    assert found.name == "demo" and found.tables["t"].count() == 7
    for bad in ("../x.parquet", "/x.parquet", "s3://b/x.parquet", "a/x.csv", ""):
        with pytest.raises(ValueError):
            datasets.checked_path(bad)


def test_unite_wraps_strings(spark):
    a = spark.createDataFrame([(1, "x")], "k int, w string")
    b = spark.createDataFrame([(2, ["y", "z"], 5)], "k long, w array<string>, extra int")
    got = datasets.unite({"a": a, "b": b}).orderBy("k").collect()
    assert [(r["k"], r["w"], r["extra"], r["data_source"]) for r in got] == [(1, ["x"], None, "a"), (2, ["y", "z"], 5, "b")]


def test_normalised_source(spark):
    df = spark.createDataFrame([("1", "Male", 1, 2.0)], "id string, g string, dead int, los double")
    got = datasets.normalize_source(df, {"id": "icu_stay_id", "g": "sex", "dead": "died", "los": "days"}, flags=["died"], length_of_stay="days").first()
    assert (got["sex"], got["died"], got["icu_discharge"]) == ("M", True, datetime(1900, 1, 3))
    with pytest.raises(ValueError):
        datasets.normalize_source(df, {"nope": "x"})


def test_patients_and_procedures(spark):
    patients = spark.createDataFrame([("p1", datetime(1960, 1, 1), None), ("p2", datetime(2015, 1, 1), None), ("NULL", datetime(1960, 1, 1), None), ("p3", None, None)], "patient_id string, birthdate timestamp_ntz, death_timestamp timestamp_ntz")
    movements = spark.createDataFrame([(p, "c", 1, day(1), day(2), "W", "D", "3", "x") for p in ("p1", "p2", "p3")], "patient_id string, case_id string, seq int, begin timestamp_ntz, end timestamp_ntz, ward string, department string, kind string, art string")
    got = hospital.load_patients(patients, movements, hospital.Extract(reference_now="2024-06-01"))
    assert sorted(r["patient_id"] for r in got.collect()) == ["p1", "p3"]
    nodes = [(1, None, "treatment", None), (2, 1, "begin", "2024-01-01 07:00:00"), (3, 1, "end", "2024-01-01 09:00:00"), (4, 1, "operation", None), (5, 4, "event", "CUT"), (6, 4, "at", "2024-01-01 07:30:00")]
    hierarchy = spark.createDataFrame([("c", *n) for n in nodes], "case_id string, id int, parent_id int, name string, value string")
    coded = spark.createDataFrame([("c", 1, "5-01", datetime(2024, 1, 1, 10)), ("c", 1, "5-02", datetime(2024, 1, 1, 11)), ("c", 1, "8-1", day(0))], "case_id string, seq int, code string, begin timestamp_ntz")
    names = {"treatment": "treatment", "begin": "begin", "end": "end", "operation": "operation", "event": "event", "event_time": "at"}
    r = hospital.build_procedures(hierarchy, coded, movements.where("patient_id = 'p1'"), names=names, events={"CUT": "or_time_incision"}).first()
    assert r["or_time_begin"] == datetime(2024, 1, 1, 8) and r["or_time_incision"] == datetime(2024, 1, 1, 8, 30) and r["ops_code"] == ["5-01", "5-02"] and r["bw_ward"] == "W"
    icu = spark.createDataFrame([("c", ["A", "B"], day(1))], "case_id string, ward array<string>, icu_admission timestamp_ntz")
    assert [r["step"] for r in hospital.movement_timeline(icu).orderBy("step").collect()] == [1, 2]


def test_requirements_windows_and_functions(cohort, labs):
    """Required series come in inherited, shifted, own and open windows; functions see rows, required series and observations."""
    seen = {}

    def derive(rows, required, obs):
        seen.update({name: df.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("case_id = 'c3'").first()["n"] for name, df in required.items()} | {"obs": obs.count()})
        return required["same"].select("case_id", "recordtime", (F.col("value") * 2).alias("value"))

    columns = {"case_id": "case", "recordtime": "at", "value": "v"}
    own = TimeWindow.after("hospital_admission", "1d")
    needs = {"same": "inherit", "wider": ("0d", "1d"), "own": own, "open": None}
    specs = [DynamicSpec("double", function=derive, window=TimeWindow.after("hospital_admission", "3d"), requires=needs), *(DynamicSpec(n, columns) for n in needs)]
    c, failed = cohort.add_all({n: labs for n in needs}, specs)
    assert not failed and seen == {"same": 4, "wider": 5, "own": 2, "open": 8, "obs": 10}
    assert sorted(r["value"] for r in c.series["double"].where("case_id = 'c3'").collect()) == [0.0, 6.0, 12.0, 18.0]


def test_frozen_windows_levels_constants_and_extractors(cohort, labs):
    columns = {"case_id": "case", "recordtime": "at", "value": "v"}
    day_one, days = TimeWindow.after("hospital_admission", "1d"), TimeWindow.after("hospital_admission", "4d")
    count = lambda c, n: c.series[n].where("case_id = 'c3'").count()
    c = cohort.add_series(labs, DynamicSpec("free", columns, window=day_one), days).add_series(labs, DynamicSpec("fixed", columns, window=day_one, frozen=True), days)
    assert (count(c, "free"), count(c, "fixed")) == (5, 2)
    with pytest.raises(ValueError, match="level"):
        cohort.add_series(labs, DynamicSpec("icu", columns, levels=("icu_stay",)))
    c = cohort.add_series(None, DynamicSpec("one", constant=1.0))
    assert c.series["one"].count() == 10 and {r["value"] for r in c.series["one"].collect()} == {1.0}
    extract = lambda base, obs: base.selectExpr("case AS case_id", "at AS recordtime", "v + 1 AS value")
    assert cohort.add_series(labs, DynamicSpec("own", extractor=extract)).series["own"].agg(F.min("value")).first()[0] == 1.0
    low, high = cohort.configured_window().bounds()
    r = cohort.obs.where("case_id = 'c3'").select(low.alias("a"), high.alias("b")).first()
    assert (r["a"], r["b"]) == (day(1), day(5))


def test_only_planning_errors_are_reported(cohort, labs):
    def broken(rows):
        raise RuntimeError("not a planning error")

    with pytest.raises(RuntimeError):
        cohort.add_all({"x": labs}, [DynamicSpec("x", {"case_id": "case", "recordtime": "at", "value": "v"}, function=broken)])


def test_branches_and_derived_columns(cohort):
    c = cohort.include("age", ">= 18").add_derived("old", "age > 20")
    b = c.branch(c.obs.where("old"))
    assert len(c.log) == 1 and b.log == [] and b.obs.count() == 4
