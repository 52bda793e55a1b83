"""Loaders that turn hospital tables into observation frames.

Tables use logical names: patients (patient_id, sex, birthdate, death_timestamp, ...), stays (patient_id, case_id,
begin, end, age, discharge_type, ...), movements (patient_id, case_id, seq, begin, end, ward, department, kind, art),
diagnoses (case_id, seq, code, is_main), hierarchy (id, parent_id, case_id, name, value), procedures (case_id, seq,
code, begin).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import adult_at, is_adult, is_present, stay_status
from ..functions.time import parse_timestamp, utc_to_local, within_date_window
from ..operators.aggregates import conditional_max
from ..operators.frames import where_sql
from ..operators.intervals import change_blocks, merge_consecutive_stays, sequential_id
from ..operators.joins import asof_join, exists_in, restrict_to_cohort
from pyspark.sql import Window


@dataclass(frozen=True)
class Extract:
    """What an extraction covers: the time that counts as now (end date, else the dataset's, else the clock) and its rules."""

    start_date: str | None = None
    end_date: str | None = None
    reference_now: str | None = None
    wards: tuple[str, ...] = ()
    excluded_arts: tuple[str, ...] = ()
    adults_only: bool = True
    require_movement: bool = True
    where: str | None = None

    def now(self) -> Column:
        fixed = self.end_date or self.reference_now
        return F.lit(fixed).cast("timestamp_ntz") if fixed else F.localtimestamp()

    def window(self, start: Column, end: Column) -> Column:
        bound = lambda d: F.lit(d).cast("timestamp_ntz")
        return within_date_window(start, end, bound(self.start_date), bound(self.end_date))


def qualifying_movements(movements: DataFrame, x: Extract) -> DataFrame:
    """Admissions (kind 3), and transfers (kind 1) of an art that isn't excluded; on the given wards, inside the window."""
    transfer = (F.col("kind") == "1") & (~F.col("art").isin(*x.excluded_arts) if x.excluded_arts else F.lit(True))
    df = movements.where((F.col("kind") == "3") | transfer)
    df = df.where(F.col("ward").isin(*x.wards)) if x.wards else df
    return df.where(x.window(F.col("begin"), F.col("end")))


def load_patients(patients: DataFrame, movements: DataFrame, x: Extract) -> DataFrame:
    """One row a patient, with censordate: death, or now."""
    censor = F.coalesce(F.col("death_timestamp"), x.now())
    df = patients.where(is_present(F.col("patient_id"))).where(x.window(F.col("birthdate"), F.col("death_timestamp")))
    df = df.where(adult_at(F.col("birthdate"), censor)) if x.adults_only else df
    df = exists_in(df, qualifying_movements(movements, x), "patient_id") if x.require_movement else df
    return where_sql(df, x.where).withColumn("censordate", censor).distinct()


def load_stays(stays: DataFrame, patients: DataFrame, movements: DataFrame, x: Extract, *, death_types: tuple[str, ...] = ()) -> DataFrame:
    """One row a hospital stay with patient data; times after now are null, and the status tells what the stay is now."""
    now, begin, end = x.now(), F.col("begin"), F.col("end")
    df = where_sql(stays, x.where).where(is_present(F.col("case_id"))).where(x.window(begin, end))
    df = df.where(is_adult(F.col("age"))) if x.adults_only else df
    df = exists_in(df, qualifying_movements(movements, x), "case_id") if x.require_movement else df
    shared = [c for c in ("sex", "birthdate", "postcode") if c in patients.columns]
    df = df.join(patients.select("patient_id", *shared), "patient_id", "left")
    return df.withColumns(
        {
            "hospital_admission": F.when(begin <= now, begin),
            "hospital_discharge": F.when(end <= now, end),
            "hospital_status": stay_status(begin, end, now),
            "inhospital_death": F.col("discharge_type").isin(*death_types) if death_types else F.lit(False),
        }
    ).drop("begin", "end").withColumnRenamed("age", "age_on_admission")


def align_diagnoses(movements: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """movements with the main diagnosis of their department block: the n-th block of a case goes with its n-th main diagnosis."""
    main = restrict_to_cohort(diagnoses.where("is_main"), movements, "case_id")
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("seq", "code")) - 1
    numbered = main.select("case_id", nth.alias("block"), F.col("code").alias("admission_diagnosis"))
    blocks = change_blocks(movements, "case_id", "department", ["begin", "seq"])
    return blocks.join(numbered, ["case_id", "block"], "left").drop("block")


def load_icu_stays(movements: DataFrame, diagnoses: DataFrame, stays: DataFrame, x: Extract, *, merge_hours: float | None = 24, same_ward_only: bool = False) -> DataFrame:
    """One row an ICU stay: movements with diagnoses, merged across short gaps (or kept one by one), joined to their hospital stay
    and contained in it, numbered within the case. Merged columns are ordered lists."""
    now = x.now()
    rows = align_diagnoses(qualifying_movements(movements, x), diagnoses)
    rows = rows.withColumn("icu_status", stay_status(F.col("begin"), F.col("end"), now))
    rows = rows.withColumns({"begin": F.when(F.col("begin") <= now, F.col("begin")), "end": F.when(F.col("end") <= now, F.col("end"))})
    listed = ["ward", "department", "admission_diagnosis"]
    if merge_hours is None:
        icu = rows.select("case_id", "begin", "end", "icu_status", "seq", *[F.array(c).alias(c) for c in listed])
    else:
        icu = merge_consecutive_stays(rows, "case_id", "begin", "end", hours=merge_hours, ward="ward" if same_ward_only else None, status="icu_status", lists=listed, tiebreak=["seq"])
    icu = icu.withColumnsRenamed({"begin": "icu_admission", "end": "icu_discharge"}).drop("stay", "seq")
    joined = icu.join(stays, "case_id")
    inside = F.coalesce(F.col("icu_admission") >= F.col("hospital_admission"), F.lit(True)) & F.coalesce(F.col("icu_discharge") <= F.col("hospital_discharge"), F.lit(True))
    return sequential_id(joined.where(inside), "case_id", ["icu_admission"], "icu_stay_id")


def build_procedures(hierarchy: DataFrame, procedures: DataFrame, movements: DataFrame, *, names: dict[str, str], events: dict[str, str], zone: str = "Europe/Berlin", code_prefix: str = "5") -> DataFrame:
    """One row a procedure: its times from a hierarchy of treatment, operation-time and event rows, and the codes and ward of the
    nearest coded procedure of the case within four hours.

    names: what the hierarchy calls treatment, begin, end, operation, event and event_time; events: {event value: output column}.
    Times in the hierarchy are UTC and become local time before the latest of repeated ones is taken.
    """
    time = lambda c: utc_to_local(parse_timestamp(F.col(c)).cast("timestamp"), zone)
    called = lambda n: hierarchy.where(F.col("name") == names[n])
    treatments = called("treatment").select("case_id", F.col("id").alias("procedure_id"))
    bounds = hierarchy.where(F.col("name").isin(names["begin"], names["end"])).select(F.col("parent_id").alias("procedure_id"), "name", time("value").alias("at"))
    ends = conditional_max(bounds, ["procedure_id"], "name", "at", [names["begin"], names["end"]]).withColumnsRenamed({names["begin"]: "or_time_begin", names["end"]: "or_time_end"})
    operations = called("operation").select(F.col("parent_id").alias("procedure_id"), F.col("id").alias("operation_id"))
    # an event is a pair of children of the same operation row: its name and its time
    pairs = hierarchy.where(F.col("name").isin(names["event"], names["event_time"])).groupBy(F.col("parent_id").alias("operation_id")).agg(
        F.collect_list(F.when(F.col("name") == names["event"], F.col("value"))).alias("what"), F.max(F.when(F.col("name") == names["event_time"], time("value"))).alias("at")
    )
    named = pairs.where(F.col("at").isNotNull()).select("operation_id", "at", F.explode("what").alias("what"))
    timed = operations.join(treatments, "procedure_id").join(named, "operation_id")
    wide = conditional_max(timed, ["case_id", "procedure_id"], "what", "at", list(events)).withColumnsRenamed(events)
    main = wide.join(ends, "procedure_id", "left")
    coded = procedures.where(F.col("code").startswith(code_prefix)).groupBy("case_id", "seq").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("begin", "code"))), lambda x: x["code"]).alias("codes"), F.min("begin").alias("or_time_begin")
    )
    placed = coded.join(movements.select("case_id", "seq", "ward", "department"), ["case_id", "seq"], "left")
    values = {"codes": "ops_code", "ward": "bw_ward", "department": "bw_department"}
    found = asof_join(main, placed, by="case_id", on="or_time_begin", values=values, strategy="nearest", tolerance="4h", tiebreak="seq", matched_time="or_time_ops")
    return found.withColumn("ops_code", F.coalesce("ops_code", F.expr("CAST(array() AS array<string>)"))).drop("procedure_id")


def movement_timeline(icu: DataFrame, case: str = "case_id", wards: str = "ward", start: str = "icu_admission") -> DataFrame:
    """The wards of each case in order, numbered from 1, and the number of the stay they belong to."""
    stay = F.row_number().over(Window.partitionBy(case).orderBy(start))
    exploded = icu.withColumn("stay", stay).select(case, "stay", start, F.posexplode_outer(wards).alias("place", "ward"))
    return exploded.withColumn("step", F.row_number().over(Window.partitionBy(case).orderBy("stay", "place")))
