"""Scalar rules as Column builders; all of them stay inside Spark's code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import offset


def is_present(value: Column) -> Column:
    """Neither null nor the text NULL."""
    return value.isNotNull() & (value != "NULL")


def safe_cast(value: Column, kind: str) -> Column:
    """The cast, null where it fails."""
    return value.try_cast(kind)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in floating point: over zero it is infinite, or NaN for zero and NaN; null only where a side is null."""
    # pow(0.0, -1) is infinite, with the sign of the zero
    return F.when(whole == 0, part * F.pow(whole, F.lit(-1.0))).otherwise(F.try_divide(part, whole))


def round_scaled(value: Column, digits: int) -> Column:
    """A double rounded half away from zero after scaling in binary, as SQL engines round doubles. Spark's round goes by the shortest
    decimal digits, and so rounds some values up that lie just below a half once scaled."""
    scale = F.lit(10.0**digits)
    scaled = value * scale
    size = F.abs(scaled)
    whole = F.floor(size)
    up = F.when(size - whole >= 0.5, 1).otherwise(0)
    # from 2 ** 52 on a double has no fraction; NaN is none of these
    return F.when(size < 2.0**52, F.signum(value) * (whole + up) / scale).when(size == math.inf, value).otherwise(scaled / scale)


def threshold_score(value: Column, bands: list[tuple[float, int]], *, below: int = 0) -> Column:
    """Points of the largest bound that the value reaches; `below` under all bounds, null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for bound, points in sorted(bands, reverse=True):
        out = out.when(value >= bound, F.lit(points))
    return out.otherwise(F.lit(below))


def band_label(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first band whose upper bound lies above the value; a null value has none."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in bands:
        out = out.when(value < bound, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def recode(value: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for old, new in mapping.items():
        out = out.when(value == old, F.lit(new))
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def drop_consecutive_duplicates(values: Column) -> Column:
    """The array without elements equal to the one before; nulls next to each other count as equal."""
    return F.filter(values, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(values, i - 1)))


def split_codes(text: Column, separator: str = ",") -> Column:
    """Trimmed parts of a list in text; empty parts are left out."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def normalize_text(text: Column, nothing: tuple[str, ...] = ("NULL",)) -> Column:
    """Lower case without umlauts and with single blanks; null and the words in nothing become empty."""
    plain = F.lower(F.when(text.isNull() | text.isin(*nothing), F.lit("")).otherwise(text))
    # fixed values: spelling of umlauts
    for letter, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        plain = F.replace(plain, F.lit(letter), F.lit(spelled))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def rate_per_hour(value: Column, unit: Column, target: str = "mg/kg/h", cap: float = 50.0) -> Column:
    """Infusion rates in the target unit: per minute times 60, per day divided by 24; other units, values that aren't
    numbers and values above cap are null."""
    number = value.try_cast("double")
    per = target.removesuffix("/h")
    rate = F.when(F.trim(unit) == target, number).when(F.trim(unit) == f"{per}/min", number * 60).when(F.trim(unit) == f"{per}/d", number / 24)
    return F.when(rate <= cap, rate)


def alveolar_gradient(pao2: Column, paco2: Column, fio2: Column) -> Column:
    """Alveolar minus arterial oxygen pressure; room air (0.21) where no fraction is charted."""
    # fixed values of the alveolar gas equation: 760 and 47 mmHg, respiratory quotient 0.8
    return F.coalesce(fio2, F.lit(0.21)) * (760 - 47) - paco2 / 0.8 - pao2


def stay_status(begin: Column, end: Column, now: Column) -> Column:
    """Implausible, Incomplete, Planned, Ongoing or Finalised, at the time now.

    Ends before begins are implausible. A stay without a begin is incomplete, as is one without an end that began over 90
    days ago; a stay that lies ahead is planned.
    """
    open_stay = F.when(begin > now, F.lit("Planned")).when(begin >= offset(now, "-90d"), F.lit("Ongoing")).otherwise(F.lit("Incomplete"))
    closed_stay = F.when(begin > now, F.lit("Planned")).when(end > now, F.lit("Ongoing")).otherwise(F.lit("Finalised"))
    return (
        F.when(begin > end, F.lit("Implausible"))
        .when(begin.isNull() | now.isNull(), F.lit("Incomplete"))
        .when(end.isNull(), open_stay)
        .otherwise(closed_stay)
    )


def is_adult(age: Column) -> Column:
    return age >= 18


def adult_at(birth: Column, day: Column) -> Column:
    """Born 18 years before day or earlier; an unknown birth date passes."""
    return birth.isNull() | (birth <= F.add_months(day, -216))
