"""One value per observation: features of a time series inside each observation's window.

All features of one base series are computed by one grouping; each is a conditional aggregate, so the series is read
and shuffled once however many features there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..functions.time import Offset, TimeWindow, contains, micros
from .frames import condition
from .joins import attach_window, closest_value
from .summary import exact_percentiles

_SELECT = re.compile(r"^!(\w+)(?:\(([^)]*)\))?\s*(.*)$")
SIMPLE = ("first", "last", "mean", "median", "min", "max", "std", "perc", "sum", "count", "any", "sum_interval", "closest")


@dataclass(frozen=True)
class Select:
    """`!first value, recordtime`, `!perc(90) value`, `!closest(anchor, 2h, 1d) value` and so on."""

    function: str
    arguments: tuple[str, ...]
    columns: tuple[str, ...]


def parse_select(text: str) -> Select:
    match = _SELECT.match(text.strip())
    if not match or match[1] not in SIMPLE:
        raise ValueError(f"unknown feature {text!r}")
    arguments = tuple(a.strip() for a in (match[2] or "").split(",") if a.strip())
    columns = tuple(c.strip() for c in match[3].split(",") if c.strip()) or ("value",)
    return Select(match[1], arguments, columns)


@dataclass(frozen=True)
class Feature:
    """A named feature: a select expression, a row filter and a window. interval_match tells how interval rows meet the
    window: by their start, or by overlap. Without require_anchor a null bound is open; with it such observations have no rows."""

    name: str
    select: str
    where: str | None = None
    window: TimeWindow = field(default_factory=TimeWindow)
    interval_match: str = "start"
    require_anchor: bool = False

    def outputs(self) -> list[tuple[str, str]]:
        """(column, output name)."""
        columns = parse_select(self.select).columns
        return [(c, self.name if len(columns) == 1 else f"{self.name}_{c}") for c in columns]


def nearest_quantile(values: Column, share: float) -> Column:
    """The element whose rank is nearest to share * (n - 1), halves up, of an array without nulls."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.get(ordered, F.floor((F.size(values) - 1) * F.lit(share) + F.lit(0.5)).cast("int")))


def _aggregate(s: Select, column: str, inside: Column, time: str, tiebreak: list[str]) -> Column:
    value = F.when(inside, F.col(column))
    rank = F.when(inside, F.struct(time, *tiebreak))
    match s.function:
        case "first":
            return F.min_by(F.struct(column), rank)[column]
        case "last":
            return F.max_by(F.struct(column), rank)[column]
        case "mean":
            return F.avg(value)
        case "median":
            return F.median(value)
        case "min":
            return F.min(value)
        case "max":
            return F.max(value)
        case "std":
            return F.stddev_samp(value)
        case "perc":
            return nearest_quantile(F.collect_list(value), float(s.arguments[0]) / 100)
        case "sum":
            return F.coalesce(F.sum(value), F.lit(0).cast("double"))
        case "count":
            return F.count_if(inside)
        case "any":
            return F.coalesce(F.bool_or(inside & F.col(column).isNotNull()), F.lit(False))
    raise ValueError(s.function)


def static_features(base: DataFrame, obs: DataFrame, features: list[Feature], key: str, *, join_key: str | None = None, time: str = "recordtime", end: str = "recordtime_end", tiebreak: list[str] | None = None, spread: bool = False) -> DataFrame:
    """One row for each of obs with all features; null (false for any, 0 for sum_interval) where it has no rows.

    Ties in time are broken by the tiebreak columns. perc and median keep a group's values together, a group being one
    observation's series. With spread they don't: those of all features are found by two more scans, in which a hot observation's values
    are counted and bracketed over tasks; their columns must be numbers. Observations must be unique by key.
    """
    tiebreak = tiebreak or []
    plain = [f for f in features if parse_select(f.select).function not in ("closest", "sum_interval")]
    interval = [f for f in features if parse_select(f.select).function == "sum_interval"]
    out = obs.select(key)
    joined_once = None
    if plain or interval:
        bounds = []
        for i, f in enumerate([*plain, *interval]):
            low, high = f.window.bounds()
            bounds += [low.cast("timestamp_ntz").alias(f"__lo{i}"), high.cast("timestamp_ntz").alias(f"__hi{i}")]
        on = join_key or key
        slim = obs.select(*dict.fromkeys([on, key]), *bounds)
        joined_once = (base.drop(key) if on != key else base).join(slim, on)
        exprs, tests, ranked = [], [], []
        for i, f in enumerate([*plain, *interval]):
            s, low, high, t = parse_select(f.select), F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col(time)
            if s.function == "sum_interval":
                stop = F.greatest(t, F.coalesce(F.col(end), t))
                inside = (low.isNull() | (stop >= low)) & (high.isNull() | (t <= high)) & (low.isNull() | high.isNull() | (low <= high))
            elif f.interval_match == "overlap" and end in base.columns:
                stop = F.greatest(t, F.coalesce(F.col(end), t))
                inside = (low.isNull() | (stop >= low)) & (high.isNull() | (t <= high))
            else:
                inside = contains(t, low, high)
            if f.require_anchor:
                inside = inside & (low.isNotNull() if f.window.t_min else F.lit(True)) & (high.isNotNull() if f.window.t_max else F.lit(True))
            if f.where:
                inside = inside & condition(f.where)
            inside = F.coalesce(inside, F.lit(False))
            tests.append(inside)
            for column, name in f.outputs():
                if spread and s.function in ("median", "perc"):
                    ranked.append((column, name, inside, s))
                elif s.function == "sum_interval":
                    length = micros(stop) - micros(t)
                    overlap = micros(F.least(stop, F.coalesce(high, stop))) - micros(F.greatest(t, F.coalesce(low, t)))
                    share = F.when(length <= 0, F.col(column)).otherwise(F.col(column) * overlap / length)
                    exprs.append(F.coalesce(F.sum(F.when(inside, share)), F.lit(0.0)).alias(name))
                elif s.function in ("count", "sum"):  # absent without rows
                    exprs.append(F.when(F.count_if(inside) > 0, _aggregate(s, column, inside, time, tiebreak)).alias(name))
                else:
                    exprs.append(_aggregate(s, column, inside, time, tiebreak).alias(name))
        useful = tests[0]
        for test in tests[1:]:
            useful = useful | test
        if exprs:
            out = out.join(joined_once.where(useful).groupBy(key).agg(*exprs), key, "left")
        if ranked:
            out = out.join(_spread_percentiles(joined_once.where(useful), key, ranked), key, "left")
        fill = {f.outputs()[0][1]: F.lit(False) for f in plain if parse_select(f.select).function == "any"}
        fill |= {name: F.lit(0.0) for f in interval for _, name in f.outputs()}
        if fill:
            out = out.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})
    for f in features:
        s = parse_select(f.select)
        if s.function == "closest":
            out = out.join(_closest(base, obs, f, s, key, join_key, time, tiebreak), key, "left")
    names = [name for f in features for _, name in f.outputs()]
    return out.select(key, *names) if spread else out


def _spread_percentiles(rows: DataFrame, key: str, ranked: list[tuple[str, str, Column, Select]]) -> DataFrame:
    """key and a column for each of ranked (column, name, rows that count, select), all found by one call of exact_percentiles."""
    kinds = dict(rows.dtypes)
    texts = [c for c, *_ in ranked if not kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) or kinds[c].startswith("interval")]
    if texts:
        raise ValueError(f"spread percentiles are of numbers, unlike {', '.join(texts)}")
    shares = list(dict.fromkeys(("perc", float(s.arguments[0]) / 100) if s.function == "perc" else ("median", 0.5) for *_, s in ranked))
    each = [F.struct(F.lit(i).alias("feature"), F.when(inside, F.col(c).cast("double")).alias("v")) for i, (c, _, inside, _) in enumerate(ranked)]
    long = rows.select(key, F.explode(F.array(*each)).alias("x")).select(key, F.col("x.feature").alias("__feature"), F.col("x.v").alias("__value")).where("__value IS NOT NULL")
    nearest = tuple(i for i, (function, _) in enumerate(shares) if function == "perc")
    found = exact_percentiles(long, [key, "__feature"], "__value", tuple(share for _, share in shares), nearest=nearest)
    columns = []
    for i, (c, name, _, s) in enumerate(ranked):
        place = shares.index(("perc", float(s.arguments[0]) / 100) if s.function == "perc" else ("median", 0.5))
        cut = F.max(F.when(F.col("__feature") == i, F.get("cuts", F.lit(place))))
        columns.append((cut.cast(kinds[c]) if s.function == "perc" else cut).alias(name))
    return found.groupBy(key).agg(*columns)


def _closest(base: DataFrame, obs: DataFrame, f: Feature, s: Select, key: str, join_key: str | None, time: str, tiebreak: list[str]) -> DataFrame:
    target, *rest = s.arguments
    shift, tolerance = ("0h", rest[0]) if len(rest) == 1 else (rest[0], rest[1]) if rest else ("0h", "52w")
    before, after = (tolerance.split() * 2)[:2]
    windowed = attach_window(base if not f.where else base.where(condition(f.where)), obs, f.window, key, join_key)
    rows = windowed.where(F.coalesce(contains(F.col(time), F.col("tmin"), F.col("tmax")), F.lit(False)))
    targets = obs.select(key, TimeWindow.between((target, shift)).bounds()[0].alias("target"))
    found = closest_value(rows, targets, key, [c for c, _ in f.outputs()], time=time, before=before, after=after, tiebreak=tiebreak[0] if tiebreak else None)
    return found.withColumnsRenamed(dict(f.outputs()))


def snapshot(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys and an order-free hash of the keys."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(key).alias("keys"),
        F.coalesce(F.bit_xor(F.xxhash64(key)), F.lit(0)).alias("key_hash"),
    )


def ordered_lists(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each column's values as a list in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in columns])))
    grouped = df.groupBy(*keys).agg(rows.alias("__rows"))
    return grouped.select(*keys, *[F.col("__rows")[f"__{c}"].alias(c) for c in columns])


def conditional_max(df: DataFrame, keys: list[str], name: str, value: str, wanted: list[str]) -> DataFrame:
    """A column for each wanted name: the largest value on rows of that name."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == w, F.col(value))).alias(w) for w in wanted])


def readmission_rate(df: DataFrame, patient: str) -> DataFrame:
    """One row: stays, patients, and stays beyond the first per patient."""
    both = df.agg(F.count(F.lit(1)).alias("stays"), F.count_distinct(patient).alias("patients"))
    return both.withColumn("readmissions_per_patient", F.try_divide(F.col("stays") - F.col("patients"), F.col("patients")))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, percent) from one aggregate."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    stacked = counts.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("x"))
    return stacked.select("x.column", "x.missing", F.round(100 * F.try_divide("x.missing", "n"), 2).alias("percent"))


def series_quality(df: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """One row of checks on a series: rows, keys, range, nulls and impossible values."""
    v = F.col(value)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
        F.count_if(v.isNull()).alias("nulls"), F.count_if((v < low) | (v > high)).alias("impossible"),
    )


def trend(df: DataFrame, keys: list[str], time: str, value: str, tiebreak: list[str] | None = None, limit: float = 200.0) -> DataFrame:
    """First, last and largest value, their ratios, and the percentage cleared from first to last (null below two points,
    clipped to +-limit). Undated values come last. Over a first value of zero, ratios are infinite or NaN, which clips to a limit."""
    rank = F.struct(*[x for c in (time, *(tiebreak or [])) for x in (F.isnull(c), F.col(c))])
    grouped = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(value, rank).alias("first"), F.max_by(value, rank).alias("last"), F.max(value).alias("highest"), F.count(F.lit(1)).alias("points")
    )
    cleared = ratio(100 * (F.col("first") - F.col("last")), F.col("first"))
    return grouped.withColumns(
        {
            "last_to_first": ratio(F.col("last"), F.col("first")),
            "highest_to_first": ratio(F.col("highest"), F.col("first")),
            "clearance": F.when(F.col("points") >= 2, F.greatest(F.least(cleared, F.lit(limit)), F.lit(-limit))),
        }
    )


def window_offset(name: str, select: str, start: str, length: Offset, where: str | None = None) -> Feature:
    """A feature over a window of the given length from a start column."""
    return Feature(name, select, where, TimeWindow.after(start, length))
