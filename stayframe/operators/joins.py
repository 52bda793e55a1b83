"""Joins on observation keys and as-of joins along time.

Every join has an equality on a key. As-of joins pair the two series with one union and one window over (key, time):
one exchange on the key, no product of the two sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import Offset, TimeWindow, contains, fixed_micros, micros, overlaps


def restrict_to_cohort(df: DataFrame, obs: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key occurs in obs."""
    return df.join(obs.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def exists_in(df: DataFrame, other: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    return restrict_to_cohort(df, other.where(where) if where is not None else other, key)


def keep_keys(obs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return obs.join(keys.select(key).distinct(), key, "left_semi")


def drop_keys(obs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return obs.join(keys.select(key).distinct(), key, "left_anti")


def attach_window(df: DataFrame, obs: DataFrame, window: TimeWindow, key: str, join_key: str | None = None) -> DataFrame:
    """df with the observation key, tmin and tmax of each observation it belongs to; a record of a coarser key (a case, a
    patient) is repeated for each of its observations."""
    on = join_key or (key if key in df.columns else None)
    if on is None:
        raise ValueError(f"{key} isn't in the frame: name the coarser key to join by")
    low, high = window.bounds()
    bounds = obs.select(*dict.fromkeys([on, key]), low.cast("timestamp_ntz").alias("tmin"), high.cast("timestamp_ntz").alias("tmax"))
    return df.drop("tmin", "tmax", *([key] if on != key else [])).join(bounds, on)


def attach_obs_ids(df: DataFrame, obs: DataFrame, ids: list[str]) -> DataFrame:
    """df restricted to the cohort by the first of ids that it has, with the missing ids of obs added."""
    shared = [c for c in ids if c in df.columns and c in obs.columns]
    if not shared:
        raise ValueError(f"none of {ids} is in both frames")
    add = [c for c in ids if c in obs.columns and c not in df.columns]
    return df.join(obs.select(shared[0], *add).distinct(), shared[0])


def time_filter(df: DataFrame, *, start: str = "recordtime", end: str | None = "recordtime_end", closed: str = "both", keep_null: bool = True) -> DataFrame:
    """Records inside [tmin, tmax], or intervals that overlap it when the frame has an end column (an end before its
    start counts as the start). A comparison with null keeps the row if keep_null."""
    t = F.col(start)
    if end and end in df.columns:
        stop = F.greatest(t, F.coalesce(F.col(end), t))
        test = F.when(t.isNotNull(), overlaps(t, stop, F.col("tmin"), F.col("tmax")))
    else:
        test = contains(t, F.col("tmin"), F.col("tmax"), closed)
    return df.where(F.coalesce(test, F.lit(keep_null)))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str) -> None:
    if duplicate_keys(df, key).head(1):
        raise ValueError(f"{key} isn't unique")


def add_static(obs: DataFrame, data: DataFrame, key: str, name: str, save_as: str | None = None, *, replace: str = "named") -> DataFrame:
    """obs with the columns of data (one row a key) named like the variable: `name` and `name_*` become `save_as` and
    `save_as_*`; other columns of data are refused. Columns of obs that have one of the new names are replaced; with replace="prefix", all
    whose names begin with save_as go."""
    target = save_as or name
    extra = [c for c in data.columns if c != key and c != name and not c.startswith(f"{name}_")]
    if extra:
        raise ValueError(f"unexpected columns {extra}")
    renamed = data.withColumnsRenamed({c: target + c.removeprefix(name) for c in data.columns if c != key})
    new = [c for c in renamed.columns if c != key]
    old = [c for c in obs.columns if c != key and c.startswith(target)] if replace == "prefix" else new
    return obs.drop(*old).join(renamed, key, "left")


def asof_join(
    main: DataFrame, ref: DataFrame, *, by: str, on: str, values: dict[str, str], strategy: str = "backward", tolerance: Offset | None = "1h", tiebreak: str | None = None, matched_time: str | None = None, slices: Offset | None = None
) -> DataFrame:
    """Each row of main with the values {column of ref: output name} of its as-of match, null where there is none.

    backward: the last row of ref at or before main's time; forward: the next at or after it; nearest: the closer of both,
    the earlier one of two at equal distance. A match exactly at the tolerance counts. Of rows of ref at the same time the
    one with the largest tiebreak is taken, or the smallest looking forward (without tiebreak: by value). Rows without
    key or time have no match; all rows of main stay.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown strategy {strategy!r}")
    added = {*values.values(), *([matched_time] if matched_time else [])}
    if clash := sorted(added & set(main.columns)):
        raise ValueError(f"columns {clash} already exist")
    packed = F.struct(*[F.col(c) for c in main.columns])
    match = F.struct(F.col(on).alias("time"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    break_by = F.struct(F.col(tiebreak)) if tiebreak else F.struct(*values)
    kinds = main.select(packed.alias("m")).schema["m"].dataType, ref.select(match.alias("r")).schema["r"].dataType
    none_main, none_ref = F.lit(None).cast(kinds[0]), F.lit(None).cast(kinds[1])
    none_break = F.lit(None).cast(ref.select(break_by.alias("b")).schema["b"].dataType)
    left = main.select(F.col(by).alias("k"), F.col(on).alias("t"), packed.alias("m"), none_ref.alias("r"), none_break.alias("b"), F.lit(True).alias("is_main"))
    right = ref.where(F.col(by).isNotNull() & F.col(on).isNotNull()).select(
        F.col(by).alias("k"), F.col(on).alias("t"), none_main.alias("m"), match.alias("r"), break_by.alias("b"), F.lit(False).alias("is_main")
    )
    both = left.unionByName(right)
    # in time order, rows of ref come before rows of main of the same time for the way back, after them for the way ahead
    # rows without a key have no match and are spread over many partitions instead of one
    both, keys = both.withColumn("spread", F.when(F.col("k").isNull(), F.pmod(F.xxhash64("t"), F.lit(1024))).otherwise(0)), ["k", "spread"]
    if slices is not None:
        both, keys = both.withColumn("slice", F.floor(micros(F.col("t")) / fixed_micros(slices))), [*keys, "slice"]
    back = Window.partitionBy(*keys).orderBy(F.col("t"), F.col("is_main"), F.col("b")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col("t"), F.col("is_main").desc(), F.col("b")).rowsBetween(0, Window.unboundedFollowing)
    searched = both
    if strategy != "forward":
        searched = searched.withColumn("before", F.last("r", ignorenulls=True).over(back))
    if strategy != "backward":
        searched = searched.withColumn("after", F.first("r", ignorenulls=True).over(ahead))
    rows = searched.where("is_main")
    if slices is not None:
        rows = _carried(rows, both, strategy)
    distance = lambda c: F.abs(micros(F.col("t")) - micros(F.col(c)["time"]))
    if strategy == "nearest":
        found = F.when(F.col("before").isNull() | (distance("after") < distance("before")), F.col("after")).otherwise(F.col("before"))
    else:
        found = F.col("before" if strategy == "backward" else "after")
    rows = rows.withColumn("found", F.when(F.col("k").isNotNull() & F.col("t").isNotNull(), found))
    if tolerance is not None:
        rows = rows.withColumn("found", F.when(distance("found") <= fixed_micros(tolerance), F.col("found")))
    out = [F.col("m")[c].alias(c) for c in main.columns] + [F.col("found")[f"v{i}"].alias(name) for i, name in enumerate(values.values())]
    return rows.select(*out, *([F.col("found")["time"].alias(matched_time)] if matched_time else []))


def _carried(rows: DataFrame, both: DataFrame, strategy: str) -> DataFrame:
    """rows with matches from other slices where their own slice has none."""
    place = F.struct("t", "b")
    ends = both.groupBy("k", "slice").agg(
        F.max_by("r", F.when(~F.col("is_main"), place)).alias("last_r"), F.min_by("r", F.when(~F.col("is_main"), place)).alias("first_r")
    )
    by_slice = Window.partitionBy("k").orderBy("slice")
    ends = ends.select(
        F.col("k").alias("ck"), F.col("slice").alias("cs"),
        F.last("last_r", ignorenulls=True).over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("first_r", ignorenulls=True).over(by_slice.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    joined = rows.join(ends, (F.col("k") == F.col("ck")) & (F.col("slice") == F.col("cs")), "left")
    if strategy != "forward":
        joined = joined.withColumn("before", F.coalesce("before", "earlier"))
    if strategy != "backward":
        joined = joined.withColumn("after", F.coalesce("after", "later"))
    return joined


def attach_asof_value(main: DataFrame, ref: DataFrame, name: str, *, by: str = "case_id", on: str = "recordtime", value: str = "value", strategy: str = "backward", tolerance: Offset | None = "1h", with_matched_time: bool = False, tiebreak: str | None = None, slices: Offset | None = None) -> DataFrame:
    """main with the as-of value of another series, and on request the time it was measured."""
    return asof_join(main, ref, by=by, on=on, values={value: name}, strategy=strategy, tolerance=tolerance, tiebreak=tiebreak, matched_time=f"{name}_{on}" if with_matched_time else None, slices=slices)


def remove_asof(main: DataFrame, ref: DataFrame, *, by: str = "case_id", on: str = "recordtime", strategy: str = "nearest", tolerance: Offset | None = "1d") -> DataFrame:
    """main without the rows that have a row of ref within the tolerance; doing it again changes nothing."""
    marked = asof_join(main, ref.select(by, on).withColumn("__hit", F.lit(True)), by=by, on=on, values={"__hit": "__hit"}, strategy=strategy, tolerance=tolerance)
    return marked.where(F.col("__hit").isNull()).drop("__hit")


def nearest_row(df: DataFrame, key: str, target: Column, *, time: str = "recordtime", before: Offset = "52w", after: Offset = "52w", tiebreak: list[str] | None = None) -> DataFrame:
    """For each key, the row closest to the target time within [target - before, target + after]; the earlier of two."""
    apart = micros(F.col(time)) - micros(target)
    near = df.where(apart.between(-fixed_micros(before), fixed_micros(after)))
    order = Window.partitionBy(key).orderBy(F.abs(apart), time, *(tiebreak or []))
    return near.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def closest_value(base: DataFrame, targets: DataFrame, key: str, values: list[str], *, target: str = "target", time: str = "recordtime", before: Offset = "52w", after: Offset = "52w", tiebreak: str | None = None) -> DataFrame:
    """One row for each of targets (key, target): the values of the record closest to it within the tolerance, null if none."""
    apart = micros(F.col(time)) - micros(F.col(target))
    rank = F.struct(F.abs(apart), F.col(time), *([F.col(tiebreak)] if tiebreak else []))
    near = base.where(F.col(time).isNotNull()).join(targets.select(key, target), key).where(apart.between(-fixed_micros(before), fixed_micros(after)))
    best = near.groupBy(key).agg(F.min_by(F.struct(*values), rank).alias("__best"))
    return targets.select(key).join(best, key, "left").select(key, *[F.col("__best")[v].alias(v) for v in values])


def same_instant(left: DataFrame, right: DataFrame, key: str, on: str = "recordtime") -> DataFrame:
    return left.join(right, [key, on])


_OPEN, _ODD = 63, 64


def _span(low: Column, high: Column, unit: int) -> dict[str, Column]:
    """The reach of [low, high] in microseconds, and its level: the smallest whose bins (unit * 2^level) are no shorter than it."""
    a, b = micros(low), micros(high)
    first, last = F.least(a, b), F.greatest(a, b)
    length = (last - first) / F.lit(float(unit))
    level = F.when(low.isNull() | high.isNull(), F.lit(_OPEN)).otherwise(F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(1.0)))), F.lit(0)).cast("int"))
    return {"__first": first, "__last": last, "__level": level}


def _binned(rows: DataFrame, others: list[int], unit: int) -> DataFrame:
    """rows, once for each bin that they touch (two at most) at their own level and at each higher one of the other side."""
    levels = F.array_distinct(F.concat(F.array("__level"), F.filter(F.lit(others).cast("array<int>"), lambda x: (x > F.col("__level")) & (x <= _OPEN))))
    at = rows.withColumn("__at", F.explode(levels))
    width = F.lit(unit) * F.expr("shiftleft(1L, least(__at, 40))")
    low, high = F.floor(F.col("__first") / width), F.floor(F.col("__last") / width)
    bins = F.when(F.col("__at") >= _OPEN, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(low, high))
    return at.withColumn("__bin", F.explode(bins))


def interval_join(intervals: DataFrame, windows: DataFrame, key: str, *, start: str = "recordtime", end: str = "recordtime_end", relations: tuple[str, ...] | None = None, unit: Offset | None = "1m") -> DataFrame:
    """Intervals with the windows (tmin, tmax) of the same key that they meet in one of the relations (default: any).

    Both sides are dealt into bins of time, at levels of which each has bins twice as long as the one before. An interval touches two bins
    at most at its own level and at any higher one, so short and long ones (open ones too) give few rows. Two that overlap meet at the
    level of the longer one, and are a pair only in the bin in which the later of them begins. A key with many of both
    doesn't form their product. unit is the length of the shortest bins; None compares all pairs of a key, which is right for keys that
    hold little.
    """
    test = overlaps(F.col(start), F.col(end), F.col("tmin"), F.col("tmax"), *([relations] if relations else []))
    if unit is None:
        return intervals.join(windows, key).where(test)
    short = fixed_micros(unit)
    left = intervals.withColumns(_span(F.col(start), F.col(end), short))
    right = windows.withColumns(_span(F.col("tmin"), F.col("tmax"), short))
    # an interval without start or end only meets windows that are open
    left = left.withColumn("__level", F.when(F.col("__level") == _OPEN, F.lit(_ODD)).otherwise(F.col("__level")))
    levels = [sorted(r[0] for r in side.select("__level").distinct().collect()) for side in (left, right)]  # 65 at most
    names = {c: f"{c}_w" for c in ("__first", "__last", "__level")}
    a = _binned(left.where(F.col("__level") < _ODD), levels[1], short)
    b = _binned(right, levels[0], short).withColumnsRenamed(names)
    pairs = a.join(b, [key, "__at", "__bin"])
    width = F.lit(short) * F.expr("shiftleft(1L, least(__at, 40))")
    once = (F.col("__at") >= _OPEN) | (F.col("__bin") == F.floor(F.greatest("__first", "__first_w") / width))
    found = pairs.where((F.col("__at") == F.greatest("__level", "__level_w")) & once & test).drop("__at", "__bin", "__first", "__last", "__level", *names.values())
    if _ODD not in levels[0]:
        return found
    odd = intervals.where(F.col(start).isNull() | F.col(end).isNull()).join(windows.where("tmin IS NULL OR tmax IS NULL"), key).where(test)
    return found.unionByName(odd)


def pivot_hierarchy(nodes: DataFrame, parent: str, suffixes: list[str], optional: list[str] | None = None, *, keep: list[str] | None = None) -> DataFrame:
    """One row for each parent row of nodes (id, parent_id, name, value, ...) called `parent`, with one column for each suffix: the
    value of its child called parent + suffix (the largest of several). A parent without one of the required children is
    left out; children of value null are there all the same."""
    optional, keep = optional or [], keep or []
    parents = nodes.where(F.col("name") == parent).select("id", *keep)
    children = nodes.where(F.col("name").isin(*[parent + s for s in [*suffixes, *optional]]))
    is_child = lambda s: F.col("name") == parent + s
    values = [F.max(F.when(is_child(s), F.col("value"))).alias(s) for s in [*suffixes, *optional]]
    there = [F.count_if(is_child(s)).alias(f"__has_{s}") for s in suffixes]
    pivoted = children.groupBy(F.col("parent_id").alias("id")).agg(*values, *there)
    for s in suffixes:
        pivoted = pivoted.where(F.col(f"__has_{s}") > 0)
    return parents.join(pivoted.drop(*[f"__has_{s}" for s in suffixes]), "id", "inner" if suffixes else "left")


def map_prefix(df: DataFrame, column: str, mapping: DataFrame, length: int, name: str) -> DataFrame:
    """df with the sorted distinct targets of mapping (prefix, target) for the column's first characters; mapping is a
    lookup table of fixed size, and Spark decides how to join it."""
    targets = mapping.groupBy("prefix").agg(F.array_sort(F.collect_set("target")).alias(name))
    return df.withColumn("prefix", F.substring(F.col(column).cast("string"), 1, length)).join(targets, "prefix", "left").drop("prefix")


def relative_times(df: DataFrame, obs: DataFrame, key: str, t_min: str, columns: tuple[str, ...] = ("recordtime", "recordtime_end")) -> DataFrame:
    """Adds `<column>_relative`: seconds since the observation's start."""
    joined = df.join(obs.select(key, F.col(t_min).alias("__t0")), key, "left")
    add = {f"{c}_relative": (micros(F.col(c)) - micros(F.col("__t0"))) / F.lit(1e6) for c in columns if c in df.columns}
    return joined.withColumns(add).drop("__t0")


def absolute_times(df: DataFrame, obs: DataFrame, key: str, seconds: str, name: str = "recordtime", t_min: str = "icu_admission") -> DataFrame:
    """The opposite: the start (1900-01-01 where unknown) plus seconds."""
    joined = df.join(obs.select(key, F.col(t_min).alias("__t0")), key, "left")
    start = F.coalesce(F.col("__t0"), F.lit("1900-01-01").cast("timestamp_ntz"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(seconds).cast("decimal(18,6)"))
    return joined.withColumn(name, start + step).drop("__t0")


def values_at(series: DataFrame, other: DataFrame, key: str, on: str, name: str, tolerance: Offset, ratio_of: str = "value") -> DataFrame:
    """A ratio series: series' value over the other's last value within the tolerance, null where that is missing or zero."""
    paired = attach_asof_value(series, other, name, by=key, on=on, tolerance=tolerance)
    return paired.withColumn("ratio", F.try_divide(F.col(ratio_of), F.col(name)))
