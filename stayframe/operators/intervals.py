"""Gap-and-island merging, interval ends, rolling values, rate-of-change cleaning and interval bucketing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import Offset, fixed_micros, micros, offset
from ..tables import written
from .slices import Slices

MAX_BUCKETS = 100_000


def _islands(rows: Slices, starts: Column) -> DataFrame:
    """Adds `__island`: the running number of rows on which `starts` holds."""
    return rows.with_column("__new", F.coalesce(starts, F.lit(True)).cast("int")).running_sum("__new", "__island").df


def merge_consecutive_stays(df: DataFrame, key: str, start: str, end: str, *, hours: float = 24, ward: str | None = None, status: str | None = None, lists: list[str] | None = None, tiebreak: list[str] | None = None, reference: str = "previous", slices: Offset | None = None) -> DataFrame:
    """Stays of a key joined while the gap to the previous stay's end is below `hours` (and, with ward, the ward is the same).

    A missing previous end begins a new stay. reference="furthest" measures from the furthest end so far. Returns key, stay
    number, first start, last end (that of the last stay), last status, and the lists in order. slices deals a key's rows out by
    time (see Slices); the result is the same.
    """
    rows = Slices(df, key, start, [start, *(tiebreak or [])], slices)
    rows = rows.previous({"__prior": end, **({"__ward": ward} if ward else {})}) if reference == "previous" else rows.furthest(end, "__prior")
    if ward and reference != "previous":
        rows = rows.previous({"__ward": ward})
    new = F.col("__prior").isNull() | (micros(F.col(start)) - micros(F.col("__prior")) >= int(hours * 3_600_000_000))
    if ward:
        new = new | ~F.col(ward).eqNullSafe(F.col("__ward"))
    stays = _islands(rows, new)
    rank = F.struct(start, *(tiebreak or []))
    packed = F.array_sort(F.collect_list(F.struct(rank.alias("o"), *[F.col(c).alias(f"v_{c}") for c in lists or []])))
    grouped = stays.groupBy(key, F.col("__island").alias("stay")).agg(
        F.min(start).alias(start),
        F.max_by(F.struct(end), rank)[end].alias(end),
        *([F.max_by(F.struct(status), rank)[status].alias(status)] if status else []),
        *([packed.alias("__lists")] if lists else []),
    )
    if not lists:
        return grouped
    return grouped.select(*[c for c in grouped.columns if c != "__lists"], *[F.col("__lists")[f"v_{c}"].alias(c) for c in lists])


def merge_episodes(df: DataFrame, key: str, start: str, end: str, gap: Offset = "0h", *, slices: Offset | None = None) -> DataFrame:
    """The union of intervals per key, bridging gaps of at most `gap`; measured from the furthest end so far, so nested
    and overlapping intervals are safe. Intervals without start or end are left out. slices: see Slices."""
    whole = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(key, start, end)
    reached = Slices(whole, key, start, [start, end], slices).furthest(end, "__reach")
    islands = _islands(reached, F.col(start) > offset(F.col("__reach"), gap))
    return islands.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def merge_sessions(df: DataFrame, key: str, start: str, end: str, value: str, *, gap: Offset = "30m", tiebreak: list[str] | None = None, slices: Offset | None = None) -> DataFrame:
    """Sessions joined while the gap to the previous row's end is below `gap`: value and start of the first, end of the last."""
    prior = Slices(df, key, start, [start, *(tiebreak or [])], slices).previous({"__prior": end})
    islands = _islands(prior, ~(micros(F.col(start)) - micros(F.col("__prior")) < fixed_micros(gap)))
    rank = F.struct(start, *(tiebreak or []))
    return islands.groupBy(key, "__island").agg(
        F.min_by(F.struct(value), rank)[value].alias(value), F.min(start).alias(start), F.max_by(F.struct(end), rank)[end].alias(end)
    ).drop("__island")


def sequential_id(df: DataFrame, key: str, order: list[str], name: str, *, slices: Offset | None = None) -> DataFrame:
    """`<key>_1`, `<key>_2`, ... in the given order, whose first column is a time if there are slices."""
    numbered = Slices(df, key, order[0], order, slices).with_column("__one", F.lit(1)).running_sum("__one", "__n").df
    return numbered.withColumn(name, F.concat_ws("_", F.col(key).cast("string"), F.col("__n").cast("string"))).drop("__one", "__n")


def first_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def impute_end(df: DataFrame, key: str, start: str, end: str, *, tiebreak: list[str] | None = None, max_gap: Offset | None = None, beyond: str = "drop", slices: Offset | None = None) -> DataFrame:
    """The next record's start as end; a key's last record has none and goes. Longer gaps than max_gap drop the row or cap its end."""
    following = Slices(df, key, start, [start, *(tiebreak or [])], slices).following({"__next": start}).df
    ended = following.withColumn(end, F.col("__next")).drop("__next").where(F.col(end).isNotNull())
    if max_gap is None:
        return ended
    limit = offset(F.col(start), max_gap)
    return ended.where(F.col(end) <= limit) if beyond == "drop" else ended.withColumn(end, F.least(F.col(end), limit))


def change_blocks(df: DataFrame, key: str, column: str, order: list[str], name: str = "block", *, slices: Offset | None = None) -> DataFrame:
    """Number (from 0) of the run of equal values in which each row lies. The first column of order is a time if there are slices."""
    rows = Slices(df, key, order[0], order, slices).previous({"__was": column, "__there": F.lit(True)})
    changed = ~F.col(column).eqNullSafe(F.col("__was")) & F.col("__there").isNotNull()
    return rows.with_column("__change", changed.cast("int")).running_sum("__change", name).df.drop("__change", "__was", "__there")


def rolling_mean(df: DataFrame, key: str, time: str, value: str, *, length: Offset = "6h", name: str = "rolling", slices: Offset | None = None) -> DataFrame:
    """Mean over the trailing interval (t - length, t]. With slices, no shorter than length, each row also stands in the slice after its
    own, for the rows there to look back at."""
    timed, back = df.withColumn("__us", micros(F.col(time))), fixed_micros(length)
    if slices is None:
        w = Window.partitionBy(key).orderBy("__us").rangeBetween(-back + 1, 0)
        return timed.withColumn(name, F.avg(value).over(w)).drop("__us")
    if fixed_micros(slices) < back:
        raise ValueError("slices must not be shorter than the rolling interval")
    own = F.floor(F.col("__us") / fixed_micros(slices))
    places = F.when(own.isNull(), F.array(own)).otherwise(F.array(own, own + 1))  # rows without a time only look at each other
    twice = timed.withColumn("__slice", F.explode(places)).withColumn("__own", F.col("__slice").eqNullSafe(own))
    w = Window.partitionBy(key, "__slice").orderBy("__us").rangeBetween(-back + 1, 0)
    return twice.withColumn(name, F.avg(value).over(w)).where("__own").drop("__us", "__slice", "__own")


def within_first(df: DataFrame, key: str, time: str, length: Offset = "24h") -> DataFrame:
    """Records up to `length` after the key's own first record."""
    first = df.withColumn("__first", F.min(time).over(Window.partitionBy(key)))
    return first.where(F.col(time) <= offset(F.col("__first"), length)).drop("__first")


_STATE = "struct<us:bigint,v:double>"


def _kept(rows: Column, begin: Column, max_rate: float) -> Column:
    """The fold of one piece, from the point kept last before it (null: none): the point kept last, and (place, rate) of all kept."""
    start = F.struct(begin.alias("last"), F.expr("CAST(array() AS array<struct<i:bigint,rate:double>>)").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        last = state["last"]
        later = (x["us"] > last["us"]) & x["v"].isNotNull() & last["v"].isNotNull()
        rate = F.when(later, (x["v"] - last["v"]) / ((x["us"] - last["us"]) / F.lit(3_600_000_000.0)))
        keep = last.isNull() | F.coalesce(F.abs(rate) < max_rate, F.lit(False))
        point = F.struct(x["us"].alias("us"), x["v"].alias("v"))
        return F.when(keep, F.struct(point.alias("last"), F.array_append(state["kept"], F.struct(x["i"].alias("i"), rate.alias("rate"))).alias("kept"))).otherwise(state)

    return F.aggregate(rows, start, step)


def rate_of_change_filter(df: DataFrame, key: str, time: str, value: str, max_rate: float, *, tiebreak: str | None = None, slices: Offset = "1d", piece: int = 256) -> DataFrame:
    """Drops each point whose change per hour since the last point kept is max_rate or more, or whose time is no later, and
    reports the rate of kept points (null for the first).

    What is kept depends on what was kept before. A key's points are numbered (in slices of time, so that a key may hold any share
    of the rows) and cut into pieces of `piece` points. Every piece is folded from nothing; a piece that began with another point than
    the one that the piece before it now ends with is folded again, until none is. Two folds of a piece soon keep the same points, so
    two rounds mostly do, and keys of one piece need none. Only one point a piece meets in a task.
    """
    order = [time, *([tiebreak] if tiebreak else []), value]
    slim = df.select(key, *order[:-1], F.col(value).cast("double").alias(value)).withColumn("__one", F.lit(1))
    numbered = Slices(slim, key, time, order, slices).running_sum("__one", "__i").df
    point = F.struct(F.col("__i").alias("i"), micros(F.col(time)).alias("us"), F.col(value).alias("v"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    of_piece = numbered.groupBy(key, F.floor((F.col("__i") - 1) / piece).alias("__piece")).agg(F.array_sort(F.collect_list(point)).alias("rows"))
    none = F.lit(None).cast(_STATE)
    pieces = written(of_piece.withColumn("last", _kept(F.col("rows"), none, max_rate)["last"]), "pieces")
    first, later = pieces.where("__piece = 0").withColumn("begin", none), pieces.where("__piece > 0").drop("last")

    def met(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """left with the columns that right has for its piece."""
        other = right.withColumnsRenamed({key: "__k", "__piece": "__p"})
        joined = left.join(other, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__piece") == F.col("__p")), how)
        return joined.drop("__k", "__p")

    state, found = pieces.select(key, "__piece", none.alias("begin"), "last"), first
    if later.head(1):
        before = F.lag("last").over(Window.partitionBy(key).orderBy("__piece"))
        while True:
            wrong = written(state.select(key, "__piece", "begin", before.alias("now")).where("NOT begin <=> now").select(key, "__piece", F.col("now").alias("begin")), "wrong")
            if not wrong.head(1):
                break
            again = met(later, wrong, "inner").select(key, "__piece", "begin", _kept(F.col("rows"), F.col("begin"), max_rate)["last"].alias("last"))
            state = written(met(state, wrong.select(key, "__piece"), "left_anti").unionByName(again), "state")
        found = first.drop("last").unionByName(met(later, state.select(key, "__piece", "begin"), "inner").select(*first.drop("last").columns))
    kept = _kept(F.col("rows"), F.col("begin"), max_rate)["kept"]
    row = lambda k: F.get(F.col("rows"), (k["i"] - F.col("rows")[0]["i"]).cast("int"))
    each = found.select(key, F.explode(F.transform(kept, lambda k: F.struct(row(k).alias("row"), k["rate"].alias("rate")))).alias("x"))
    return each.select(key, *[F.col(f"x.row.c{i}").alias(c) for i, c in enumerate(order)], F.col("x.rate").alias("rate"))


def interval_bucket(
    df: DataFrame, key: str, *, start: str = "recordtime", end: str | None = "recordtime_end", value: str = "value", tmin: str | None = None, tmax: str | None = None,
    t0: str | None = None, every: Offset | None = None, aggregate: Callable[[Column], Column] = F.sum, missing: str = "drop",
    max_gap: Offset | None = None, beyond: str = "drop", empty_length: Offset | None = None, keep_empty: bool = False, tiebreak: list[str] | None = None, most: int | None = MAX_BUCKETS,
) -> DataFrame:
    """Interval values dealt out over a time grid, in proportion to the overlap.

    Intervals are clipped to [tmin, tmax], and their value with them. With `every`, buckets lie on the calendar grid, or on
    one through t0. With t0 alone, an interval is split there, and `side` is -1 before and 1 after. With neither, there is one
    sum a key. end=None takes the next record's start. missing="keep" reads a null tmin, tmax as open. Intervals without length
    are left out unless empty_length gives them one; overlaps of no length are, unless keep_empty. Rows: key, bucket columns,
    value, first_start, last_end, seconds, and buckets_from_t0. An interval that reaches over more than `most` buckets is an error,
    since it mostly comes from a wrong date; most=None deals out any, in runs of MAX_BUCKETS buckets, so that no row holds them all.
    """
    if end is None:
        end = "__end"
        df = impute_end(df, key, start, end, tiebreak=tiebreak, max_gap=max_gap, beyond=beyond)
    us = lambda c: micros(F.col(c)) if c else F.lit(None).cast("long")
    rows = df.select(F.col(key), us(start).alias("s"), us(end).alias("e"), F.col(value).cast("double").alias("v"), us(tmin).alias("lo"), us(tmax).alias("hi"), us(t0).alias("z"))
    needed = [key, "s", "e", "v", *([c for c, given in (("lo", tmin), ("hi", tmax), ("z", t0)) if given] if missing == "drop" else [])]
    rows = rows.dropna(subset=needed)
    if empty_length:
        rows = rows.withColumn("e", F.when(F.col("e") == F.col("s"), F.col("s") + fixed_micros(empty_length)).otherwise(F.col("e")))
    rows = rows.where("e > s AND (hi IS NULL OR s < hi) AND (lo IS NULL OR e > lo)")
    rows = rows.withColumns({"cs": F.greatest("s", F.coalesce("lo", "s")), "ce": F.least("e", F.coalesce("hi", "e"))}).where("ce > cs")
    rows = rows.withColumn("cv", F.col("v") * (F.col("ce") - F.col("cs")) / (F.col("e") - F.col("s")))
    if every:
        step = fixed_micros(every)
        origin = F.coalesce(F.col("z"), F.lit(0)) if t0 else F.lit(0)
        first, last = F.floor((F.col("cs") - origin) / step), F.floor((F.col("ce") - origin) / step)
        if most is not None:
            last = F.when(last - first > most, F.raise_error(F.lit("an interval reaches over too many buckets")).cast("bigint")).otherwise(last)
        runs = rows.withColumns({"first": first, "last": last}).withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("last") - F.col("first")) / MAX_BUCKETS))))
        begin = F.col("first") + F.col("run") * MAX_BUCKETS
        parts = runs.withColumn("n", F.explode(F.sequence(begin, F.least(F.col("last"), begin + (MAX_BUCKETS - 1)))))
        parts = parts.withColumns({"bs": F.col("n") * step + origin, "be": (F.col("n") + 1) * step + origin})
        groups = ["bs", "be", *(["z"] if t0 else [])]
    elif t0:
        split = (F.col("cs") < F.col("z")) & (F.col("ce") > F.col("z"))
        pair = lambda a, b: F.struct(a.alias("bs"), b.alias("be"))
        halves = F.when(split, F.array(pair(F.col("cs"), F.col("z")), pair(F.col("z"), F.col("ce")))).otherwise(F.array(pair(F.col("cs"), F.col("ce"))))
        parts = rows.withColumn("h", F.explode(halves)).select("*", "h.bs", "h.be").withColumn("side", F.when(F.col("bs") < F.col("z"), -1).otherwise(1))
        groups = ["side"]
    else:
        parts, groups = rows.withColumns({"bs": F.col("cs"), "be": F.col("ce")}), []
    parts = parts.withColumns({"os": F.greatest("cs", "bs"), "oe": F.least("ce", "be")})
    if not keep_empty:
        parts = parts.where("oe > os")
    parts = parts.withColumn("ov", F.col("cv") * (F.col("oe") - F.col("os")) / (F.col("ce") - F.col("cs")))
    out = parts.groupBy(key, *groups).agg(F.min("os").alias("os"), F.max("oe").alias("oe"), aggregate(F.col("ov")).alias("value"))
    time = lambda c: F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col(c) / F.lit(1_000_000)).cast("decimal(18,6)"))
    extra = []
    if every:
        extra = [time("bs").alias("bucket_start"), time("be").alias("bucket_end"), *([((F.col("bs") - F.col("z")) / F.lit(float(step))).alias("buckets_from_t0")] if t0 else [])]
    elif t0:
        extra = [F.col("side")]
    return out.select(key, *extra, "value", time("os").alias("first_start"), time("oe").alias("last_end"), F.floor((F.col("oe") - F.col("os")) / 1_000_000).alias("seconds"))
