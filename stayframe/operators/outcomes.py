"""Event-free days in a follow-up window, with death, censoring, merging, recovery and presence rules.

Blocks of 24 hours are counted from time zero. An episode is joined to its observation, clipped, and becomes the bits of the days that it
touches; the bits of one observation are joined by a bitwise or, before anything is shuffled. What is counted are bits, so an
observation may have any number of episodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import MICROS, Offset, TimeWindow, fixed_micros, micros, time_difference
from .intervals import merge_episodes

DEATH_RULES = ("zero_if_dead", "negative_if_death", "alive_days")
_DAY = MICROS["d"]


def _inside_horizon(intervals: DataFrame, bounds: DataFrame, key: str, start: str, end: str, open_end: bool) -> DataFrame:
    """(key, n, valid, s, e): intervals that overlap (t0, end), in microseconds from t0, with ends clipped."""
    joined = intervals.select(key, micros(F.col(start)).alias("s"), micros(F.col(end)).alias("e")).join(bounds.select(key, "z", "h", "n", "valid"), key)
    stop = F.coalesce("e", "h") if open_end else F.col("e")
    clipped = joined.where("s IS NOT NULL").withColumn("e", F.when(stop.isNotNull() & F.col("h").isNotNull(), F.least(stop, F.col("h"))))
    return clipped.where("e > z AND s < h").select(key, "n", "valid", (F.col("s") - F.col("z")).alias("s"), (F.col("e") - F.col("z")).alias("e"))


def _day_bits(met: DataFrame, key: str, first: Column, beyond: Column, name: str) -> DataFrame:
    """(key, valid, word, bits called name, episodes, last): the days from first to before beyond, 64 to a word. An interval without a day
    has a word of its own, so that it is counted."""
    spans = met.withColumns({"a": F.greatest(first, F.lit(0)).cast("int"), "b": (F.least(beyond, F.col("n")) - 1).cast("int")})
    words = F.when(F.col("b") < F.col("a"), F.array(F.lit(-1))).otherwise(F.sequence(F.floor(F.col("a") / 64).cast("int"), F.floor(F.col("b") / 64).cast("int")))
    each = spans.select("*", F.posexplode(words).alias("place", "word"))
    bits = F.expr("IF(word < 0, 0L, shiftleft(-1L, greatest(a - word * 64, 0)) & shiftrightunsigned(-1L, 63 - least(b - word * 64, 63)))")
    return each.select(key, "valid", "word", bits.alias(name), (F.col("place") == 0).cast("int").alias("one"), "e")


def free_days(
    obs: DataFrame, episodes: DataFrame, key: str, window: TimeWindow, *, method: str = "last_event", death_rule: str = "zero_if_dead", death: str | None = None,
    censor: str | None = None, recovery: Offset | None = None, presence: DataFrame | None = None, merge_gap: Offset | None = None,
    start: str = "recordtime", end: str = "recordtime_end", name: str = "free_days", with_detail: bool = False,
) -> DataFrame:
    """(key, name): whole 24-hour blocks of the window without the event, for every observation.

    method: `last_event` counts the blocks after the last end; `day_grid` counts each block that no episode overlaps (with
    recovery, none that ended less than that before it). death_rule: a death in the window makes the count 0 or -1, or only
    blocks survived count. A window that reaches past `censor` gives null, whatever else. merge_gap joins episodes first.
    With presence, a block must also be observed; an open presence lasts to the window's end. Episodes without start or end
    are left out. A window that isn't positive has 0 blocks. with_detail adds the struct `<name>_detail`.
    """
    if method not in ("last_event", "day_grid") or death_rule not in DEATH_RULES:
        raise ValueError(f"unknown method or death rule: {method}, {death_rule}")
    if merge_gap is not None:
        episodes = merge_episodes(episodes, key, start, end, merge_gap)
    low, high = window.bounds()
    none = F.lit(None).cast("timestamp_ntz")
    dead = F.col(death).cast("timestamp_ntz") if death and death in obs.columns else none
    censored = F.coalesce(F.col(censor) < high, F.lit(False)) if censor and censor in obs.columns else F.lit(False)
    bounds = obs.select(key, low.alias("t0"), high.alias("t1"), dead.alias("death"), censored.alias("censored"))
    bounds = bounds.withColumns({"z": micros(F.col("t0")), "h": micros(F.col("t1")), "d": micros(F.col("death"))})
    bounds = bounds.withColumn("n", F.greatest(F.coalesce(F.round((F.col("h") - F.col("z")) / F.lit(float(_DAY))), F.lit(0)), F.lit(0)).cast("int"))
    survived = F.when(F.col("d").isNull(), F.col("n")).otherwise(F.greatest(F.floor((F.col("d") - F.col("z")) / _DAY), F.lit(0)))
    bounds = bounds.withColumn("valid", (F.least("n", survived) if death_rule == "alive_days" else F.col("n")).cast("int"))
    wait = fixed_micros(recovery) if recovery and method == "day_grid" else 0
    met = _inside_horizon(episodes.where(F.col(end).isNotNull()), bounds, key, start, end, False)
    begin = F.floor(F.col("s") / _DAY) if method == "day_grid" else F.lit(0)
    nothing = F.lit(0).cast("long")
    parts = _day_bits(met, key, begin, F.ceil((F.col("e") + wait) / _DAY), "blocked").withColumn("seen", nothing)
    if presence is not None:
        there = _inside_horizon(presence, bounds, key, start, end, True)
        shown = _day_bits(there, key, F.floor(F.col("s") / _DAY), F.ceil(F.col("e") / _DAY), "seen").withColumn("blocked", nothing)
        parts = parts.unionByName(shown.withColumns({"one": F.lit(0), "e": F.lit(None).cast("long")}))
    by_word = parts.groupBy(key, "word").agg(F.bit_or("blocked").alias("blocked"), F.bit_or("seen").alias("seen"), F.sum("one").alias("episodes"), F.max("e").alias("last"), F.max("valid").alias("valid"))
    counted = F.expr("CASE WHEN word < 0 OR valid <= word * 64 THEN 0L ELSE shiftrightunsigned(-1L, 63 - least(valid - 1 - word * 64, 63)) END")
    bit = lambda x: F.sum(F.bit_count(F.expr(x).bitwiseAND(counted)))
    by_key = by_word.groupBy(key).agg(bit("blocked").alias("n_blocked"), bit("seen & ~blocked").alias("n_free_seen"), bit("seen | blocked").alias("n_known"), F.sum("episodes").alias("episodes"), F.max("last").alias("last"))
    rows = bounds.join(by_key, key, "left").fillna(0, ["n_blocked", "n_free_seen", "n_known", "episodes"])
    count = F.col("valid") - F.col("n_blocked") if presence is None else F.col("n_free_seen")
    died = F.coalesce(F.col("d") <= F.col("h"), F.lit(False))
    if death_rule != "alive_days":
        count = F.when(died, F.lit(-1 if death_rule == "negative_if_death" else 0)).otherwise(count)
    score = F.when(~F.col("censored"), count).cast("int").alias(name)
    if not with_detail:
        return rows.select(key, score)
    last = F.col("last")
    ongoing = F.coalesce(last >= F.col("h") - F.col("z"), F.lit(False))
    kind = F.when(F.col("censored"), "censored").when(died, "died").when(ongoing, "ongoing_at_horizon").otherwise("liberated")
    elapsed = F.coalesce((last / 1_000_000).cast("long") / F.lit(86400.0), F.lit(0.0))
    detail = F.struct(
        F.when(kind == "liberated", elapsed).alias("event_time_days"), kind.alias("event_type"), died.alias("died_in_horizon"), F.col("censored").alias("censored"),
        F.col("episodes").cast("int").alias("n_episodes"), (F.lit(0) if presence is None else F.col("valid") - F.col("n_known")).cast("int").alias("unobserved_days"),
    )
    return rows.select(key, score, detail.alias(f"{name}_detail"))


def stay_length_days(start: str, end: str) -> Column:
    return time_difference(F.col(end), F.col(start), "d", whole=False)
