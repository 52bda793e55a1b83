"""Time arithmetic on columns: offsets, windows, differences and interval relations.

Timestamps are wall-clock values (timestamp_ntz works best); an open window bound is a null column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed-length units in microseconds; months, quarters and years follow the calendar.
MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
MONTHS = {"mo": 1, "q": 3, "y": 12}
_PART = re.compile(r"(\d+)(ns|us|ms|mo|s|m|h|d|w|q|y)")

Offset = str | timedelta


def parse_offset(text: Offset) -> tuple[int, int]:
    """(months, microseconds) of an offset such as "3d12h", "-2h" or "+1mo"; nanoseconds are cut off."""
    if isinstance(text, timedelta):
        return 0, round(text / timedelta(microseconds=1))
    body = text.strip()
    sign = -1 if body.startswith("-") else 1
    body = body.lstrip("+-")
    parts = _PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"not an offset: {text!r}")
    nanos = sum(int(n) for n, u in parts if u == "ns")
    months = sum(int(n) * MONTHS[u] for n, u in parts if u in MONTHS)
    return sign * months, sign * (sum(int(n) * MICROS[u] for n, u in parts if u in MICROS) + nanos // 1000)


def fixed_micros(text: Offset) -> int:
    """Microseconds of an offset without calendar units."""
    months, micros = parse_offset(text)
    if months:
        raise ValueError(f"{text!r} has no fixed length")
    return micros


def _interval(micros: int) -> Column:
    whole, rest = divmod(abs(micros), 1_000_000)
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(whole + rest / 1_000_000).cast("decimal(18,6)"))
    return seconds if micros >= 0 else -seconds


def offset(time: Column, *steps: Offset) -> Column:
    """time shifted by each offset in turn."""
    for step in steps:
        months, micros = parse_offset(step)
        if months:
            time = time + F.make_ym_interval(F.lit(0), F.lit(months))
        if micros:
            time = time + _interval(micros)
    return time


def micros(time: Column) -> Column:
    """Microseconds since 1970 as long, the same for wall-clock timestamps in every session time zone."""
    day = F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    ntz = time.cast("timestamp_ntz")
    inside = (F.hour(ntz) * 3600 + F.minute(ntz) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ntz) * 1_000_000).cast("long")
    return day * MICROS["d"] + inside


def seconds_between(later: Column, earlier: Column) -> Column:
    """later - earlier in seconds, with fractions."""
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def time_difference(later: Column, earlier: Column, unit: str = "s", *, whole: bool = True) -> Column:
    """Signed difference: seconds are cut off towards zero, then divided by the unit; whole rounds down."""
    per = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[unit]
    seconds = F.expr("bigint(0)") + ((micros(later) - micros(earlier)) / F.lit(1_000_000)).cast("long")
    return F.floor(seconds / per) if whole else seconds / F.lit(float(per))


def truncate_to_day(time: Column, day_start: Offset = "0h") -> Column:
    """The start of the day that holds time, for days that begin day_start after midnight."""
    shift = fixed_micros(day_start)
    back = time - _interval(shift) if shift else time
    day = F.date_trunc("DAY", back).cast("timestamp_ntz")
    return day + _interval(shift) if shift else day


def parse_timestamp(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")) -> Column:
    """The first format that fits decides; text that fits none is null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def utc_to_local(time: Column, zone: str) -> Column:
    return F.from_utc_timestamp(time, zone).cast("timestamp_ntz")


def clip_timestamps(df, low: str = "1677-09-22", high: str = "2262-04-11"):
    """All timestamp and date columns of df clamped to [low, high]; nulls stay."""
    clamp = lambda c, t: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(high).cast(t)), F.lit(low).cast(t))).alias(c)
    return df.select(*[clamp(c, t) if t in ("timestamp", "timestamp_ntz", "date") else F.col(c) for c, t in df.dtypes])


@dataclass(frozen=True)
class Anchor:
    """A point in time on each row: a column, or a literal, shifted by offsets."""

    base: str | Column
    offsets: tuple[Offset, ...] = ()

    def column(self) -> Column:
        base = F.col(self.base) if isinstance(self.base, str) else self.base
        return offset(base, *self.offsets)

    def shifted(self, step: Offset) -> Anchor:
        return Anchor(self.base, (*self.offsets, step))

    def needs(self) -> set[str]:
        return {self.base} if isinstance(self.base, str) else set()

    def identity(self) -> tuple:
        """Equal for anchors that are sure to be the same; a Column is only sure to be itself."""
        return (self.base if isinstance(self.base, str) else id(self.base), *map(str, self.offsets))


def anchor(what: str | tuple | Column | Anchor | None) -> Anchor | None:
    """An anchor from a column name, (column name, offset), a Column or null for an open bound."""
    if what is None or isinstance(what, Anchor):
        return what
    return Anchor(what[0], tuple(what[1:])) if isinstance(what, tuple) else Anchor(what)


@dataclass(frozen=True)
class TimeWindow:
    """A pair of anchors; a missing or null bound is open."""

    t_min: Anchor | None = None
    t_max: Anchor | None = None

    @staticmethod
    def between(t_min=None, t_max=None) -> TimeWindow:
        return TimeWindow(anchor(t_min), anchor(t_max))

    @staticmethod
    def from_level(level) -> TimeWindow:
        return TimeWindow.between(level.t_min, level.t_max)

    @staticmethod
    def after(start, duration: Offset) -> TimeWindow:
        first = anchor(start)
        return TimeWindow(first, first.shifted(duration))

    @staticmethod
    def days(start: str, number: int, day_start: Offset = "0h") -> TimeWindow:
        """Whole days from the day that holds start."""
        first = truncate_to_day(F.col(start), day_start)
        return TimeWindow(Anchor(first), Anchor(first, (f"{number}d",)))

    def widened(self, before: Offset | None = None, after: Offset | None = None) -> TimeWindow:
        low = self.t_min.shifted(before) if self.t_min and before else self.t_min
        return TimeWindow(low, self.t_max.shifted(after) if self.t_max and after else self.t_max)

    def bounds(self) -> tuple[Column, Column]:
        open_end = F.lit(None).cast("timestamp_ntz")
        return (self.t_min.column() if self.t_min else open_end, self.t_max.column() if self.t_max else open_end)

    def duration(self) -> Column:
        """The length in microseconds; null where a bound is open."""
        low, high = self.bounds()
        return micros(high.cast("timestamp_ntz")) - micros(low.cast("timestamp_ntz"))

    def has_null_bound(self) -> Column:
        low, high = self.bounds()
        return low.isNull() | high.isNull()

    def ends_in_year_9999(self) -> Column:
        """Whether a bound is a placeholder for "never"; an open bound isn't."""
        return F.coalesce(*[F.when(F.year(b.cast("timestamp_ntz")) == 9999, F.lit(True)) for b in self.bounds()], F.lit(False))

    def is_reversed(self) -> Column:
        """Whether the window ends before it begins; null where a bound is open."""
        low, high = self.bounds()
        return low.cast("timestamp_ntz") > high.cast("timestamp_ntz")

    def needs(self) -> set[str]:
        return (self.t_min.needs() if self.t_min else set()) | (self.t_max.needs() if self.t_max else set())

    def identity(self) -> tuple:
        return tuple(a and a.identity() for a in (self.t_min, self.t_max))

    def fits(self, columns) -> bool:
        """Whether all columns that the anchors need are there."""
        return self.needs() <= set(columns)


def contains(time: Column, low: Column, high: Column, closed: str = "both") -> Column:
    """Whether time lies in the window; a null bound is open, a null time gives null."""
    above = time >= low if closed in ("both", "left") else time > low
    below = time <= high if closed in ("both", "right") else time < high
    return F.when(time.isNotNull(), (low.isNull() | above) & (high.isNull() | below))


def midpoint(low: Column, high: Column) -> Column:
    half = ((micros(high) - micros(low)) / F.lit(2)).cast("long")
    return low + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (half / F.lit(1_000_000)).cast("decimal(18,6)"))


RELATIONS = ("CONTAINED", "OVERLAPS_LEFT", "OVERLAPS_RIGHT", "COVERS_WINDOW")


def relation(start: Column, end: Column, low: Column, high: Column) -> Column:
    """How the interval [start, end] meets the window [low, high]: one of RELATIONS, null if it doesn't."""
    starts_in, ends_in = low.isNull() | (start >= low), high.isNull() | (end <= high)
    meets = (high.isNull() | (start <= high)) & (low.isNull() | (end >= low))
    return F.when(
        meets,
        F.when(starts_in & ends_in, F.lit(RELATIONS[0])).when(ends_in, F.lit(RELATIONS[1])).when(starts_in, F.lit(RELATIONS[2])).otherwise(F.lit(RELATIONS[3])),
    )


def overlaps(start: Column, end: Column, low: Column, high: Column, relations: tuple[str, ...] = RELATIONS) -> Column:
    return F.coalesce(relation(start, end, low, high).isin(*relations), F.lit(False))


def within_date_window(start: Column, end: Column, low: Column, high: Column) -> Column:
    """start from low on and end up to high; missing values pass."""
    return F.coalesce(start >= low, F.lit(True)) & F.coalesce(end <= high, F.lit(True))
