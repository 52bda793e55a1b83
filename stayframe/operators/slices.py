"""Scans along time that don't need all rows of a key together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import Offset, fixed_micros, micros


class Slices:
    """Rows of df by key in the order of `order`, with scans over them: previous and following values, furthest values, running sums.

    Without a length a key's rows meet in one task, which is right for the many keys that hold little. With one, a key's rows are cut by
    time (whose order comes first in `order`) into slices of that length, and every scan is one inside the slices, joined to
    what the slices before (or after) pass on: one small row for each slice, the only thing that is scanned by key. Rows are
    shuffled once, by key and slice. Null keys are one key; null times are a slice of their own, ahead of all others. Each scan
    returns new Slices; `df` are the rows with what the scans have added.
    """

    def __init__(self, df: DataFrame, key: str, time: str, order: list[str], length: Offset | None = None) -> None:
        self.key, self.order, self.sliced = key, order, length is not None
        self._rows = df.withColumn("__slice", F.floor(micros(F.col(time)) / fixed_micros(length))) if self.sliced else df

    def _with(self, rows: DataFrame) -> Slices:
        out = object.__new__(Slices)
        out.key, out.order, out.sliced, out._rows = self.key, self.order, self.sliced, rows
        return out

    @property
    def df(self) -> DataFrame:
        return self._rows.drop("__slice")

    def with_column(self, name: str, value: Column) -> Slices:
        return self._with(self._rows.withColumn(name, value))

    def _inside(self) -> Window:
        return Window.partitionBy(self.key, *(["__slice"] if self.sliced else [])).orderBy(*self.order)

    def _passed_on(self, of_slice: dict[str, Column], scan, backwards: bool = False) -> DataFrame:
        """The rows with what other slices pass on: aggregates of each slice, and the scan over them that excludes the slice itself."""
        summary = self._rows.groupBy(F.col(self.key).alias("__of"), F.col("__slice").alias("__of_slice")).agg(*[c.alias(name) for name, c in of_slice.items()])
        order = F.desc_nulls_last("__of_slice") if backwards else F.asc_nulls_first("__of_slice")
        others = Window.partitionBy("__of").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        carried = summary.select("__of", "__of_slice", *[scan(name).over(others).alias(name) for name in of_slice])
        same = F.col(self.key).eqNullSafe(F.col("__of")) & F.col("__slice").eqNullSafe(F.col("__of_slice"))
        return self._rows.join(carried, same).drop("__of", "__of_slice")

    def _neighbour(self, values: dict[str, str | Column], backwards: bool) -> Slices:
        """The row next to each in the given direction, as one struct so that its nulls aren't taken for a missing row."""
        inside = self._inside()
        packed = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(name) for name, v in values.items()])
        near = (F.lead if backwards else F.lag)(packed).over(inside)
        if not self.sliced:
            rows = self._rows.withColumn("__near", near)
        else:
            rank = F.struct(*self.order)
            edge = (F.min_by if backwards else F.max_by)(packed, rank)
            rows = self._passed_on({"__edge": edge}, F.last, backwards).withColumn("__near", F.coalesce(near, "__edge")).drop("__edge")
        return self._with(rows.withColumns({name: F.col("__near")[name] for name in values}).drop("__near"))

    def previous(self, values: dict[str, str | Column]) -> Slices:
        """Adds values of the row before, by name; null on a key's first row."""
        return self._neighbour(values, False)

    def following(self, values: dict[str, str | Column]) -> Slices:
        """Adds values of the row after, by name; null on a key's last row."""
        return self._neighbour(values, True)

    def furthest(self, column: str, name: str) -> Slices:
        """Adds the largest value of the rows before; null on a key's first row, and where all before are null."""
        so_far = F.max(column).over(self._inside().rowsBetween(Window.unboundedPreceding, -1))
        if not self.sliced:
            return self.with_column(name, so_far)
        rows = self._passed_on({"__furthest": F.max(column)}, F.max)
        return self._with(rows.withColumn(name, F.greatest(so_far, "__furthest")).drop("__furthest"))

    def running_sum(self, column: str, name: str) -> Slices:
        """Adds the sum up to and with the row."""
        so_far = F.sum(column).over(self._inside().rowsBetween(Window.unboundedPreceding, 0))
        if not self.sliced:
            return self.with_column(name, so_far)
        rows = self._passed_on({"__sum": F.sum(column)}, F.sum)
        return self._with(rows.withColumn(name, so_far + F.coalesce("__sum", F.lit(0))).drop("__sum"))
