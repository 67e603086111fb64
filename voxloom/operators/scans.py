"""Running sums, maxima and last values by key, for keys of any size.

Rows are sorted into ranges of (key, order), and a scan runs in each range by itself; what
a key's earlier ranges hold is then carried into its later ones. So a key that has a third
of all rows is spread over many tasks, and only one row for each of its ranges meets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.plans.scratch import stored

_SLICE = "__slice"


@dataclass(frozen=True)
class Scan:
    """``df`` in ranges of ``keys`` and ``order`` (ascending, nulls first). Rows equal in both are in no set order,
    but in the same one for all values of one scan only."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @staticmethod
    def over(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Scan:
        ranges = df.repartitionByRange(*keys, *order).withColumn(_SLICE, F.spark_partition_id())
        return Scan(stored(ranges, "scan"), tuple(keys), tuple(order))

    def running(self, name: str, value: Column, how: str, with_own: bool = True) -> Scan:
        """A column with the sum, max or last (value that isn't null) of the rows of the key up to each row, or
        ``with_own=False`` before it; null where there is none."""
        fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
        rows = self.df.withColumn("__value", value)
        total = F.max_by("__value", F.struct(*self.order)) if how == "last" else fold("__value")
        held = (rows.where("__value is not null") if how == "last" else rows).groupBy(_SLICE, *self.keys).agg(total.alias("__total"))
        earlier = Window.partitionBy(*self.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        # a range without values of its own carries on what came before: every range of the key is needed
        ranges = rows.select(_SLICE, *self.keys).distinct() if how == "last" else held.select(_SLICE, *self.keys)
        if how == "last":
            held = ranges.join(held, self._same(ranges, held), "left").select(*[ranges[c] for c in (_SLICE, *self.keys)], "__total")
        carried = held.withColumn("__carried", fold("__total").over(earlier)).where("__carried is not null")
        carried = carried.select(F.col(_SLICE).alias("__s"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], "__carried")
        own = Window.partitionBy(_SLICE, *self.keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0 if with_own else -1)
        rows = rows.withColumn("__own", fold("__value").over(own))
        same = F.col(_SLICE) == F.col("__s")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        rows = rows.join(carried, same, "left")
        both = {"sum": F.coalesce(F.col("__own") + F.col("__carried"), "__own", "__carried"), "max": F.greatest("__own", "__carried"), "last": F.coalesce("__own", "__carried")}[how]
        return Scan(rows.select(*[F.col(c) for c in self.df.columns], both.alias(name)), self.keys, self.order)

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        out = a[_SLICE] == b[_SLICE]
        for k in self.keys:
            out = out & a[k].eqNullSafe(b[k])
        return out

    def rows(self) -> DataFrame:
        return self.df.drop(_SLICE)
