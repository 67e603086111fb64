"""Set-based mutations of chunk tables: writes, region writes, deletes.

A chunk table has the position columns g0 .. g{n-1} and a value for each chunk."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.grid import NestedGrid, Region


def last_wins(df: DataFrame, keys: Sequence[str], order: str, *values: str) -> DataFrame:
    """One row for each key: of several, the one written last. Map-side aggregation, no sort."""
    best = F.max(F.struct(order, *values)).alias("v")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])


def first_request(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Distinct requests, each with the number of its first occurrence."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def write_chunks(existing: DataFrame, new: DataFrame, keys: Sequence[str], value: str, order: str | None = None) -> DataFrame:
    """Existing chunks with new ones over them."""
    new = last_wins(new, keys, order, value) if order else new
    fresh = new.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__has"))
    joined = existing.select(*keys, value).join(fresh, list(keys), "full")
    return joined.select(*keys, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(value)).alias(value))


def write_region(
    existing: DataFrame, region: Region, grid: NestedGrid, value: str, supplier: Callable[[list[Column], Column], Column], keys: Sequence[str]
) -> DataFrame:
    """For every chunk that the region meets, ``supplier(position, existing value or null)`` gives
    its new value; null deletes the chunk. Chunks outside stay."""
    pos = [F.col(k) for k in keys]
    wanted = region.table(existing.sparkSession, grid).withColumnsRenamed({f"g{d}": k for d, k in enumerate(keys)}).withColumn("__in", F.lit(True))
    met = existing.select(*keys, value).join(wanted, list(keys), "full")
    made = met.select(*keys, F.when(F.col("__in"), supplier(pos, F.col(value))).otherwise(F.col(value)).alias(value), "__in")
    return made.where(F.col("__in").isNull() | F.col(value).isNotNull()).drop("__in")


def delete_chunks(existing: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return existing.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def deleted(existing: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key to delete, whether it existed."""
    have = existing.select(*keys).distinct().withColumn("existed", F.lit(True))
    return doomed.select(*keys).distinct().join(have, list(keys), "left").select(*keys, F.coalesce("existed", F.lit(False)).alias("existed"))


def emptied_shards(before: DataFrame, after: DataFrame, grid: NestedGrid, keys: Sequence[str]) -> DataFrame:
    """Stored blocks that had chunks before and have none after: their keys vanish."""
    names = [f"k{d}" for d in range(grid.ndim)]

    def stored(df: DataFrame) -> DataFrame:
        at = grid.key([F.col(k) for k in keys])
        return df.select(*[c.alias(n) for n, c in zip(names, at, strict=True)]).distinct()

    return stored(before).join(stored(after), names, "left_anti")
