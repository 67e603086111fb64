"""Byte ranges (key, off, len) by key: merging, covering, floor search, offsets.

All of these are sorts within a key, never joins on inequalities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.scans import Scan


def coalesce_ranges(df: DataFrame, keys: Sequence[str], off: str = "off", length: str = "len") -> DataFrame:
    """Unions of overlapping and adjacent ranges of each key."""
    end = F.col(off) + F.col(length)
    scan = Scan.over(df.select(*keys, off, length).distinct(), keys, [off, length]).running("__reach", end, "max", with_own=False)
    opens = F.when(F.coalesce(F.col("__reach") < F.col(off), F.lit(True)), F.col(off))
    merged = scan.running("__island", opens, "last").rows().groupBy(*keys, "__island").agg(F.max(end).alias("__end"))
    return merged.select(*keys, F.col("__island").alias(off), (F.col("__end") - F.col("__island")).alias(length))


def _beside(requests: DataFrame, slices: DataFrame, keys: Sequence[str], off: str, carry: Column, kind: str) -> DataFrame:
    """Slices (kind 0) with what they carry, and requests (kind 1), in one table by offset."""
    cols = [c for c in requests.columns if c not in keys]
    asked = requests.select(*keys, F.struct(*cols).alias("__r"), F.col(off).alias("__o"), F.lit(1).alias("__kind"), F.lit(None).cast(kind).alias("__carry"))
    have = slices.select(*keys, F.lit(None).cast(asked.schema["__r"].dataType).alias("__r"), F.col(off).alias("__o"), F.lit(0).alias("__kind"), carry.cast(kind).alias("__carry"))
    return asked.unionByName(have)


def covered(requests: DataFrame, slices: DataFrame, keys: Sequence[str], off: str = "off", length: str = "len") -> DataFrame:
    """Requests with ``covered``: whether a single slice contains them. A running maximum of the
    slices' ends up to the request's offset decides, in one sort by key."""
    both = _beside(requests, slices, keys, off, F.col(off) + F.col(length), "long")
    found = Scan.over(both, keys, ["__o", "__kind"]).running("__reach", F.col("__carry"), "max").rows().where("__kind = 1")
    out = found.select(*keys, "__r.*", "__reach")
    return out.withColumn("covered", F.coalesce(F.col("__reach") >= F.col(off) + F.col(length), F.lit(False))).drop("__reach")


def floor_slice(requests: DataFrame, slices: DataFrame, keys: Sequence[str], off: str = "off", carry: str = "slice") -> DataFrame:
    """Each request with ``carry`` of the slice with the largest offset at or before its own (null if none)."""
    both = _beside(requests, slices, keys, off, F.col(carry), slices.schema[carry].dataType.simpleString())
    found = Scan.over(both, keys, ["__o", "__kind"]).running("__found", F.col("__carry"), "last").rows().where("__kind = 1")
    return found.select(*keys, "__r.*", F.col("__found").alias(carry))


def enclosing_range(df: DataFrame, keys: Sequence[str], off: str = "off", length: str = "len") -> DataFrame:
    low, high = F.min(off), F.max(F.col(off) + F.col(length))
    return df.groupBy(*keys).agg(low.alias(off), (high - low).alias(length))


def segment_offsets(df: DataFrame, keys: Sequence[str], order: str, length: str) -> DataFrame:
    """``off``: where each segment begins when those of a key are concatenated in order."""
    scan = Scan.over(df, keys, [order]).running("off", F.col(length), "sum", with_own=False)
    return scan.rows().withColumn("off", F.coalesce("off", F.lit(0)).cast("long"))


def slice_segments(df: DataFrame, start: int, size: int, off: str = "off", length: str = "len") -> DataFrame:
    """Segments that lie wholly in a range, their offsets counted from its start."""
    inside = (F.col(off) >= start) & (F.col(off) + F.col(length) <= start + size)
    return df.where(inside).withColumn(off, F.col(off) - start)


def add_slices(slices: DataFrame, new: DataFrame, keys: Sequence[str], off: str = "off", length: str = "len") -> DataFrame:
    """Slices and new ones, without those that another one of them contains."""
    both = slices.select(*keys, off, length).unionByName(new.select(*keys, off, length)).distinct()
    scan = Scan.over(both.withColumn("__shorter", -F.col(length)), keys, [off, "__shorter"])
    found = scan.running("__reach", F.col(off) + F.col(length), "max", with_own=False).rows()
    return found.where(F.col("__reach").isNull() | (F.col("__reach") < F.col(off) + F.col(length))).drop("__reach", "__shorter")
