"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.scratch import stash


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int) whose weighted score of ``key`` is highest.

    Shard i scores ``weights[i] / -ln(u)`` with u drawn from the hash of (key, i),
    so shard i gets a share of the keys in proportion to its weight, and appending
    a shard moves rows into the new shard only. A null key is a key of its own.
    Of equal scores the lower shard number wins."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, at least one")
    scores = []
    for i, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-i).alias("shard")))
    best = F.array_max(F.array(*scores)) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def assign_shards(
    df: DataFrame, weights: Sequence[float], new_weight: float | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Puts every row into a shard by its key alone, and numbers the rows of each shard.

    Returns ``id_col``, size (UTF-8 bytes of the text plus 1; a null text has none),
    text_crc32, law (always ``key``), shard, slot (gapless from 0 in each shard) and
    grown_shard (with one more shard of ``new_weight``, by default the mean weight).

    Rows with one key share a shard however often the key is repeated, null included;
    the slots are given per input partition, whose counts per shard are then summed
    up, so that neither a shard nor a key is ever sorted as a whole. Columns other
    than the two named are not read."""
    grown = [*weights, new_weight if new_weight is not None else sum(weights) / len(weights)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stash(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            rendezvous_shard(F.col(id_col), weights).alias("shard"),
            rendezvous_shard(F.col(id_col), grown).alias("grown_shard"),
            F.spark_partition_id().alias("part"),
        ),
        "shards",
    )
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("id", "size", "text_crc32")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(bases, ["shard", "part"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
