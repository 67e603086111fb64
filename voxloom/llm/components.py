"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.scratch import stash


def components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """node, root: for every node with a link, the smallest node that it reaches.

    Each round hangs all larger neighbours of a node on its smallest one (large star),
    then a node and its smaller neighbours on the smallest of them (small star), until
    the links are stars. Only minima and joins by key are used, so that a node with
    very many links needs no task to hold them."""
    edges = links.where(F.col(left) != F.col(right))
    edges = stash(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stash(small.select("e.u", "e.v").where("u != v").distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
