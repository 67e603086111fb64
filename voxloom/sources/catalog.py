"""The tree of groups of a container as a DataFrame of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.sources.store import ATTRIBUTES


def is_dataset_json(attributes: Column, weak: bool = False) -> Column:
    """Whether attributes describe a dataset: dimensions, block size, type, and a codec of any generation;
    with ``weak``, dimensions and a type are enough."""
    has = lambda key: F.get_json_object(attributes, f"$.{key}").isNotNull()
    if weak:
        return has("dimensions") & has("dataType")
    return has("dimensions") & has("blockSize") & has("dataType") & (has("codecs") | has("compression") | has("compressionType"))


def nodes_from(paths: DataFrame, path_col: str, attributes_col: str | None = None) -> DataFrame:
    """path, parent, name, depth, attributes, is_dataset: all groups that paths like ``a/b/c`` imply.

    The root has the empty path. Ancestors come from exploding each path's prefixes, so no
    recursion is needed."""
    attributes = F.col(attributes_col) if attributes_col else F.lit(None).cast("string")
    rows = paths.select(F.split(F.col(path_col), "/").alias("parts"), attributes.alias("attributes"))
    every = rows.select("attributes", "parts", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
    every = every.select(
        F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"),
        "depth",
        F.when(F.col("depth") == F.size("parts"), F.col("attributes")).alias("attributes"),
    ).where((F.col("depth") == 0) | (F.col("path") != ""))
    out = every.groupBy("path").agg(F.min("depth").alias("depth"), F.max("attributes").alias("attributes"))
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.when(F.col("depth") <= 1, "").otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    return out.select(
        "path", F.when(F.col("depth") > 0, parent).alias("parent"), F.when(F.col("depth") > 0, name).alias("name"), "depth", "attributes", F.coalesce(is_dataset_json(F.col("attributes")), F.lit(False)).alias("is_dataset")
    )


def nodes(spark: SparkSession, uri: str) -> DataFrame:
    """Nodes of a container, from its attribute files; groups without any show through their descendants."""
    root = uri.rstrip("/")
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", ATTRIBUTES).text(root)
    bare = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z][a-z0-9]*:/*", "/")
    base = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/")
    path = F.regexp_replace(F.substring(bare, len(base) + 1, 1 << 20), rf"^/|/?{ATTRIBUTES}$", "")
    return nodes_from(files.select(path.alias("p"), F.col("value").alias("a")), "p", "a")


def children(tree: DataFrame, group: str = "") -> DataFrame:
    return tree.where(F.col("parent") == group).select("name").orderBy("name")


def deep_list(tree: DataFrame, group: str = "", datasets_only: bool = False, keep: Column | None = None) -> DataFrame:
    """All nodes below a group, not looking inside datasets; paths are relative to the group."""
    prefix = group + "/" if group else ""
    below = tree.where((F.col("path") != group) & F.col("path").startswith(prefix) & (F.col("depth") > 0))
    owners = tree.where("is_dataset").select(F.col("path").alias("owner"))
    parts = F.split("path", "/")
    above = below.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("owner"))
    above = above.where((F.col("owner") != group) & (F.length("owner") > len(group)))
    hidden = above.join(owners, "owner", "left_semi").select("path").distinct()
    found = below.join(hidden, "path", "left_anti")
    if datasets_only:
        found = found.where("is_dataset")
    if keep is not None:
        found = found.where(keep)
    return found.select(F.substring("path", len(prefix) + 1, 1 << 20).alias("path"))
