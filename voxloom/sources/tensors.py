"""Stored datasets as tensors: cells in, cells out, and region updates in place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.grid import NestedGrid, Region
from voxloom.operators.tensor import TensorFrame
from voxloom.sources.chunkstore import apply_staged, chunk_schema, dataset_of, read_chunks, stage_changes, write_chunks
from voxloom.sources.dataset import CodecNames, Dataset
from voxloom.sources.store import Container


def _dataset(uri: str, group: str, names: CodecNames) -> Dataset:
    return dataset_of(Container(uri, names=names), group)


def open_tensor(spark: SparkSession, uri: str, group: str, region: Region | None = None, names: CodecNames = CodecNames()) -> TensorFrame:
    """Cells of a dataset, of a region if one is given: stored blocks outside it aren't opened.

    A chunk's own size counts, so that chunks cut at the dataset's edge are read as they are;
    cells beyond the edge, which a chunk stored at full size has, are left out."""
    ds = _dataset(uri, group, names)
    n = len(ds.dims)
    rows = read_chunks(spark, uri, group, region, **asdict(names)).select(*[f"g{d}" for d in range(n)], "size", F.posexplode("data").alias("i", "value"))
    coords, stride = [], F.lit(1)
    for d in range(n):
        width = F.element_at("size", d + 1)
        coords.append(F.col(f"g{d}") * ds.chunk[d] + F.call_function("div", F.col("i"), stride) % width)
        stride = stride * width
    cells = rows.select(*[c.cast("long").alias(f"x{d}") for d, c in enumerate(coords)], "value")
    inside = (region or Region((0,) * n, ds.dims)).has_pixel([F.col(f"x{d}") for d in range(n)])
    for d in range(n):
        inside = inside & (F.col(f"x{d}") < ds.dims[d])
    return TensorFrame(cells.where(inside), ds.grid)


def write_cells(tensor: TensorFrame, uri: str, group: str, fill: Column | None = None, names: CodecNames = CodecNames()) -> None:
    """Writes cells as chunks cut at the dataset's edge; absent cells of a chunk become ``fill``, by default the
    dataset's default value, or zero."""
    ds = _dataset(uri, group, names)
    if fill is None and ds.fill is not None:
        fill = F.lit(ds.fill)
    kind = chunk_schema(ds)["data"].dataType.elementType
    cells = tensor.df.withColumn("value", F.col("value").cast(kind))
    blocks = TensorFrame(cells, NestedGrid((ds.chunk,), ds.dims)).dense_blocks(0, fill.cast(kind) if fill is not None else None)
    size = F.array(*[F.least(F.lit(c), F.lit(n) - F.col(f"g{d}") * c).cast("int") for d, (c, n) in enumerate(zip(ds.chunk, ds.dims, strict=True))])
    write_chunks(blocks.withColumn("size", size).withColumn("num_elements", F.size("data")), uri, group, names=names)


def update_region(spark: SparkSession, uri: str, group: str, region: Region, supplier: Callable[[list[Column], Column], Column], names: CodecNames = CodecNames()) -> None:
    """For every chunk that the region meets, ``supplier(position, data or null)`` gives its new
    data; null deletes the chunk, and a stored block that loses all its chunks vanishes.

    New chunks have the size of the grid's cell, cut at the dataset's edge. The supplier decides
    once, on what was stored before anything changes; its decisions are written down, and then
    each stored block changes as a whole, its deletes and writes at once."""
    ds = _dataset(uri, group, names)
    n = len(ds.dims)
    g = [f"g{d}" for d in range(n)]
    wanted = region.table(spark, ds.grid)
    met = wanted.join(read_chunks(spark, uri, group, region, **asdict(names)).select(*g, "size", "data"), g, "left")
    full = F.array(*[F.least(F.lit(c), F.lit(m) - F.col(f"g{d}") * c).cast("int") for d, (c, m) in enumerate(zip(ds.chunk, ds.dims, strict=True))])
    made = met.select(*g, F.coalesce("size", full).alias("size"), F.col("data").isNotNull().alias("was"), supplier([F.col(c) for c in g], F.col("data")).alias("data"))
    _, folder = stage_changes(made.where("was or data is not null").drop("was"), "region-changes")
    apply_staged(spark, folder, uri, group, names=names)
