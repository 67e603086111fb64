"""Tensors as DataFrames of cells: x0 .. x{n-1} and value, with a nested chunk grid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.grid import NestedGrid, Region, div, linear_index
from voxloom.operators.scans import Scan


@dataclass(frozen=True)
class TensorFrame:
    """``df`` has the columns x0 .. x{n-1} (bigint, from 0) and value. Cells may be absent."""

    df: DataFrame
    grid: NestedGrid

    @staticmethod
    def from_table(df: DataFrame, coords: Sequence[Column], value: Column, dims: Sequence[int], chunk: Sequence[int], shard: Sequence[int] | None = None) -> TensorFrame:
        """Rows of a table as cells. Coordinates that repeat give cells that repeat; aggregate first where that's unwanted."""
        sizes = (tuple(chunk),) if shard is None else (tuple(chunk), tuple(shard))
        cells = df.select(*[c.cast("long").alias(f"x{d}") for d, c in enumerate(coords)], value.alias("value"))
        return TensorFrame(cells, NestedGrid(sizes, tuple(dims)))

    @staticmethod
    def from_array_column(df: DataFrame, row: Column, array: Column, dims: Sequence[int], chunk: Sequence[int], shard: Sequence[int] | None = None) -> TensorFrame:
        """An array column as a 2-d tensor: dimension 0 is the place in the array, dimension 1 the row."""
        cells = df.select(row.alias("row"), F.posexplode(array).alias("place", "value"))
        return TensorFrame.from_table(cells, [F.col("place"), F.col("row")], F.col("value"), dims, chunk, shard)

    @property
    def ndim(self) -> int:
        return self.grid.ndim

    @property
    def dims(self) -> tuple[int, ...]:
        assert self.grid.dims is not None
        return self.grid.dims

    def pixels(self) -> list[Column]:
        return [F.col(f"x{d}") for d in range(self.ndim)]

    def _names(self, prefix: str) -> list[str]:
        return [f"{prefix}{d}" for d in range(self.ndim)]

    def with_grid(self, level: int = 0, prefix: str = "g") -> DataFrame:
        """Cells with the position of their block of a level."""
        return self.df.withColumns(dict(zip(self._names(prefix), self.grid.of_pixels(self.pixels(), level), strict=True)))

    def region(self, region: Region) -> TensorFrame:
        """Cells of a box. The pixel bounds reach the scan; block bounds come from ``Region.meets_block``."""
        return replace(self, df=self.df.where(region.has_pixel(self.pixels())))

    def chunk_stats(self, level: int = 0) -> DataFrame:
        """Count, sum, minimum and maximum by block."""
        g = self._names("g")
        return self.with_grid(level).groupBy(*g).agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))

    def rollup(self, *aggregates: Column) -> DataFrame:
        """Aggregates by chunk, stored block and dataset in one pass: columns s0.. and c0.. are null above their level."""
        top = self.with_grid(self.grid.top, "s")
        both = top.withColumns(dict(zip(self._names("c"), self.grid.of_pixels(self.pixels(), 0), strict=True)))
        s, c = self._names("s"), self._names("c")
        sets = [[*s, *c], s, []]
        return both.groupingSets([[F.col(x) for x in g] for g in sets], *s, *c).agg(*aggregates)

    def chunks(self, level: int = 0) -> DataFrame:
        """Stored cells of each block as an array in element order (dimension 0 fastest): g0.., n, data."""
        at = [x % s for x, s in zip(self.pixels(), self.grid.block_sizes[level], strict=True)]
        cells = self.with_grid(level).withColumn("lin", linear_index(at, self.grid.block_sizes[level]))
        packed = cells.groupBy(*self._names("g")).agg(F.array_sort(F.collect_list(F.struct("lin", "value"))).alias("cells"))
        return packed.select(*self._names("g"), F.size("cells").cast("long").alias("n"), F.transform("cells", lambda c: c["value"]).alias("data"))

    def dense_blocks(self, level: int | None = None, fill: Column | None = None) -> DataFrame:
        """Blocks as whole arrays, cut at the dataset's edge, absent cells filled with zero (or ``fill``).

        Blocks without any cell are absent. The gaps between the sorted cells of a block are
        filled as runs, so that no dense scaffold is joined. Cells must not repeat."""
        level = self.grid.top if level is None else level
        g, size = self._names("g"), self.grid.block_sizes[level]
        ext = [F.least(F.lit(s), F.lit(n) - F.col(c) * s) for c, s, n in zip(g, size, self.dims, strict=True)]
        at = [x % s for x, s in zip(self.pixels(), size, strict=True)]
        cells = self.with_grid(level).withColumn("lin", linear_index(at, ext))
        packed = cells.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("lin", "value"))).alias("cells"))
        total = ext[0]
        for e in ext[1:]:
            total = total * e
        zero = F.lit(0).cast(self.df.schema["value"].dataType) if fill is None else fill
        last = lambda i: F.when(i == 0, F.lit(-1).cast("long")).otherwise(F.col("cells")[i - 1]["lin"])
        run = lambda c, i: F.concat(F.array_repeat(zero, (c["lin"] - last(i) - 1).cast("int")), F.array(c["value"]))
        tail = F.array_repeat(zero, (total - F.col("cells")[F.size("cells") - 1]["lin"] - 1).cast("int"))
        return packed.select(*g, F.concat(F.flatten(F.transform("cells", run)), tail).alias("data"))

    def read_chunks(self, positions: DataFrame, order: str = "ord") -> DataFrame:
        """Chunks at the wanted positions (g0.., with their order), absent ones with a null array, repeated ones repeated."""
        g = self._names("g")
        wanted = positions.select(order, *g)
        # only the cells of wanted chunks are shuffled and packed
        asked = wanted.select(*[F.col(c).alias(f"w{d}") for d, c in enumerate(g)]).distinct()
        same = [c == F.col(f"w{d}") for d, c in enumerate(self.grid.of_pixels(self.pixels()))]
        found = replace(self, df=self.df.join(asked, same, "left_semi")).chunks().drop("n")
        return wanted.join(found, g, "left").select(order, *g, "data")

    def transpose(self, order: Sequence[int]) -> TensorFrame:
        """Dimension d of the result is dimension ``order[d]``."""
        if sorted(order) != list(range(self.ndim)):
            raise ValueError("order must name each dimension once")
        df = self.df.select(*[F.col(f"x{o}").alias(f"x{d}") for d, o in enumerate(order)], "value")
        pick = lambda size: tuple(size[o] for o in order)
        return TensorFrame(df, NestedGrid(tuple(pick(s) for s in self.grid.block_sizes), pick(self.dims)))

    def downsample(self, factors: Sequence[int], aggregate: Column) -> TensorFrame:
        """Each cell of the result aggregates a box of cells."""
        x = [div(c, f).alias(f"x{d}") for d, (c, f) in enumerate(zip(self.pixels(), factors, strict=True))]
        df = self.df.groupBy(*x).agg(aggregate.alias("value"))
        dims = tuple(-(-n // f) for n, f in zip(self.dims, factors, strict=True))
        return TensorFrame(df, NestedGrid(self.grid.block_sizes, dims))

    def nested_rank(self, positions: DataFrame, rank: str = "place") -> DataFrame:
        """Distinct chunk positions g0.. numbered from 1 in nested order: stored block by stored block,
        last dimension first. Chunks are ranked within their block; blocks are sorted in ranges, ranked in
        each and raised by what the ranges before hold."""
        g, k = self._names("g"), self._names("k")
        pos = [F.col(c) for c in g]
        rows = positions.select(*g).distinct().withColumns(dict(zip(k, self.grid.key(pos), strict=True)))
        inner = [c for level in range(self.grid.top - 1, -1, -1) for c in reversed(self.grid.relative(pos, 0, level))] or [F.lit(0)]
        placed = rows.withColumn("__in", F.row_number().over(Window.partitionBy(*k).orderBy(*inner)))
        counts = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("__n"))
        # one key for all blocks: their scan is spread over ranges
        scan = Scan.over(counts.withColumn("__all", F.lit(0)), ["__all"], list(reversed(k))).running("__base", F.col("__n"), "sum", with_own=False)
        bases = scan.rows().select(*k, F.coalesce("__base", F.lit(0)).alias("__base"))
        return placed.join(bases, k).select(*g, (F.col("__base") + F.col("__in")).cast("long").alias(rank))

    def shard_coverage(self, requests: DataFrame) -> DataFrame:
        """For requested chunk positions g0..: k0.., requested (distinct chunks), chunks (those in the
        dataset) and covers, by stored block."""
        g, k = self._names("g"), self._names("k")
        keys = self.grid.key([F.col(c) for c in g])
        rows = requests.select(*g, *[x.alias(n) for n, x in zip(k, keys, strict=True)]).distinct()
        counted = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("requested"))
        whole = self.grid.clipped_chunks([F.col(c) for c in k])
        return counted.select(*k, "requested", whole.alias("chunks"), (F.col("requested") >= whole).alias("covers"))

    def chunk_elements(self) -> int:
        return prod(self.grid.block_sizes[0])
