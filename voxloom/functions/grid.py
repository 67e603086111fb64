"""Nested chunk grids: plan-time constants that emit Column expressions, no UDFs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def div(a: Column, b: int) -> Column:
    """Whole-number division of non-negative numbers."""
    return F.call_function("div", a, F.lit(b))


@dataclass(frozen=True)
class NestedGrid:
    """Block sizes by level: level 0 are chunks, the last level are the stored blocks (shards)."""

    block_sizes: tuple[tuple[int, ...], ...]
    dims: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        if not self.block_sizes:
            raise ValueError("a grid needs at least one level")
        if any(s is None for s in self.block_sizes):
            raise ValueError("block sizes must not be null")
        n = len(self.block_sizes[0])
        for level, size in enumerate(self.block_sizes):
            if len(size) != n:
                raise ValueError(f"level {level} has {len(size)} dimensions, level 0 has {n}")
            if any(s <= 0 for s in size):
                raise ValueError(f"block sizes of level {level} must be positive")
            if level:
                below = self.block_sizes[level - 1]
                if any(s < b for s, b in zip(size, below, strict=True)):
                    raise ValueError(f"blocks of level {level} are smaller than those below")
                if any(s % b for s, b in zip(size, below, strict=True)):
                    raise ValueError(f"block sizes of level {level} are no multiples of those below")
        if self.dims is not None and len(self.dims) != n:
            raise ValueError("dimensions and block sizes differ in rank")

    @property
    def ndim(self) -> int:
        return len(self.block_sizes[0])

    @property
    def levels(self) -> int:
        return len(self.block_sizes)

    @property
    def top(self) -> int:
        return self.levels - 1

    def relative_size(self, level: int) -> tuple[int, ...]:
        """Blocks of the level below in one block of ``level``."""
        return tuple(a // b for a, b in zip(self.block_sizes[level], self.block_sizes[level - 1], strict=True)) if level else (1,) * self.ndim

    def size_in_chunks(self, level: int) -> tuple[int, ...]:
        return tuple(a // b for a, b in zip(self.block_sizes[level], self.block_sizes[0], strict=True))

    def blocks(self, level: int = 0) -> tuple[int, ...]:
        """Number of blocks of a level in each dimension of the dataset."""
        if self.dims is None:
            raise ValueError("the grid has no dataset dimensions")
        return tuple(-(-d // s) for d, s in zip(self.dims, self.block_sizes[level], strict=True))

    # positions as lists of columns, one for each dimension
    def absolute(self, pos: Sequence[Column], from_level: int, to_level: int) -> list[Column]:
        """Position on level ``to_level`` of a block of ``from_level`` (its first one if finer)."""
        a, b = self.block_sizes[from_level], self.block_sizes[to_level]
        return [div(p * x, y) if x != y else p for p, x, y in zip(pos, a, b, strict=True)]

    def relative(self, pos: Sequence[Column], from_level: int, to_level: int) -> list[Column]:
        """As ``absolute``, counted within the block of the next level; at the top from the origin."""
        at = self.absolute(pos, from_level, to_level)
        return at if to_level == self.top else [p % r for p, r in zip(at, self.relative_size(to_level + 1), strict=True)]

    def key(self, pos: Sequence[Column], from_level: int = 0) -> list[Column]:
        """Position of the stored block."""
        return self.relative(pos, from_level, self.top)

    def pixel_min(self, pos: Sequence[Column], level: int = 0) -> list[Column]:
        return [p * s for p, s in zip(pos, self.block_sizes[level], strict=True)]

    def pixel_max(self, pos: Sequence[Column], level: int = 0) -> list[Column]:
        """Last pixel of a block, beyond the dataset if the block is."""
        return [(p + 1) * s - 1 for p, s in zip(pos, self.block_sizes[level], strict=True)]

    def of_pixels(self, pixels: Sequence[Column], level: int = 0) -> list[Column]:
        return [div(x, s) for x, s in zip(pixels, self.block_sizes[level], strict=True)]

    def order(self, pos: Sequence[Column], from_level: int = 0) -> list[Column]:
        """Sort keys of nested order: from the coarsest level to the finest, last dimension first."""
        return [c for level in range(self.top, from_level - 1, -1) for c in reversed(self.relative(pos, from_level, level))]

    def clipped_chunks(self, key: Sequence[Column]) -> Column:
        """Chunks of a stored block that lie in the dataset."""
        out = F.lit(1)
        for k, r, n in zip(key, self.size_in_chunks(self.top), self.blocks(0), strict=True):
            out = out * F.least(F.lit(r), F.lit(n) - k * r)
        return out.cast("long")


def linear_index(pos: Sequence[Column], size: Sequence[int | Column]) -> Column:
    """Index of a position in a dense array; dimension 0 varies fastest."""
    out, stride = pos[0], size[0]
    for p, s in zip(pos[1:], size[1:], strict=True):
        out = out + p * stride
        stride = stride * s
    return out


def strides(size: Sequence[int]) -> list[int]:
    return [prod(size[:d]) for d in range(len(size))]


def block_path(pos: Sequence[Column]) -> Column:
    """Key of a block: its position joined by slashes."""
    return F.concat_ws("/", *[p.cast("string") for p in pos])


def num_elements(size: Column) -> Column:
    """Product of an array of sizes."""
    return F.aggregate(size, F.lit(1).cast("long"), lambda a, x: a * x)


@dataclass(frozen=True)
class Region:
    """A box of pixels."""

    min: tuple[int, ...]
    size: tuple[int, ...]

    def __post_init__(self) -> None:
        if len(self.min) != len(self.size) or any(s <= 0 for s in self.size):
            raise ValueError("a region needs a positive size in each dimension")

    @property
    def max(self) -> tuple[int, ...]:
        return tuple(m + s - 1 for m, s in zip(self.min, self.size, strict=True))

    def blocks(self, grid: NestedGrid, level: int = 0) -> list[tuple[int, int]]:
        """First and last block of a level in each dimension, within the dataset if the grid knows it."""
        out = []
        for d, (lo, hi, s) in enumerate(zip(self.min, self.max, grid.block_sizes[level], strict=True)):
            last = hi // s
            if grid.dims is not None:
                last = min(last, grid.blocks(level)[d] - 1)
            out.append((max(0, lo) // s, last))
        return out

    def has_pixel(self, pixels: Sequence[Column]) -> Column:
        out = F.lit(True)
        for x, lo, hi in zip(pixels, self.min, self.max, strict=True):
            out = out & x.between(lo, hi)
        return out

    def meets_block(self, pos: Sequence[Column], grid: NestedGrid, level: int = 0) -> Column:
        out = F.lit(True)
        for p, (lo, hi) in zip(pos, self.blocks(grid, level), strict=True):
            out = out & p.between(lo, hi)
        return out

    def fully_contains(self, pos: Sequence[Column], grid: NestedGrid, level: int = 0) -> Column:
        """Whether a block's pixels, cut at the dataset's edge, all lie in the region."""
        out = F.lit(True)
        lows, highs = grid.pixel_min(pos, level), grid.pixel_max(pos, level)
        for d, (a, b) in enumerate(zip(lows, highs, strict=True)):
            if grid.dims is not None:
                b = F.least(b, F.lit(grid.dims[d] - 1))
            out = out & (a >= self.min[d]) & (b <= self.max[d])
        return out

    def positions(self, df: DataFrame, grid: NestedGrid, level: int = 0, prefix: str = "g") -> DataFrame:
        """All block positions that the region meets, for each row of ``df``: columns g0, g1, ..."""
        for d, (lo, hi) in enumerate(self.blocks(grid, level)):
            spot = F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long")) if hi >= lo else F.array().cast("array<bigint>")
            df = df.withColumn(f"{prefix}{d}", F.explode(spot))
        return df

    def table(self, spark: SparkSession, grid: NestedGrid, level: int = 0, prefix: str = "g") -> DataFrame:
        """All block positions that the region meets, made in all tasks: columns g0, g1, ..."""
        bounds = self.blocks(grid, level)
        sizes = [max(0, hi - lo + 1) for lo, hi in bounds]
        index, out = F.col("id"), []
        for d, ((lo, _), size) in enumerate(zip(bounds, sizes, strict=True)):
            out.append((index % F.lit(max(1, size)) + lo).cast("long").alias(f"{prefix}{d}"))
            index = div(index, max(1, size))
        return spark.range(prod(sizes)).select(*out)


def invert_permutation(p: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (F.array_position(p, i) - 1).cast("int"))


def concatenate_permutations(first: Column, second: Column) -> Column:
    return F.transform(second, lambda i: F.element_at(first, i + 1))


def conjugate_with_reverse(p: Column) -> Column:
    """The permutation of the reversed dimensions."""
    return F.transform(F.reverse(p), lambda i: (F.size(p) - 1 - i).cast("int"))


def is_identity(p: Column) -> Column:
    return F.forall(F.arrays_zip(p.alias("v"), F.sequence(F.lit(0), F.size(p) - 1).alias("i")), lambda z: z["v"] == z["i"])


def is_reversal(p: Column) -> Column:
    return is_identity(F.reverse(p))
