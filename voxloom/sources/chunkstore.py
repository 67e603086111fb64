"""Chunks of a stored dataset as rows: g0 .. g{n-1} (chunk position), size, num_elements, data.

Reading is a Spark data source: filters on the position columns narrow the stored blocks to
a box before any is opened, no directory is listed by the driver, and in a shard only the
index and the wanted chunks are read, in merged ranges. Writing is a shuffle by stored block
and one sorted pass, which puts each block in place as a whole."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from decimal import Decimal
from itertools import product
from math import prod
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from voxloom.errors import StoreError
from voxloom.functions.grid import Region
from voxloom.plans.scratch import shared_folder
from voxloom.sources import codecs
from voxloom.sources.codecs import ARRAY_CODECS, BLOCK_CODECS
from voxloom.sources.dataset import CodecNames, Dataset
from voxloom.sources.store import Container, replace_file
from voxloom.types import ELEMENT_TYPES

#: Places of stored blocks that one task visits, as long as that makes no more than so many tasks.
PLACES_PER_TASK = 64
_MOST_TASKS = 20_000
#: In one Arrow batch about so many elements.
_ELEMENTS_PER_BATCH = 1 << 20
FILTER_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def chunk_schema(dataset: Dataset) -> T.StructType:
    cell = ELEMENT_TYPES[dataset.data_type].spark
    fields = [T.StructField(f"g{d}", T.LongType()) for d in range(len(dataset.dims))]
    data = cell if dataset.data_type == "object" else T.ArrayType(cell)
    return T.StructType([*fields, T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("num_elements", T.IntegerType()), T.StructField("data", data)])


def _arrow_data(blocks: list[codecs.Block], label: str) -> pa.Array:
    if label == "object":
        return pa.array([b.data for b in blocks], pa.binary())
    if label == "string":
        return pa.array([list(b.data) for b in blocks], pa.list_(pa.string()))
    if label == "uint64":
        return pa.array([[Decimal(int(v)) for v in b.data] for b in blocks], pa.list_(pa.decimal128(20, 0)))
    kind = {"uint8": "i2", "uint16": "i4", "uint32": "i8"}.get(label) or ELEMENT_TYPES[label].numpy[1:]
    flat = np.concatenate([np.asarray(b.data).astype("=" + kind) for b in blocks])
    offsets = np.concatenate([[0], np.cumsum([len(b.data) for b in blocks])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def decode_chunk(raw: bytes, dataset: Dataset) -> codecs.Block:
    name, params = dataset.layout
    block = BLOCK_CODECS[name].decode(raw, dataset.data_type, dataset.chain, dataset.chunk, params)
    if block.size:
        for array, p in dataset.arrays:
            block = ARRAY_CODECS[array].decode(block, p)
    return block


def encode_chunk(block: codecs.Block, dataset: Dataset) -> bytes:
    if block.size:
        for array, p in reversed(dataset.arrays):
            block = ARRAY_CODECS[array].encode(block, p)
    name, params = dataset.layout
    return BLOCK_CODECS[name].encode(block, dataset.data_type, dataset.chain, params)


def children(ds: Dataset, level: int, key: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Positions, on the level below, of what a shard holds, in the order of its index (dimension 0 fastest)."""
    span = ds.grid.relative_size(level)
    return [tuple(k * n + p for k, n, p in zip(key, span, reversed(spot), strict=True)) for spot in product(*(range(n) for n in reversed(span)))]


def decode_stored(data: bytes, ds: Dataset, key: tuple[int, ...], level: int | None = None) -> dict[tuple[int, ...], bytes]:
    """Coded chunks of a stored block by position."""
    level = len(ds.shards) if level is None else level
    if level == 0:
        return {key: data}
    shard, places = ds.shards[level - 1], children(ds, level, key)
    data = codecs.decode(data, shard.chain)
    out: dict[tuple[int, ...], bytes] = {}
    for pos, part in zip(places, codecs.decode_shard(data, len(places), shard.index_chain, shard.index_at_end, shard.index_little), strict=True):
        if part is not None:
            out |= decode_stored(part, ds, pos, level - 1)
    return out


def encode_stored(chunks: dict[tuple[int, ...], bytes], ds: Dataset, key: tuple[int, ...], level: int | None = None) -> bytes | None:
    """A stored block of coded chunks; None if it would be empty. Empty inner shards are left out."""
    level = len(ds.shards) if level is None else level
    if level == 0:
        return chunks.get(key)
    shard = ds.shards[level - 1]
    parts = [encode_stored(chunks, ds, pos, level - 1) for pos in children(ds, level, key)]
    if all(p is None for p in parts):
        return None
    return codecs.encode(codecs.encode_shard(parts, shard.index_chain, shard.index_at_end, shard.index_little), shard.chain)


def _batch(rows: list[tuple[tuple[int, ...], codecs.Block]], dataset: Dataset) -> pa.RecordBatch:
    """Chunks as rows of ``chunk_schema``."""
    blocks = [b for _, b in rows]
    position = [pa.array([p[d] for p, _ in rows], pa.int64()) for d in range(len(dataset.dims))]
    sizes = pa.array([list(b.size) if b.size else None for b in blocks], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([*position, sizes, pa.array([len(b.data) for b in blocks], pa.int32()), _arrow_data(blocks, dataset.data_type)], chunk_schema(dataset).names)


def _batches(chunks: Iterator[tuple[tuple[int, ...], codecs.Block]], dataset: Dataset) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[tuple[int, ...], codecs.Block]] = []
    held = 0
    for pos, block in chunks:
        rows.append((pos, block))
        held += len(block.data)
        if held >= _ELEMENTS_PER_BATCH:
            yield _batch(rows, dataset)
            rows, held = [], 0
    if rows:
        yield _batch(rows, dataset)


class _Places(InputPartition):
    """Places ``start`` to ``stop`` of a box of stored blocks, counted with the last dimension fastest."""

    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


def _open(options: dict[str, Any]) -> Container:
    return Container(options["path"], names=options["names"], **options["http"])


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, Any], group: str, dataset: Dataset, prefetch: str = "aggregate"):
        self.options, self.group, self.dataset, self.prefetch = options, group, dataset, prefetch
        # bounds of each position column, set by filters, and positions wanted within them
        self.bounds: list[list[float]] = [[0, float("inf")] for _ in dataset.dims]
        self.choices: list[set[int] | None] = [None] * len(dataset.dims)
        self.wanted: set[tuple[int, ...]] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            m = re.fullmatch(r"g(\d+)", name)
            if not m or int(m[1]) >= len(self.bounds):
                yield f
                continue
            d, bound = int(m[1]), self.bounds[int(m[1])]
            if isinstance(f, EqualTo):
                self._choose(d, {f.value})
            elif isinstance(f, In):
                self._choose(d, set(f.value))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                bound[0] = max(bound[0], f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                bound[1] = min(bound[1], f.value - isinstance(f, LessThan))
            else:
                yield f

    def _choose(self, d: int, values: set[int]) -> None:
        self.choices[d] = values if self.choices[d] is None else self.choices[d] & values

    def _wanted(self, d: int, lo: int, hi: int) -> bool:
        """Whether a chunk position from lo to hi passes the filters on dimension d."""
        if hi < self.bounds[d][0] or lo > self.bounds[d][1]:
            return False
        chosen = self.choices[d]
        return chosen is None or any(c is not None and lo <= c <= hi for c in chosen)

    def box(self) -> list[range]:
        """Stored blocks, by dimension, that can hold wanted chunks."""
        out = []
        for d, (span, n) in enumerate(zip(self.dataset.grid.size_in_chunks(self.dataset.grid.top), self.dataset.grid.blocks(self.dataset.grid.top), strict=True)):
            lo, hi = self.bounds[d]
            chosen = self.choices[d]
            if chosen is not None:
                fit = [c for c in chosen if c is not None and lo <= c <= hi]
                lo, hi = (min(fit), max(fit)) if fit else (1, 0)
            last = n - 1 if hi == float("inf") else min(n - 1, int(hi) // span)
            out.append(range(max(0, int(lo)) // span, last + 1) if lo <= hi else range(0))
        return out

    def partitions(self) -> list[InputPartition]:
        total = prod(len(r) for r in self.box())
        step = max(PLACES_PER_TASK, -(-total // _MOST_TASKS))
        return [_Places(i, min(i + step, total)) for i in range(0, total, step)] or [_Places(0, 0)]

    def stored(self, container: Container, start: int, stop: int) -> Iterator[tuple[int, ...]]:
        """Keys of the blocks that are there, of some places of the box. A directory is listed if all its
        places are asked for, else the places are looked up."""
        box = self.box()
        *outer, last = box
        at = start
        while at < stop:
            row, first = divmod(at, len(last))
            upto = min(stop, (row + 1) * len(last))
            prefix = []
            for r in reversed(outer):
                row, i = divmod(row, len(r))
                prefix.insert(0, r[i])
            ks = last[first : first + upto - at]
            if all(self._wanted(d, k * s, (k + 1) * s - 1) for d, (k, s) in enumerate(zip(prefix, self.dataset.grid.size_in_chunks(self.dataset.grid.top)))):
                yield from self._present(container, tuple(prefix), ks, len(ks) == self.dataset.grid.blocks(self.dataset.grid.top)[-1] > 1)
            at = upto

    def _present(self, container: Container, prefix: tuple[int, ...], ks: range, whole: bool) -> Iterator[tuple[int, ...]]:
        span, d = self.dataset.grid.size_in_chunks(self.dataset.grid.top)[-1], len(prefix)
        wanted = [k for k in ks if self._wanted(d, k * span, (k + 1) * span - 1)]
        if whole:
            folder = container.block_path(self.group, prefix).rstrip("/")
            found = container.fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
            there = {int(x.base_name) for x in found if x.type == pafs.FileType.File and x.base_name.isdigit()}
        else:
            found = container.fs.get_file_info([container.block_path(self.group, (*prefix, k)) for k in wanted])
            there = {k for k, x in zip(wanted, found, strict=True) if x.type == pafs.FileType.File}
        yield from ((*prefix, k) for k in wanted if k in there)

    def _asked(self, lo: tuple[int, ...], hi: tuple[int, ...]) -> bool:
        if self.wanted is not None and not (lo in self.wanted if lo == hi else any(all(a <= x <= b for a, x, b in zip(lo, p, hi, strict=True)) for p in self.wanted)):
            return False
        return all(self._wanted(d, a, b) for d, (a, b) in enumerate(zip(lo, hi, strict=True)))

    def chunks(self, fs: pafs.FileSystem, path: str, key: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], codecs.Block]]:
        """Wanted chunks of a stored block."""
        ds = self.dataset
        with fs.open_input_file(path) as f:
            if not ds.shards:
                if self._asked(key, key):
                    yield key, decode_chunk(f.read(), ds)
            elif any(s.chain for s in ds.shards):  # coded as a whole: no part can be read alone
                for pos, raw in decode_stored(f.read(), ds, key).items():
                    if self._asked(pos, pos):
                        yield pos, decode_chunk(raw, ds)
            else:
                for pos, raw in self._in_shard(f, 0, f.size(), len(ds.shards), key):
                    yield pos, decode_chunk(raw, ds)

    def _in_shard(self, f: pa.NativeFile, base: int, size: int, level: int, key: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], bytes]]:
        """Wanted chunks of a shard that lies at ``base``: its index is read, then merged ranges of chunks."""
        ds, shard = self.dataset, self.dataset.shards[level - 1]
        head = ds.index_bytes(level)
        index = codecs.decode_index(f.read_at(head, base + (size - head if shard.index_at_end else 0)), shard.index_chain, shard.index_little)
        span = ds.grid.size_in_chunks(level - 1)
        want = {}
        for (off, n), pos in zip(index.tolist(), children(ds, level, key), strict=True):
            lo = tuple(p * s for p, s in zip(pos, span, strict=True))
            if off != codecs.ABSENT and self._asked(lo, tuple(a + s - 1 for a, s in zip(lo, span, strict=True))):
                want[pos] = (base + off, n)
        if level > 1:
            for pos, (off, n) in want.items():
                yield from self._in_shard(f, off, n, level - 1, pos)
            return
        have = [(off, f.read_at(n, off)) for off, n in codecs.plan_reads(list(want.values()), self.prefetch)]
        for pos, (off, n) in want.items():
            start, data = next((a, b) for a, b in have if a <= off and off + n <= a + len(b))
            yield pos, data[off - start : off - start + n]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        container = _open(self.options)
        keys = self.stored(container, partition.start, partition.stop)
        yield from _batches((c for key in keys for c in self.chunks(container.fs, container.block_path(self.group, key), key)), self.dataset)


class ChunkStore(DataSource):
    """Options: path (the container), group (the dataset in it), prefetch (how ranges of a shard are joined), timeout
    (seconds, of HTTP requests), styles (of HTTP listings, with commas) and block, raw, shard, transpose (names of codecs)."""

    @classmethod
    def name(cls) -> str:
        return "chunkstore"

    def _own(self) -> dict[str, Any]:
        http: dict[str, Any] = {}
        if "timeout" in self.options:
            http["timeout"] = float(self.options["timeout"])
        if "styles" in self.options:
            http["styles"] = tuple(self.options["styles"].split(","))
        names = {k: self.options[k] for k in ("block", "raw", "shard", "transpose") if k in self.options}
        return {"path": self.options["path"], "names": CodecNames(**names), "http": http}

    def _dataset(self) -> Dataset:
        return dataset_of(_open(self._own()), self.options.get("group", ""))

    def schema(self) -> T.StructType:
        return chunk_schema(self._dataset())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ChunkReader(self._own(), self.options.get("group", ""), self._dataset(), self.options.get("prefetch", "aggregate"))


def dataset_of(container: Container, group: str) -> Dataset:
    found = container.dataset(group)
    if found is None:
        raise StoreError(f"no dataset {group} in {container.uri}")
    return found


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and turns on the pushing of filters into it."""
    spark.conf.set(FILTER_PUSHDOWN, "true")
    spark.dataSource.register(ChunkStore)


def _positions(dataset: Dataset) -> list[Column]:
    return [F.col(f"g{d}") for d in range(len(dataset.dims))]


def read_chunks(spark: SparkSession, uri: str, group: str, region: Region | None = None, **options: str) -> DataFrame:
    """Chunks of a dataset, of those a region meets if one is given. ``options`` are those of the data source."""
    register(spark)
    df = spark.read.format("chunkstore").options(group=group, **options).load(uri)
    if region is not None:
        names = CodecNames(**{k: v for k, v in options.items() if k in ("block", "raw", "shard", "transpose")})
        for d, (lo, hi) in enumerate(region.blocks(dataset_of(Container(uri, names=names), group).grid)):
            df = df.where((F.col(f"g{d}") >= lo) & (F.col(f"g{d}") <= hi))
    return df


def read_positions(wanted: DataFrame, uri: str, group: str, order: str = "ord", names: CodecNames = CodecNames()) -> DataFrame:
    """Chunks at wanted positions (``order``, g0..): these columns, size, num_elements and data, null for
    a chunk that isn't there; repeated requests are repeated. Nothing else is opened: the positions come
    together by stored block, and of each block the wanted chunks are read once, in merged ranges."""
    options = {"path": uri, "names": names, "http": {}}
    dataset = dataset_of(_open(options), group)
    g = _positions(dataset)
    n = len(g)
    inside = F.lit(True)
    for d, last in enumerate(dataset.grid.blocks(0)):
        inside = inside & F.col(f"g{d}").between(0, last - 1)
    keys = [k.alias(f"k{d}") for d, k in enumerate(dataset.grid.key(g))]
    asked = wanted.where(inside).select(*g).distinct().select(*keys, F.array(*g).alias("g"))
    asked = asked.groupBy(*[f"k{d}" for d in range(n)]).agg(F.collect_list("g").alias("wanted"))  # at most the chunks of a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        container = _open(options)

        def found() -> Iterator[tuple[tuple[int, ...], codecs.Block]]:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key, reader = row[:n], ChunkReader(options, group, dataset)
                    reader.wanted = {tuple(p) for p in row[n]}
                    if container.block_exists(group, key):
                        yield from reader.chunks(container.fs, container.block_path(group, key), key)

        yield from _batches(found(), dataset)

    have = asked.mapInArrow(run, chunk_schema(dataset))
    names_ = [f"g{d}" for d in range(n)]
    return wanted.select(order, *g).join(have, names_, "left").select(order, *names_, "size", "num_elements", "data")


def _arrow_blocks(batch: pa.RecordBatch, dataset: Dataset, at: int) -> list[codecs.Block | None]:
    """Chunks of the columns size and data from ``at`` on; None where data is null."""
    size, data = batch.column(at), batch.column(at + 1)
    sizes = size.to_pylist()
    if dataset.data_type in ("string", "object", "uint64"):
        cells = data.to_pylist()
        if dataset.data_type == "uint64":
            cells = [None if x is None else [int(v) for v in x] for x in cells]
    else:
        flat = data.values.to_numpy(zero_copy_only=False)
        offsets = data.offsets.to_numpy()
        valid = data.is_valid().to_pylist()
        cells = [flat[a:b] if ok else None for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid, strict=True)]
    return [None if x is None else codecs.Block(tuple(s) if s is not None else None, x) for s, x in zip(sizes, cells, strict=True)]


def _changed(container: Container, group: str, dataset: Dataset, key: tuple[int, ...], changes: dict[tuple[int, ...], codecs.Block | None]) -> tuple[int, int]:
    """Puts a stored block with its changes in place; (chunks written, chunks deleted)."""
    path = container.block_path(group, key)
    span = prod(dataset.grid.size_in_chunks(dataset.grid.top))
    old: dict[tuple[int, ...], bytes] = {}
    there = container.block_exists(group, key)
    if there and (len(changes) < span or any(b is None for b in changes.values())):
        with container.fs.open_input_file(path) as f:
            old = decode_stored(f.read(), dataset, key)
    gone = sum(b is None and pos in old for pos, b in changes.items())
    kept = {pos: raw for pos, raw in old.items() if pos not in changes}
    new = {pos: encode_chunk(b, dataset) for pos, b in changes.items() if b is not None}
    data = encode_stored(kept | new, dataset, key)
    if data is None:
        if there:
            container.delete_block(group, key)
    elif new or gone:
        replace_file(container.fs, path, data)
    return len(new), gone


def apply_changes(changes: DataFrame, uri: str, group: str, order: str | None = None, names: CodecNames = CodecNames()) -> tuple[int, int]:
    """Writes and deletes chunks: rows g0.., size, data, where null data deletes. Returns how many
    chunks were written and deleted.

    Rows come together by stored block, and each block changes as a whole or not at all, deletes
    and writes at once. A task that runs again finds the same rows and leaves the same blocks, so
    the rows must not depend on what the dataset holds; ``write_chunks`` and its like see to that.
    Of rows for one chunk the last by ``order`` counts; without one, they are an error."""
    options = {"path": uri, "names": names, "http": {}}
    dataset = dataset_of(_open(options), group)
    g, n = _positions(dataset), len(dataset.dims)
    keys = [k.alias(f"k{d}") for d, k in enumerate(dataset.grid.key(g))]
    rows = changes.select(*keys, *g, "size", "data", *([F.col(order).alias("ord")] if order else []))
    by = [f"k{d}" for d in range(n)]
    rows = rows.repartition(*by).sortWithinPartitions(*by, *g, *(["ord"] if order else [])).drop("ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        container = _open(options)
        written = deleted = 0
        key: tuple[int, ...] | None = None
        held: dict[tuple[int, ...], codecs.Block | None] = {}
        for batch in batches:
            places = np.stack([batch.column(i).to_numpy() for i in range(2 * n)], axis=1).tolist()
            for place, block in zip(places, _arrow_blocks(batch, dataset, 2 * n), strict=True):
                here, pos = tuple(place[:n]), tuple(place[n:])
                if here != key:
                    if key is not None:
                        done = _changed(container, group, dataset, key, held)
                        written, deleted = written + done[0], deleted + done[1]
                    key, held = here, {}
                if order is None and pos in held:
                    raise StoreError(f"chunk {pos} comes more than once; name a column that orders its rows")
                held[pos] = block
        if key is not None:
            done = _changed(container, group, dataset, key, held)
            written, deleted = written + done[0], deleted + done[1]
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64()), pa.array([deleted], pa.int64())], ["written", "deleted"])

    done = rows.mapInArrow(run, "written long, deleted long").agg(F.sum("written"), F.sum("deleted")).first()
    return done[0] or 0, done[1] or 0


def stage_changes(changes: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Changes as a table in the shared folder, and that folder: they are decided once, before anything changes."""
    folder = shared_folder(changes.sparkSession, name)
    changes.write.parquet(folder)
    return changes.sparkSession.read.schema(changes.schema).parquet(folder), folder


def apply_staged(spark: SparkSession, folder: str, uri: str, group: str, order: str | None = None, names: CodecNames = CodecNames()) -> tuple[int, int]:
    """Applies changes that lie in a folder of ``stage_changes``, and clears it. Where that fails, the
    changes stay there, and calling this once more completes them."""
    try:
        done = apply_changes(spark.read.parquet(folder), uri, group, order, names)
    except Exception as e:
        e.add_note(f"the changes are in {folder}; apply_staged completes them")
        raise
    _clear(folder)
    return done


def _clear(folder: str) -> None:
    from voxloom.sources.store import filesystem

    fs, path = filesystem(folder)
    fs.delete_dir(path)


def write_chunks(df: DataFrame, uri: str, group: str, order: str | None = None, names: CodecNames = CodecNames(), staged: bool = True) -> tuple[int, int]:
    """Writes chunk rows (g0.., size, data) over those stored; of rows for one chunk the last by ``order`` stays.

    Rows that come from elsewhere, and come out alike when they are computed again, needn't be
    written down first: ``staged=False`` saves that."""
    rows = df.select(*_position_names(df), "size", "data", *([order] if order else []))
    if not staged:
        return apply_changes(rows, uri, group, order, names)
    _, folder = stage_changes(rows, "writes")
    return apply_staged(df.sparkSession, folder, uri, group, order, names)


def delete_chunks(doomed: DataFrame, uri: str, group: str, names: CodecNames = CodecNames()) -> int:
    """Deletes chunks (rows g0..), and returns how many there were. A shard that loses all its chunks vanishes."""
    cell = chunk_schema(dataset_of(Container(uri, names=names), group))["data"].dataType
    rows = doomed.select(*_position_names(doomed)).distinct().withColumns({"size": F.lit(None).cast("array<int>"), "data": F.lit(None).cast(cell)})
    _, folder = stage_changes(rows, "deletes")
    return apply_staged(doomed.sparkSession, folder, uri, group, names=names)[1]


def _position_names(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if re.fullmatch(r"g\d+", c)), key=lambda c: int(c[1:]))
