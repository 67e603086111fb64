"""Metadata of a dataset: the fixed schema under a group's attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from math import prod
from typing import Any

from voxloom.errors import StoreError
from voxloom.functions.grid import NestedGrid
from voxloom.sources import codecs
from voxloom.sources.codecs import Chain, index_size, parse_float
from voxloom.types import element_type


@dataclass(frozen=True)
class CodecNames:
    """Names in the ``codecs`` lists of metadata. Pass those that existing containers use."""

    block: str = "default"
    raw: str = "raw-bytes"
    shard: str = "sharding_indexed"
    transpose: str = "transpose"


def default_block_size(dims: tuple[int, ...]) -> tuple[int, ...]:
    side = {1: 65536, 2: 512, 3: 128}.get(len(dims), 64)
    return tuple(min(side, d) for d in dims)


@dataclass(frozen=True)
class Shard:
    """One level of shards: their size in pixels, how their index is stored, and byte codecs of the shard as a whole."""

    size: tuple[int, ...]
    index_chain: Chain = field(default_factory=list)
    index_at_end: bool = True
    index_little: bool = False
    chain: Chain = field(default_factory=list)


@dataclass(frozen=True)
class Dataset:
    """``shards`` are the levels of shards, from the one that holds chunks to the one that is stored.

    ``chain`` codes the bytes of a chunk, after ``layout``, a registered block codec ("default" has a
    header, "raw-bytes" has none), and ``arrays``, registered array codecs such as ``transpose``, of
    which the last one listed is applied first."""

    dims: tuple[int, ...]
    chunk: tuple[int, ...]
    data_type: str
    chain: Chain = field(default_factory=list)
    shards: tuple[Shard, ...] = ()
    arrays: Chain = field(default_factory=list)
    layout: tuple[str, dict[str, Any]] = ("default", {})
    default: Any = None
    names: CodecNames = field(default=CodecNames(), compare=False)

    def __post_init__(self) -> None:
        if element_type(self.data_type) is None:
            raise ValueError(f"unknown data type {self.data_type}")
        self.grid  # validates the sizes
        for name, _ in [*self.chain, *(c for s in self.shards for c in (*s.chain, *s.index_chain))]:
            if name not in codecs.CODECS:
                raise StoreError(f"no codec named {name}")
        for name, params in self.arrays:
            if name not in codecs.ARRAY_CODECS:
                raise StoreError(f"no array codec named {name}")
            if name == "transpose" and sorted(params["order"]) != list(range(len(self.dims))):
                raise StoreError("the order of a transposition must name each dimension once")
        if self.layout[0] not in codecs.BLOCK_CODECS:
            raise StoreError(f"no block codec named {self.layout[0]}")

    @cached_property
    def grid(self) -> NestedGrid:
        return NestedGrid((self.chunk, *(s.size for s in self.shards)), self.dims)

    @property
    def block(self) -> tuple[int, ...]:
        """Size of what is stored under one key."""
        return self.shards[-1].size if self.shards else self.chunk

    @property
    def fill(self) -> Any:
        """The value of absent cells: the default of the metadata, floats also as ``NaN`` or a bit pattern; else None."""
        return parse_float(self.default) if isinstance(self.default, str) and self.data_type.startswith("float") else self.default

    def index_bytes(self, level: int) -> int:
        """Size of the index of a shard of a level, 1 for those that hold chunks."""
        return index_size(prod(self.grid.relative_size(level)), self.shards[level - 1].index_chain)

    def _codecs(self, level: int) -> list[dict[str, Any]]:
        node = lambda name, conf: {"name": name, "configuration": dict(conf)}
        if level == 0:
            named = {"default": self.names.block, "raw-bytes": self.names.raw, "transpose": self.names.transpose}
            return [*(node(named.get(n, n), c) for n, c in self.arrays), node(named.get(self.layout[0], self.layout[0]), self.layout[1]), *(node(n, c) for n, c in self.chain)]
        shard = self.shards[level - 1]
        conf = {
            "chunk_shape": list(reversed(self.grid.block_sizes[level - 1])),
            "codecs": self._codecs(level - 1),
            "index_location": "end" if shard.index_at_end else "start",
            "index_codecs": [node(self.names.raw, {"endian": "little" if shard.index_little else "big"}), *(node(n, c) for n, c in shard.index_chain)],
        }
        return [node(self.names.shard, conf), *(node(n, c) for n, c in shard.chain)]

    def to_json(self) -> dict[str, Any]:
        """``blockSize`` is the size of what is stored. A chain of one byte codec is ``compression``; anything else
        is ``codecs``, those of the chunks of a shard nested in those of the shard."""
        out: dict[str, Any] = {"dimensions": list(self.dims), "blockSize": list(self.block), "dataType": self.data_type}
        name, params = self.chain[0] if self.chain else ("raw", {})
        if self.shards or self.arrays or self.layout != ("default", {}) or len(self.chain) > 1:
            out["codecs"] = self._codecs(len(self.shards))
        else:
            out["compression"] = {"type": name} | params
        if self.default is not None:
            out["defaultValue"] = self.default
        return out

    @staticmethod
    def from_json(node: Any, names: CodecNames = CodecNames()) -> Dataset | None:
        """The dataset that attributes describe, or None. Newer metadata win: ``codecs``, then
        ``compression``, then the bare ``compressionType`` of the first generation.

        A codec that isn't registered, or metadata of shards that don't fit, raise a StoreError."""
        if not isinstance(node, Mapping) or not all(k in node for k in ("dimensions", "blockSize", "dataType")):
            return None
        if element_type(node["dataType"]) is None:
            return None
        dims, size = tuple(node["dimensions"]), tuple(node["blockSize"])
        default = node.get("defaultValue")
        if "codecs" in node:
            try:
                chunk, shards, arrays, layout, chain = _parse_codecs(node["codecs"], size, names)
            except (KeyError, TypeError, AttributeError) as e:
                raise StoreError(f"metadata of codecs aren't understood: {e!r}") from e
            return Dataset(dims, chunk, node["dataType"], chain, shards, arrays, layout, default, names)
        if isinstance(node.get("compression"), Mapping):
            conf = dict(node["compression"])
            name = conf.pop("type")
        elif "compressionType" in node:
            name, conf = node["compressionType"], {}
        else:
            return None
        return Dataset(dims, size, node["dataType"], [] if name == "raw" else [(name, conf)], default=default, names=names)


def _pairs(nodes: Sequence[Mapping[str, Any]]) -> Chain:
    return [(n["name"], dict(n.get("configuration") or {})) for n in nodes]


def _parse_codecs(nodes: Sequence[Mapping[str, Any]], size: tuple[int, ...], names: CodecNames) -> tuple:
    """(chunk size, shards, array codecs, block codec, byte codecs) of a list of codecs for blocks of a size."""
    own = {names.block: "default", names.raw: "raw-bytes", names.transpose: "transpose", names.shard: "sharding_indexed"}
    arrays: Chain = []
    layout: tuple[str, dict[str, Any]] | None = None
    chain: Chain = []
    for name, conf in _pairs(nodes):
        name = own.get(name, name)
        if layout is None and name in codecs.ARRAY_CODECS:
            arrays.append((name, conf))
        elif layout is None and (name in codecs.BLOCK_CODECS or name == "sharding_indexed"):
            layout = name, conf
        elif name != "raw":  # coded bytes, in a block of the default layout if none was named
            chain.append((name, conf))
            layout = layout or ("default", {})
    name, conf = layout or ("default", {})
    if name != "sharding_indexed":
        return size, (), arrays, (name, conf), chain
    chunk, inner, inside, layout, inner_chain = _parse_codecs(conf["codecs"], tuple(reversed(conf["chunk_shape"])), names)
    if arrays and inside:
        raise StoreError("array codecs both inside and outside of shards")
    index = _pairs(conf.get("index_codecs") or [])
    little = False
    if index and own.get(index[0][0]) == "raw-bytes":
        little = index.pop(0)[1].get("endian", "big") == "little"
    shard = Shard(size, index, conf.get("index_location", "end") == "end", little, chain)
    return chunk, (*inner, shard), arrays or inside, layout, inner_chain
