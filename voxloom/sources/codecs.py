"""Byte codecs of chunks: compressions, checksum, block formats, shards, and their registry."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np

from voxloom.errors import ChecksumError, StoreError
from voxloom.types import dtype

Params = dict[str, Any]


@dataclass(frozen=True)
class DataCodec:
    """``encode`` and ``decode`` bytes under parameters; ``growth`` is the number of bytes added if that is fixed."""

    name: str
    encode: Callable[[bytes, Params], bytes]
    decode: Callable[[bytes, Params], bytes]
    defaults: Params = field(default_factory=dict)
    growth: int | None = None


CODECS: dict[str, DataCodec] = {}


def register_codec(name: str, encode: Callable[[bytes, Params], bytes], decode: Callable[[bytes, Params], bytes], growth: int | None = None, **defaults: Any) -> None:
    """Adds a compression or other byte codec under the name that metadata has for it."""
    CODECS[name] = DataCodec(name, encode, decode, defaults, growth)


def _gzip_encode(data: bytes, p: Params) -> bytes:
    if p["useZlib"]:
        return zlib.compress(data, p["level"])
    packed = gzip.compress(data, p["level"], mtime=0)
    return packed[:8] + b"\0\0" + packed[10:]  # neither flags nor a system in the header, whatever wrote it


# LZ4 block streams: blocks of a header and LZ4 data, ended by an empty one. Fixed values of the format.
_LZ4_MAGIC = b"LZ4Block"
_LZ4_RAW, _LZ4_PACKED = 0x10, 0x20
_LZ4_SEED = 0x9747B28C
_LZ4_CHECK_BITS = 0x0FFFFFFF
_LZ4_HEADER = struct.Struct("<8sBIII")


def _lz4_encode(data: bytes, p: Params) -> bytes:
    import pyarrow as pa
    import xxhash

    size, codec, out = p["blockSize"], pa.Codec("lz4_raw"), []
    level = max(0, (size - 1).bit_length() - 10)
    for at in range(0, len(data), size):
        raw = data[at : at + size]
        packed = codec.compress(raw, asbytes=True)
        kind, body = (_LZ4_PACKED, packed) if len(packed) < len(raw) else (_LZ4_RAW, raw)
        check = xxhash.xxh32_intdigest(raw, _LZ4_SEED) & _LZ4_CHECK_BITS
        out.append(_LZ4_HEADER.pack(_LZ4_MAGIC, kind | level, len(body), len(raw), check) + body)
    return b"".join(out) + _LZ4_HEADER.pack(_LZ4_MAGIC, _LZ4_RAW | level, 0, 0, 0)


def _lz4_decode(data: bytes, p: Params) -> bytes:
    import pyarrow as pa
    import xxhash

    codec, out, at = pa.Codec("lz4_raw"), [], 0
    while at < len(data):
        magic, token, packed, size, check = _LZ4_HEADER.unpack_from(data, at)
        if magic != _LZ4_MAGIC:
            raise StoreError("not an LZ4 block stream")
        at += _LZ4_HEADER.size
        if not size:
            break
        body = data[at : at + packed]
        raw = body if token & 0xF0 == _LZ4_RAW else codec.decompress(body, size, asbytes=True)
        if xxhash.xxh32_intdigest(raw, _LZ4_SEED) & _LZ4_CHECK_BITS != check:
            raise ChecksumError("an LZ4 block is damaged")
        out.append(raw)
        at += packed
    return b"".join(out)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


_CRC32C = _crc_table()


@lru_cache(maxsize=64)
def _shifted_basis(n: int) -> np.ndarray:
    """What each single bit of a CRC register becomes after ``n`` zero bytes."""
    x = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(n):
        x = _CRC32C[x & 0xFF] ^ (x >> np.uint32(8))
    return x


def crc32c(data: bytes) -> int:
    """CRC-32C. Long inputs are folded in parallel lanes, which are then joined."""
    raw = np.frombuffer(data, np.uint8)
    lanes = 1 if len(raw) < 4096 else 256
    width = -(-max(len(raw), 4) // lanes)
    grid = np.zeros(lanes * width, np.uint8)
    grid[len(grid) - len(raw) :] = raw
    # the register starts with ones: the same as inverting the first four bytes
    lead = len(grid) - len(raw)
    grid[lead : lead + 4] ^= 0xFF
    if len(raw) < 4:
        crc = 0xFFFFFFFF
        for b in data:
            crc = int(_CRC32C[(crc ^ b) & 0xFF]) ^ (crc >> 8)
        return crc ^ 0xFFFFFFFF
    grid = grid.reshape(lanes, width)
    state = np.zeros(lanes, np.uint32)
    for column in grid.T:
        state = _CRC32C[(state ^ column) & 0xFF] ^ (state >> np.uint32(8))
    total = np.uint32(0)
    basis = _shifted_basis(width) if lanes > 1 else None
    for lane in state:
        if basis is not None:
            bits = (total >> np.arange(32, dtype=np.uint32)) & 1
            total = np.bitwise_xor.reduce(np.where(bits, basis, 0).astype(np.uint32))
        total ^= lane
    return int(total) ^ 0xFFFFFFFF


def _crc_encode(data: bytes, p: Params) -> bytes:
    return data + struct.pack("<I", crc32c(data))


def _crc_decode(data: bytes, p: Params) -> bytes:
    body, stored = data[:-4], struct.unpack("<I", data[-4:])[0]
    if crc32c(body) != stored:
        raise ChecksumError("CRC-32C differs")
    return body


register_codec("raw", lambda d, p: d, lambda d, p: d, growth=0)
register_codec("id", lambda d, p: d, lambda d, p: d, growth=0)
register_codec("gzip", _gzip_encode, lambda d, p: zlib.decompress(d) if p["useZlib"] else gzip.decompress(d), level=6, useZlib=False)
register_codec("bzip2", lambda d, p: bz2.compress(d, p["blockSize"]), lambda d, p: bz2.decompress(d), blockSize=9)
register_codec("xz", lambda d, p: lzma.compress(d, preset=p["preset"]), lambda d, p: lzma.decompress(d), preset=6)
register_codec("lz4", _lz4_encode, _lz4_decode, blockSize=65536)
register_codec("crc32c", _crc_encode, _crc_decode, growth=4)

Chain = list[tuple[str, Params]]


def _bound(name: str, params: Params) -> tuple[DataCodec, Params]:
    codec = CODECS.get(name)
    if codec is None:
        raise StoreError(f"no codec named {name}")
    return codec, codec.defaults | {k: v for k, v in params.items() if k in codec.defaults or not codec.defaults}


def encode(data: bytes, chain: Chain) -> bytes:
    """Through a chain of codecs, first to last."""
    for name, params in chain:
        codec, p = _bound(name, params)
        data = codec.encode(data, p)
    return data


def decode(data: bytes, chain: Chain) -> bytes:
    for name, params in reversed(chain):
        codec, p = _bound(name, params)
        data = codec.decode(data, p)
    return data


def encoded_size(size: int, chain: Chain) -> int:
    """Size after a chain, if all its codecs add a fixed number of bytes."""
    for name, _ in chain:
        growth = CODECS[name].growth
        if growth is None:
            raise StoreError(f"the size after {name} isn't fixed")
        size += growth
    return size


# modes of the default block header: fixed values of the format
DEFAULT, VARLENGTH, OBJECT = 0, 1, 2


@dataclass
class Block:
    """A chunk: its size by dimension (None for an opaque object) and its elements."""

    size: tuple[int, ...] | None
    data: Any


def _payload(data: Any, label: str, little: bool = False) -> bytes:
    if label == "object":
        return bytes(data)
    if label == "string":
        return "\0".join(data).encode() + b"\0"
    kind = dtype(label, little)
    return (data.astype(kind) if isinstance(data, np.ndarray) else np.array(data, kind)).tobytes()


def _elements(raw: bytes, label: str, little: bool = False) -> Any:
    if label == "object":
        return raw
    if label == "string":
        return raw.decode().removesuffix("\0").split("\0") if raw.strip(b"\0") else [""] * (len(raw) - 1)
    return np.frombuffer(raw, dtype(label, little))


def encode_block(block: Block, label: str, chain: Chain) -> bytes:
    """Header (mode, rank, sizes, and the number of elements if it isn't their product) and the coded payload."""
    raw = _payload(block.data, label)
    if block.size is None:
        head = struct.pack(">HI", OBJECT, len(raw))
    else:
        count = len(raw) if label in ("string", "object") else len(block.data)
        sizes = struct.pack(f">HH{len(block.size)}I", 0, len(block.size), *block.size)
        if count == int(np.prod(block.size)) and label != "string":
            head = sizes
        else:
            head = struct.pack(">H", VARLENGTH) + sizes[2:] + struct.pack(">I", count)
    return head + encode(raw, chain)


def decode_block(data: bytes, label: str, chain: Chain) -> Block:
    (mode,) = struct.unpack_from(">H", data)
    if mode not in ((OBJECT,) if label == "object" else (DEFAULT, VARLENGTH)) and not (label == "object" and mode == VARLENGTH):
        raise StoreError(f"mode {mode} doesn't fit type {label}")
    if mode == OBJECT:
        return Block(None, decode(data[6:], chain))
    (rank,) = struct.unpack_from(">H", data, 2)
    size = struct.unpack_from(f">{rank}I", data, 4)
    at = 4 + 4 * rank + (4 if mode == VARLENGTH else 0)
    return Block(size, _elements(decode(data[at:], chain), label))


def pack_strings(data: list[str]) -> bytes:
    """Texts of raw blocks: their number, then each length and its bytes, numbers little-endian."""
    coded = [x.encode() for x in data]
    return struct.pack("<I", len(coded)) + b"".join(struct.pack("<I", len(x)) + x for x in coded)


def unpack_strings(raw: bytes) -> list[str]:
    out, at = [], 4
    for _ in range(struct.unpack_from("<I", raw)[0]):
        (n,) = struct.unpack_from("<I", raw, at)
        if at + 4 + n > len(raw):
            raise StoreError("a block of texts is cut short")
        out.append(raw[at + 4 : at + 4 + n].decode())
        at += 4 + n
    return out


def encode_raw_block(block: Block, label: str, chain: Chain, little: bool = False) -> bytes:
    """No header: elements in the chosen byte order; all blocks have the configured size."""
    if label == "object":
        raise StoreError("raw blocks hold no objects")
    return encode(pack_strings(block.data) if label == "string" else _payload(block.data, label, little), chain)


def decode_raw_block(data: bytes, label: str, chain: Chain, size: tuple[int, ...], little: bool = False) -> Block:
    raw = decode(data, chain)
    return Block(size, unpack_strings(raw) if label == "string" else _elements(raw, label, little))


def transpose_block(block: Block, order: tuple[int, ...], inverse: bool = False) -> Block:
    """Elements with their dimensions permuted: dimension d of the stored data is ``order[d]``. The size stays as it was."""
    assert block.size is not None
    if sorted(order) != list(range(len(block.size))):
        raise StoreError("order must name each dimension once")
    turn = tuple(np.argsort(order)) if inverse else order
    size = tuple(block.size[o] for o in order) if inverse else block.size
    cube = np.asarray(block.data).reshape(size, order="F")
    return Block(block.size, np.transpose(cube, turn).ravel(order="F"))


@dataclass(frozen=True)
class BlockCodec:
    """Chunks as bytes: ``encode(block, label, chain, params)`` and ``decode(data, label, chain, size, params)``,
    where ``size`` is the configured size of a chunk."""

    encode: Callable[[Block, str, Chain, Params], bytes]
    decode: Callable[[bytes, str, Chain, tuple[int, ...], Params], Block]


@dataclass(frozen=True)
class ArrayCodec:
    """Changes the elements of a chunk before its bytes are made: ``encode(block, params)`` and ``decode``."""

    encode: Callable[[Block, Params], Block]
    decode: Callable[[Block, Params], Block]


BLOCK_CODECS: dict[str, BlockCodec] = {
    "default": BlockCodec(lambda b, label, chain, p: encode_block(b, label, chain), lambda d, label, chain, size, p: decode_block(d, label, chain)),
    "raw-bytes": BlockCodec(
        lambda b, label, chain, p: encode_raw_block(b, label, chain, p.get("endian", "big") == "little"),
        lambda d, label, chain, size, p: decode_raw_block(d, label, chain, size, p.get("endian", "big") == "little"),
    ),
}
ARRAY_CODECS: dict[str, ArrayCodec] = {
    "transpose": ArrayCodec(lambda b, p: transpose_block(b, tuple(p["order"])), lambda b, p: transpose_block(b, tuple(p["order"]), inverse=True)),
}


ABSENT = (1 << 64) - 1


def index_size(chunks: int, chain: Chain) -> int:
    return encoded_size(16 * chunks, chain)


def encode_shard(chunks: list[bytes | None], index_chain: Chain, index_at_end: bool = True, little: bool = False) -> bytes:
    """Chunks in index order, absent ones skipped, with an index of (offset, size) for each."""
    head = 0 if index_at_end else index_size(len(chunks), index_chain)
    index, at = np.full((len(chunks), 2), ABSENT, np.uint64), head
    for i, c in enumerate(chunks):
        if c is not None:
            index[i] = at, len(c)
            at += len(c)
    coded = encode(index.astype("<u8" if little else ">u8").tobytes(), index_chain)
    body = b"".join(c for c in chunks if c is not None)
    return body + coded if index_at_end else coded + body


def decode_index(coded: bytes, index_chain: Chain, little: bool = False) -> np.ndarray:
    """(chunks, 2): offset and size, both ABSENT for a chunk that isn't there."""
    return np.frombuffer(decode(coded, index_chain), "<u8" if little else ">u8").reshape(-1, 2)


def decode_shard(data: bytes, chunks: int, index_chain: Chain, index_at_end: bool = True, little: bool = False) -> list[bytes | None]:
    size = index_size(chunks, index_chain)
    index = decode_index(data[len(data) - size :] if index_at_end else data[:size], index_chain, little)
    return [None if int(o) == ABSENT else data[int(o) : int(o) + int(n)] for o, n in index]


def coalesce(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjacent (offset, size) ranges joined, for fewer reads."""
    out: list[tuple[int, int]] = []
    for off, size in sorted(ranges):
        if out and off <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], off + size - out[-1][0]))
        else:
            out.append((off, size))
    return out


def plan_reads(ranges: list[tuple[int, int]], policy: str = "aggregate") -> list[tuple[int, int]]:
    """Ranges to read for wanted ones: as they are ("none"), joined where they touch ("aggregate"), or one for all ("enclosing")."""
    if policy == "none" or not ranges:
        return sorted(set(ranges))
    if policy == "aggregate":
        return coalesce(ranges)
    if policy == "enclosing":
        low = min(off for off, _ in ranges)
        return [(low, max(off + n for off, n in ranges) - low)]
    raise ValueError(f"no prefetch policy {policy}")


def float_bits(value: float, wide: bool = True) -> str:
    """The bit pattern of a number as ``0x`` and hex digits."""
    return "0x" + struct.pack(">d" if wide else ">f", value).hex()


def parse_float(text: str) -> float:
    """A number, ``NaN``, ``Infinity``, ``-Infinity`` or a bit pattern of 8 or 16 hex digits."""
    if text.startswith("0x"):
        raw = bytes.fromhex(text[2:])
        return struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0]
    return float(text)
