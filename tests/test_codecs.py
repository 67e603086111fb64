import numpy as np
import pytest

from voxloom.errors import ChecksumError, StoreError
from voxloom.sources import codecs
from voxloom.sources.codecs import Block

HEADER = "00000003000000010000000200000003"
RAW = "000100020003000400050006"
#: Fixed values of the format: payloads of the values 1 to 6 as 16-bit numbers.
GOLDEN = {
    "raw": RAW,
    "bzip2": "425a6839314159265359023e0dd200000040007f002000310c010d31a87394337c5dc914e1424008f83748",
    "gzip": "1f8b08000000000000006360646062606660616065600300aaea6dbf0c000000",
    "xz": "fd377a585a000004e6d6b4460200210116000000742fe5a301000b000100020003000400050006000d0309ca34ec15a70001240ca618d8d81fb6f37d010000000004595a",
    "lz4": "4c5a34426c6f636b160c0000000c00000090258b060001000200030004000500064c5a34426c6f636b16000000000000000000000000",
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_bytes(name):
    data = codecs.encode_block(Block((1, 2, 3), np.arange(1, 7)), "uint16", [(name, {})])
    assert data[:16].hex() == HEADER
    known = bytes.fromhex(HEADER + GOLDEN[name])
    assert codecs.decode_block(known, "uint16", [(name, {})]).data.tolist() == [1, 2, 3, 4, 5, 6]
    if name not in ("bzip2", "xz"):  # whose encoders differ in their choices
        assert data[16:].hex() == GOLDEN[name]


def test_crc32c():
    assert codecs.crc32c(b"123456789") == 0xE3069283
    long = bytes(range(256)) * 100
    crc = 0xFFFFFFFF
    for b in long:
        crc = int(codecs._CRC32C[(crc ^ b) & 255]) ^ (crc >> 8)
    assert codecs.crc32c(long) == crc ^ 0xFFFFFFFF
    coded = codecs.encode(b"abc", [("crc32c", {})])
    assert len(coded) == 7 and codecs.decode(coded, [("crc32c", {})]) == b"abc"
    with pytest.raises(ChecksumError):
        codecs.decode(coded[:-1] + b"\0", [("crc32c", {})])


@pytest.mark.parametrize("label", ["uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64", "float32", "float64"])
@pytest.mark.parametrize("chain", [[], [("gzip", {})], [("gzip", {"level": 5, "useZlib": True})], [("bzip2", {})], [("lz4", {"blockSize": 1024})], [("xz", {})], [("lz4", {}), ("crc32c", {})]])
def test_round_trip(label, chain):
    values = np.random.default_rng(1).integers(0, 100, 3 * 5 * 7).astype(codecs.dtype(label))
    for size, data in (((3, 5, 7), values), ((3, 5, 7), values[:50]), ((0, 5, 7), values[:0])):
        back = codecs.decode_block(codecs.encode_block(Block(size, data), label, chain), label, chain)
        assert back.size == size and back.data.tobytes() == data.tobytes()


def test_text_and_objects():
    words = ["", "a", "üb"]
    for few in ([], ["x"], ["", ""]):
        back = codecs.decode_block(codecs.encode_block(Block((len(few),), few), "string", []), "string", []).data
        assert back == few or (few == ["", ""] and back == [""])  # the form ends texts by NUL and can't tell empty ones at its end
    assert codecs.decode_block(codecs.encode_block(Block((3,), words), "string", [("gzip", {})]), "string", [("gzip", {})]).data == words
    block = codecs.decode_block(codecs.encode_block(Block(None, b"\x00x"), "object", []), "object", [])
    assert block.size is None and block.data == b"\x00x"
    with pytest.raises(StoreError):
        codecs.decode_block(codecs.encode_block(Block(None, b"x"), "object", []), "uint8", [])
    with pytest.raises(StoreError):
        codecs.encode_raw_block(Block((1,), b"x"), "object", [])


def test_raw_blocks():
    for little in (True, False):
        data = codecs.encode_raw_block(Block((2,), [1, 2]), "int32", [], little)
        assert codecs.decode_raw_block(data, "int32", [], (2,), little).data.tolist() == [1, 2]
    assert data == b"\0\0\0\1\0\0\0\2"
    texts = codecs.encode_raw_block(Block((3,), ["a", "", "üb"]), "string", [])
    assert texts.hex() == "03000000" + "0100000061" + "00000000" + "03000000c3bc62" and codecs.decode_raw_block(texts, "string", [], (3,)).data == ["a", "", "üb"]


@pytest.mark.parametrize("at_end", [True, False])
@pytest.mark.parametrize("chain", [[], [("crc32c", {})]])
def test_shards(at_end, chain):
    chunks = [b"abc", None, b"", b"de"]
    data = codecs.encode_shard(chunks, chain, at_end)
    assert len(data) == 16 * 4 + 4 * len(chain) + 5
    assert codecs.decode_shard(data, 4, chain, at_end) == chunks


def test_transpose():
    block = Block((2, 3), np.arange(6))
    turned = codecs.transpose_block(block, (1, 0))
    assert turned.data.tolist() == [0, 2, 4, 1, 3, 5]
    assert codecs.transpose_block(turned, (1, 0), inverse=True).data.tolist() == list(range(6))
    cube = Block((2, 3, 4), np.arange(24))
    assert codecs.transpose_block(codecs.transpose_block(cube, (2, 0, 1)), (2, 0, 1), inverse=True).data.tolist() == list(range(24))


def test_ranges():
    assert codecs.coalesce([(0, 5), (1, 1)]) == [(0, 5)]
    assert codecs.coalesce([(0, 5), (2, 5)]) == [(0, 7)]
    assert codecs.coalesce([(0, 5), (5, 1)]) == [(0, 6)]
    assert codecs.coalesce([(3, 2), (0, 2), (5, 1)]) == [(0, 2), (3, 3)]


def test_read_plans():
    wanted = [(10, 5), (0, 2), (2, 3)]
    assert codecs.plan_reads(wanted) == [(0, 5), (10, 5)] and codecs.plan_reads(wanted, "enclosing") == [(0, 15)]
    assert codecs.plan_reads(wanted, "none") == [(0, 2), (2, 3), (10, 5)] and codecs.plan_reads([], "enclosing") == []


def test_registry_and_sizes():
    codecs.register_codec("flip", lambda d, p: bytes(b ^ p["mask"] for b in d), lambda d, p: bytes(b ^ p["mask"] for b in d), growth=0, mask=255)
    assert codecs.decode(codecs.encode(b"ab", [("flip", {}), ("gzip", {})]), [("flip", {}), ("gzip", {})]) == b"ab"
    assert codecs.encoded_size(10, [("flip", {}), ("crc32c", {})]) == 14
    with pytest.raises(StoreError):
        codecs.encoded_size(10, [("gzip", {})])
    with pytest.raises(StoreError):
        codecs.encode(b"", [("nothing", {})])


def test_float_bits():
    for v in (1.5, -0.0, float("inf")):
        assert codecs.parse_float(codecs.float_bits(v)) == v
    assert codecs.parse_float("0x3fc00000") == 1.5 and codecs.parse_float("NaN") != codecs.parse_float("NaN")
