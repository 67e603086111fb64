import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.errors import AttributeParseError, AttributeTypeError, NoSuchKeyError, StoreError, StoreIOError
from voxloom.functions.grid import NestedGrid, Region
from voxloom.operators import intervals
from voxloom.operators.scans import Scan
from voxloom.functions.versions import CURRENT, Version
from voxloom.operators.tensor import TensorFrame
from voxloom.sources import catalog, codecs
from voxloom.sources.chunkstore import ChunkReader, apply_changes, apply_staged, decode_chunk, delete_chunks, encode_chunk, encode_stored, read_chunks, read_positions, stage_changes, write_chunks
from voxloom.sources.codecs import Block
from voxloom.sources.dataset import CodecNames, Dataset, Shard, default_block_size
from voxloom.sources.store import Container, replace_file
from voxloom.sources.tensors import update_region


@pytest.mark.parametrize("sizes", [((0,),), ((-1,),), ((2,), (3, 3)), ((4,), (2,)), ((2,), (3,)), ()])
def test_invalid_grids(sizes):
    with pytest.raises(ValueError):
        NestedGrid(sizes)


def test_nested_positions(spark):
    grid = NestedGrid(((1,), (3,), (6,), (24,)))
    p = [F.lit(38)]
    row = spark.range(1).select(*[grid.absolute(p, 0, i)[0] for i in range(4)], *[grid.relative(p, 0, i)[0] for i in range(4)]).first()
    assert list(row) == [38, 12, 6, 1, 2, 0, 2, 1]


def test_dense_blocks_and_regions(spark):
    rows = [(x, y, x + 10 * y) for x in range(5) for y in range(3) if (x + y) % 2]
    df = spark.createDataFrame(rows, "x long, y long, v long")
    t = TensorFrame.from_table(df, [F.col("x"), F.col("y")], F.col("v"), (5, 3), (2, 2), (4, 2))
    got = {(r.g0, r.g1): r.data for r in t.dense_blocks().collect()}
    cube = np.zeros((5, 3), int)
    for x, y, v in rows:
        cube[x, y] = v
    for (a, b), data in got.items():
        assert data == cube[4 * a : 4 * a + 4, 2 * b : 2 * b + 2].ravel(order="F").tolist()
    assert sorted(got) == [(0, 0), (0, 1), (1, 0)]  # a block without cells is absent
    assert t.region(Region((1, 1), (2, 2))).df.count() == 2
    assert sorted(map(tuple, t.transpose([1, 0]).df.select("x0", "x1", "value").collect())) == sorted((y, x, v) for x, y, v in rows)


def test_metadata_generations():
    base = {"dimensions": [4, 4], "blockSize": [2, 2], "dataType": "uint8"}
    assert Dataset.from_json(base) is None and Dataset.from_json([1]) is None
    assert Dataset.from_json(base | {"compressionType": "gzip"}).chain == [("gzip", {})]
    assert Dataset.from_json(base | {"compressionType": "gzip", "compression": {"type": "raw"}}).chain == []
    full = Dataset((8, 8), (2, 2), "int16", [("gzip", {"level": 5})], (Shard((4, 4), [("crc32c", {})]), Shard((8, 8), [], False, False)), arrays=[("transpose", {"order": [1, 0]})], default=3)
    assert Dataset.from_json(full.to_json()) == full and full.to_json()["blockSize"] == [8, 8]
    assert default_block_size((70000,)) == (65536,) and default_block_size((600, 100)) == (512, 100) and default_block_size((99, 200, 300)) == (99, 128, 128)


def test_nested_codecs():
    node = {
        "dimensions": [100, 60], "blockSize": [40, 20], "dataType": "float32", "defaultValue": "0x7fc00000",
        "codecs": [{"name": "sharding_indexed", "configuration": {
            "chunk_shape": [10, 20], "index_location": "start", "index_codecs": [{"name": "raw-bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}],
            "codecs": [{"name": "sharding_indexed", "configuration": {
                "chunk_shape": [5, 4], "index_codecs": [{"name": "raw-bytes"}],
                "codecs": [{"name": "turned", "configuration": {"order": [1, 0]}}, {"name": "turned", "configuration": {"order": [1, 0]}}, {"name": "bare", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 2}}],
            }}, {"name": "crc32c"}],
        }}],
    }
    names = CodecNames(raw="bare", transpose="turned")
    node["codecs"][0]["configuration"]["index_codecs"][0]["name"] = node["codecs"][0]["configuration"]["codecs"][0]["configuration"]["index_codecs"][0]["name"] = "bare"
    ds = Dataset.from_json(node, names)
    assert (ds.chunk, ds.block, ds.grid.block_sizes) == ((4, 5), (40, 20), ((4, 5), (20, 10), (40, 20)))
    assert ds.shards == (Shard((20, 10), chain=[("crc32c", {})]), Shard((40, 20), [("crc32c", {})], False, True))
    assert (ds.chain, ds.layout, len(ds.arrays), ds.fill != ds.fill) == ([("gzip", {"level": 2})], ("raw-bytes", {"endian": "little"}), 2, True)
    assert Dataset.from_json(ds.to_json(), names) == ds
    base = {"dimensions": [4], "blockSize": [2], "dataType": "uint8"}
    plain = Dataset.from_json(base | {"codecs": [{"name": "default"}, {"name": "gzip"}]})
    assert plain.to_json()["compression"] == {"type": "gzip"} and Dataset.from_json(base | {"codecs": [{"name": "gzip"}]}) == plain
    for bad in ([{"name": "nothing"}], [{"name": "sharding_indexed", "configuration": {"shard_shape": [2]}}], [{"name": "transpose", "configuration": {"order": [1]}}], [{}]):
        with pytest.raises(StoreError):
            Dataset.from_json(base | {"codecs": bad})


def test_own_block_and_array_codecs(spark, tmp_path):
    codecs.BLOCK_CODECS["framed"] = codecs.BlockCodec(
        lambda b, label, chain, p: p["mark"].encode() + codecs.encode_raw_block(b, label, chain), lambda d, label, chain, size, p: codecs.decode_raw_block(d[len(p["mark"]) :], label, chain, size)
    )
    codecs.ARRAY_CODECS["negated"] = codecs.ArrayCodec(lambda b, p: Block(b.size, -np.asarray(b.data)), lambda b, p: Block(b.size, -b.data))
    try:
        ds = Dataset((4, 4), (2, 2), "int32", [("gzip", {})], arrays=[("negated", {}), ("transpose", {"order": [1, 0]})], layout=("framed", {"mark": "xy"}))
        raw = encode_chunk(Block((2, 2), np.arange(4)), ds)
        assert raw[:2] == b"xy" and codecs.decode(raw[2:], [("gzip", {})]) == np.array([0, -2, -1, -3], ">i4").tobytes()
        assert decode_chunk(raw, ds).data.tolist() == [0, 1, 2, 3] and Dataset.from_json(ds.to_json()) == ds
    finally:
        del codecs.BLOCK_CODECS["framed"], codecs.ARRAY_CODECS["negated"]


def test_container(tmp_path):
    with pytest.raises(NoSuchKeyError):
        Container(str(tmp_path / "none"))
    box = Container(str(tmp_path / "box"), create=True)
    assert box.version().major == 4 and box.attributes("a") is None and not box.exists("a")
    with pytest.raises(NoSuchKeyError):
        box.set_attribute("a", "x", 1)
    box.create_group("a/b")
    box.set_attributes("a/b", {"x[1]/y": 2.5, "t": "text", "l": [1, 2]})
    assert box.get_attribute("a/b", "x[1]/y") == 2.5 and box.get_attribute("a/b", "l", str) == "[1,2]" and box.list_attributes("a/b")["l"] == "long[]"
    with pytest.raises(AttributeTypeError):
        box.get_attribute("a/b", "t", int)
    with pytest.raises(AttributeTypeError):
        box.remove_attribute("a/b", "t", int)
    assert box.remove_attribute("a/b", "t", str) == "text" and box.remove_attributes("a/b", ["t", "l"]) and not box.remove_attributes("a/b", ["l"])
    box.create_dataset("d", Dataset((3,), (2,), "int8"))
    box.set_attribute("d", "note", "kept")
    box.set_dataset("d", Dataset((9,), (2,), "int8", [("gzip", {}), ("crc32c", {})]))
    assert box.dataset("d").dims == (9,) and box.dataset("d").chain == [("gzip", {}), ("crc32c", {})] and box.get_attribute("d", "note") == "kept" and "compression" not in box.attributes("d")
    box.set_attributes("a/b", {"dimensions": [1], "dataType": "int8"})
    assert box.dataset_exists("a/b", weak=True) and not box.dataset_exists("a/b") and not box.dataset_exists("a", weak=True)
    box.set_version(CURRENT)
    with pytest.raises(StoreIOError):
        box.set_version(Version(3))
    assert box.list() == ["a", "d"] and box.dataset_exists("d") and not box.dataset_exists("a")
    box.replace_attributes("a", 5)
    assert box.attributes("a") == 5
    (tmp_path / "box/a/attributes.json").write_text("{")
    with pytest.raises(AttributeParseError):
        box.attributes("a")
    assert box.remove("a") and box.remove("a") and not box.exists("a")
    box.set_attribute("", box.version_key, "9.0.0")
    with pytest.raises(StoreIOError):
        Container(str(tmp_path / "box"))


def _chunks(spark, positions):
    rows = [(*p, [2, 2], 4, [sum(p) + i for i in range(4)]) for p in positions]
    return spark.createDataFrame(rows, "g0 long, g1 long, size array<int>, num_elements int, data array<int>")


@pytest.mark.parametrize("shard", [(), (Shard((8, 8), [("crc32c", {})]),), (Shard((4, 4), [("crc32c", {})]), Shard((8, 8), index_at_end=False, index_little=True))])
def test_store(spark, tmp_path, shard):
    uri = str(tmp_path / "box")
    box = Container(uri, create=True)
    box.create_dataset("t", Dataset((24, 24), (2, 2), "int32", [("lz4", {})], shard))
    places = [(0, 0), (0, 1), (1, 0), (1, 1), (4, 0), (5, 0), (11, 11)]
    write_chunks(_chunks(spark, places), uri, "t")
    read = lambda *w: sorted((r.g0, r.g1, list(r.data)) for r in read_chunks(spark, uri, "t", *w).collect())
    assert [x[:2] for x in read()] == places
    if shard:
        assert [box.block_exists("t", k) for k in ((0, 0), (1, 0), (2, 2), (0, 1))] == [True, True, True, False]
    assert [x[:2] for x in read(Region((2, 0), (8, 2)))] == [(1, 0), (4, 0)]
    write_chunks(_chunks(spark, [(1, 1), (2, 2)]).withColumn("data", F.transform("data", lambda v: -v)), uri, "t")
    found = {x[:2]: x[2] for x in read()}
    assert found[(1, 1)] == [-2, -3, -4, -5] and found[(0, 1)] == [1, 2, 3, 4] and (2, 2) in found
    delete_chunks(spark.createDataFrame([(4, 0), (5, 0), (7, 7)], "g0 long, g1 long"), uri, "t")
    assert [x[:2] for x in read()] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (11, 11)]
    if shard:
        assert not box.block_exists("t", (1, 0))


def test_every_layout_of_a_stored_block(spark, tmp_path):
    uri = str(tmp_path / "box")
    box = Container(uri, create=True, names=CodecNames(transpose="turned"))
    turned = [("transpose", {"order": [1, 0]})]
    shard = (Shard((4, 4), chain=[("gzip", {})]), Shard((8, 8), [("crc32c", {})]))
    for name, ds in {
        "bare": Dataset((24, 24), (2, 2), "int32", [("lz4", {})], layout=("raw-bytes", {"endian": "little"})), "nested": Dataset((24, 24), (2, 2), "int32", [("xz", {})], shard, turned, ("raw-bytes", {})),
        "whole": Dataset((24, 24), (2, 2), "int32", [], (Shard((8, 8), chain=[("bzip2", {})]),), turned * 2),
    }.items():
        box.create_dataset(name, ds)
        places = [(0, 0), (0, 1), (1, 0), (5, 0), (11, 11)]
        assert write_chunks(_chunks(spark, places), uri, name, names=box.names) == (5, 0)
        read = read_chunks(spark, uri, name, transpose="turned")
        assert sorted((r.g0, r.g1, list(r.size), list(r.data)) for r in read.collect()) == sorted((r.g0, r.g1, r.size, r.data) for r in _chunks(spark, places).collect())
    with pytest.raises(StoreError):
        Container(uri).dataset("nested")


def test_reading_positions(spark, tmp_path):
    uri = str(tmp_path / "box")
    box = Container(uri, create=True)
    for name, shards in (("s", (Shard((8, 8)),)), ("d", (Shard((4, 4)), Shard((8, 8)))), ("p", ())):
        box.create_dataset(name, Dataset((24, 24), (2, 2), "int32", shards=shards))
        write_chunks(_chunks(spark, [(0, 0), (1, 1), (5, 0), (11, 11)]), uri, name)
        wanted = spark.createDataFrame([(0, 11, 11), (1, 0, 0), (2, 3, 3), (3, 11, 11), (4, 99, 0), (5, -1, 0), (6, 1, 1)], "ord long, g0 long, g1 long")
        got = sorted((r.ord, r.g0, r.data and r.data[0]) for r in read_positions(wanted, uri, name).collect())
        assert got == [(0, 11, 22), (1, 0, 0), (2, 3, None), (3, 11, 22), (4, 99, None), (5, -1, None), (6, 1, 2)]
    assert read_positions(wanted.limit(0), uri, "s").count() == 0


def test_changes_of_blocks(spark, tmp_path):
    uri = str(tmp_path / "box")
    Container(uri, create=True).create_dataset("t", Dataset((24, 24), (2, 2), "int32", shards=(Shard((4, 4)),)))
    twice = spark.createDataFrame([(0, 0, [2, 2], [7] * 4, 2), (0, 0, [2, 2], [8] * 4, 3), (0, 0, [2, 2], [9] * 4, 1)], "g0 long, g1 long, size array<int>, data array<int>, ord int")
    assert write_chunks(twice, uri, "t", order="ord") == (1, 0)
    assert read_chunks(spark, uri, "t").first().data == [8] * 4  # the last by order, not by arrival
    with pytest.raises(Exception, match="more than once") as e:
        write_chunks(twice.drop("ord"), uri, "t")
    folder = e.value.__notes__[0].split()[4].rstrip(";")
    assert spark.read.parquet(folder).count() == 3 and read_chunks(spark, uri, "t").first().data == [8] * 4
    _, folder = stage_changes(twice, "again")
    assert apply_staged(spark, folder, uri, "t", order="ord") == apply_changes(twice, uri, "t", order="ord") == (1, 0)
    # a write that reads its own dataset
    for _ in range(2):
        write_chunks(read_chunks(spark, uri, "t").withColumn("data", F.transform("data", lambda v: v + 1)), uri, "t")
    assert read_chunks(spark, uri, "t").first().data == [10] * 4
    assert delete_chunks(spark.createDataFrame([(0, 0), (0, 0), (9, 9)], "g0 long, g1 long"), uri, "t") == 1 and read_chunks(spark, uri, "t").count() == 0


def test_update_region_decides_once(spark, tmp_path):
    uri = str(tmp_path / "box")
    Container(uri, create=True).create_dataset("t", Dataset((8,), (2,), "int32", shards=(Shard((4,)),)))
    rows = [(0, [2], [-1, -1]), (1, [2], [5, 5])]
    write_chunks(spark.createDataFrame(rows, "g0 long, size array<int>, data array<int>"), uri, "t")
    # absent chunks become zeros, those with negative numbers go, others stay
    zeros = F.array_repeat(F.lit(0), 2)
    update_region(spark, uri, "t", Region((0,), (6,)), lambda pos, old: F.when(old.isNull(), zeros).when(old[0] >= 0, old))
    assert sorted((r.g0, r.data) for r in read_chunks(spark, uri, "t").collect()) == [(1, [5, 5]), (2, [0, 0])]


def test_filters_narrow_the_box(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    uri = str(tmp_path / "box")
    box = Container(uri, create=True)
    ds = Dataset((60, 4), (10, 2), "int8")
    box.create_dataset("t", ds)
    for k in range(6):
        (tmp_path / "box/t" / str(k)).mkdir()
        (tmp_path / "box/t" / str(k) / "1").write_bytes(b"")

    def reader(*filters):
        r = ChunkReader({"path": uri, "names": CodecNames(), "http": {}}, "t", ds)
        left = list(r.pushFilters(list(filters)))
        return r, left

    r, left = reader(GreaterThanOrEqual(("g0",), 2), LessThan(("g0",), 5), EqualTo(("other",), 1))
    assert left == [EqualTo(("other",), 1)] and r.box() == [range(2, 5), range(0, 2)]
    assert [(p.start, p.stop) for p in r.partitions()] == [(0, 6)] and list(r.stored(box, 0, 6)) == [(2, 1), (3, 1), (4, 1)]
    assert list(r.stored(box, 1, 4)) == [(2, 1), (3, 1)] and list(r.stored(box, 2, 3)) == []
    r, _ = reader(In(("g0",), (0, 5)), EqualTo(("g1",), 1))
    assert r.box() == [range(0, 6), range(1, 2)] and list(r.stored(box, 0, 6)) == [(0, 1), (5, 1)]
    assert reader(EqualTo(("g0",), 77))[0].partitions()[0].stop == 0 and reader(GreaterThanOrEqual(("g0",), 60))[0].partitions()[0].stop == 0


def test_four_chunks_of_a_shard_take_two_reads(tmp_path):
    uri = str(tmp_path / "box")
    box = Container(uri, create=True)
    ds = Dataset((24, 24), (2, 2), "uint8", shards=(Shard((8, 8)),))
    box.create_dataset("t", ds)
    chunks = {(x, y): encode_chunk(Block((2, 2), np.full(4, x + y)), ds) for x in range(2) for y in range(2)}
    replace_file(box.fs, box.block_path("t", (0, 0)), encode_stored(chunks, ds, (0, 0)))
    assert box.fs.get_file_info(box.block_path("t", (0, 0))).size == 16 * 16 + 4 * (12 + 4)
    reads = []

    class Counted:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            reads.append((at, n))
            return self.data[at : at + n]

    with box.fs.open_input_file(box.block_path("t", (0, 0))) as f:
        data = f.read()
    found = dict(ChunkReader({}, "t", ds)._in_shard(Counted(data), 0, len(data), 1, (0, 0)))
    assert found == chunks and len(reads) == 2


def test_catalog(spark, tmp_path):
    box = Container(str(tmp_path / "box"), create=True)
    for g in ("t/group/a", "t/group/b", "t/group/c"):
        box.create_group(g)
        box.set_attribute(g, "x", 1)
    box.create_dataset("t/group/dataset", Dataset((3,), (2,), "int8"))
    box.create_dataset("t/group/dataset/inner", Dataset((3,), (2,), "int8"))
    tree = catalog.nodes(spark, str(tmp_path / "box"))
    assert [r.name for r in catalog.children(tree, "t/group").collect()] == ["a", "b", "c", "dataset"]
    assert sorted(r.path for r in catalog.deep_list(tree, "t").collect()) == ["group", "group/a", "group/b", "group/c", "group/dataset"]
    assert [r.path for r in catalog.deep_list(tree, "", datasets_only=True).collect()] == ["t/group/dataset"]


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 1), (1, 9, 2), (2, 3, 2), (2, 0, 2), (2, 5, 1)], "k long, off long, len long")
    merged = sorted(map(tuple, intervals.coalesce_ranges(df, ["k"]).collect()))
    assert merged == [(1, 0, 6), (1, 9, 2), (2, 0, 2), (2, 3, 3)]


def test_scans_of_hot_keys(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k) if k < 4 else None, int(o), i, None if v < 3 else int(v)) for i, (k, o, v) in enumerate(zip(rng.choice([0, 0, 0, 0, 0, 1, 2, 4], 900), rng.integers(0, 400, 900), rng.integers(0, 9, 900)))]
    df = spark.createDataFrame(rows, "k long, o long, i long, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scan = Scan.over(df, ["k"], ["o", "i"])
        assert scan.df.where("k = 0").select("__slice").distinct().count() > 1
        got = scan.running("total", F.col("v"), "sum").running("before", F.col("v"), "max", with_own=False).running("seen", F.col("v"), "last").rows().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 900
    state = {}
    for r in sorted(got, key=lambda r: (r.o, r.i)):
        total, high, last = state.get(r.k, (None, None, None))
        assert r.before == high
        if r.v is not None:
            total, high, last = (total or 0) + r.v, max(high if high is not None else r.v, r.v), r.v
        state[r.k] = total, high, last
        assert (r.total, r.seen) == (total, last)


def test_streams(spark, tmp_path):
    from voxloom.streaming.chunks import time_chunks, upsert_stream

    uri = str(tmp_path / "box")
    Container(uri, create=True).create_dataset("t", Dataset((24, 24), (2, 2), "int32"))
    _chunks(spark, [(0, 0), (1, 1)]).withColumn("ord", F.lit(1)).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = upsert_stream(source, uri, "t", str(tmp_path / "ck"), "ord")
    q.processAllAvailable()
    q.stop()
    assert read_chunks(spark, uri, "t").count() == 2
    events = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 2.0), ("2024-01-01 01:10:00", 4.0)], "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.total for r in time_chunks(events, "ts", F.col("v"), "1 hour", late="10 minutes").collect()) == [3.0, 4.0]


def test_http(spark, tmp_path):
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    class Quiet(SimpleHTTPRequestHandler):
        def log_message(self, *args):
            pass

    uri = str(tmp_path / "box")
    Container(uri, create=True).create_dataset("t", Dataset((24, 24), (2, 2), "int32", shards=(Shard((8, 8)),)))
    write_chunks(_chunks(spark, [(0, 0), (5, 0), (11, 11)]), uri, "t")
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        remote = f"http://127.0.0.1:{server.server_port}/box"
        box = Container(remote)
        assert box.list() == ["t"] and box.dataset("t") is not None and not box.exists("none")
        assert sorted((r.g0, r.g1, list(r.data)) for r in read_chunks(spark, remote, "t").collect()) == sorted((r.g0, r.g1, list(r.data)) for r in read_chunks(spark, uri, "t").collect())
        with pytest.raises(Exception):
            box.set_attribute("t", "x", 1)
    finally:
        server.shutdown()


def test_texts_and_objects(spark, tmp_path):
    uri = str(tmp_path / "box")
    box = Container(uri, create=True)
    box.create_dataset("s", Dataset((4,), (2,), "string", [("gzip", {})]))
    box.create_dataset("o", Dataset((4,), (2,), "object"))
    box.create_dataset("u", Dataset((4,), (2,), "uint64", [("lz4", {})]))
    write_chunks(spark.createDataFrame([(0, [2], 2, ["a", "üb"]), (1, [2], 2, ["", "c"])], "g0 long, size array<int>, num_elements int, data array<string>"), uri, "s")
    assert sorted((r.g0, r.data) for r in read_chunks(spark, uri, "s").collect()) == [(0, ["a", "üb"]), (1, ["", "c"])]
    write_chunks(spark.createDataFrame([(1, None, 3, b"\x00xy")], "g0 long, size array<int>, num_elements int, data binary"), uri, "o")
    assert [(r.g0, r.size, bytes(r.data)) for r in read_chunks(spark, uri, "o").collect()] == [(1, None, b"\x00xy")]
    big = (1 << 64) - 1
    write_chunks(spark.sql(f"select 0L as g0, array(2) as size, 2 as num_elements, array({big}BD, 7BD) as data"), uri, "u")
    assert [int(v) for v in read_chunks(spark, uri, "u").first().data] == [big, 7]
