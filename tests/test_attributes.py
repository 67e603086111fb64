import random

import pytest
from pyspark.sql import functions as F

from voxloom.functions import attrs
from voxloom.functions.uri import Address, encode_path, normalize_group
from voxloom.functions.versions import CURRENT, Version


def _messy_and_normal(rng):
    """A path written carelessly from known steps, and its normal form."""
    kept, text = [], ""
    absolute = rng.random() < 0.5
    for n in range(rng.randrange(0, 8)):
        kind = rng.choice(["key", "key", "key", "index", "here", "up"])
        if kind == "index":
            step = f"[{rng.randrange(40)}]"
            text += step if rng.random() < 0.6 else "/" * bool(text) + step
        else:
            alphabet = ["a", "b", "Z", "7", " ", "é", ".", "-", "\\/", "\\[", "\\\\", "]", "[x]", "[1x]", "#"]
            step = {"here": ".", "up": ".."}.get(kind) or "k" + "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 4)))
            text += "/" * rng.choice([1, 1, 2, 3]) * bool(text) + step
        if kind == "up":
            kept[-1:] = []
        elif kind != "here":
            kept.append(step)
    lead, tail = "/" * rng.choice([1, 2]) if absolute else "", "/" * rng.choice([0, 0, 1, 2]) * bool(text)
    return lead + text + tail, "/" * absolute + "/".join(kept)


def test_normalize_made_paths():
    rng = random.Random(20)
    for _ in range(4000):
        path, normal = _messy_and_normal(rng)
        assert attrs.normalize_path(path) == normal, path
        assert attrs.normalize_path(normal) == normal


def test_normalize_marks():
    # a bracket pair is an index only around digits; an escaped mark belongs to its key
    assert attrs.path_tokens("grid[12]axis") == ["grid", "[12]", "axis"] and attrs.path_tokens("grid[1 2]axis") == ["grid[1 2]axis"]
    assert attrs.path_tokens("grid\\[12]axis") == ["grid\\[12]axis"] and attrs.path_tokens("one\\/two/three") == ["one\\/two", "three"]
    assert attrs.path_tokens("//") == [] and attrs.normalize_path("//") == "/" and attrs.normalize_path("") == "" and attrs.normalize_path("up/../..") == ""


def test_get_set_remove():
    root = {"a": {"b": [1, {"c": "x"}], "b/c": 2, "[0]": 3}}
    assert attrs.get(root, "a/b[1]/c") == "x" and attrs.get(root, "/a/b\\/c") == 2 and attrs.get(root, "a/[0]") == 3
    assert attrs.get(root, "a/b[7]") is None and attrs.get(root, "a/b/c") is None and attrs.get(5, "") == 5
    assert attrs.set_value(None, "a/b[2]", 7) == {"a": {"b": [0, 0, 7]}}
    assert attrs.set_value({"a": 1}, "a[1]/b", "x") == {"a": [None, {"b": "x"}]}
    assert attrs.set_value({"a": 1}, "", [2]) == [2]
    assert attrs.merge({}, {"x/y": 1, "x/z": None}) == {"x": {"y": 1, "z": None}}
    left, old, found = attrs.remove({"a": [1, 2, 3]}, "a[1]")
    assert (left, old, found) == ({"a": [1, 3]}, 2, True)
    assert attrs.remove({"a": 1}, "b/c") == ({"a": 1}, None, False)
    assert attrs.dumps({"a": None, "b": [None, {"c": None}]}) == '{"b":[null,{}]}'
    assert attrs.dumps({"a": None}, keep_nulls=True) == '{"a":null}'


def test_paths_are_read_once(monkeypatch):
    # not again for each row and step: this was most of the time of an edit
    calls, tokens = [], attrs.path_tokens
    monkeypatch.setattr(attrs, "path_tokens", lambda path: calls.append(path) or tokens(path))
    for n in range(50):
        root = attrs.set_value(None, "read/once[1]/only", n)
        assert root == {"read": {"once": [None, {"only": n}]}} and attrs.get(root, "read/once[1]/only") == n
        assert attrs.remove(root, "read/once[1]/only") == ({"read": {"once": [None, {}]}}, n, True)
    assert calls == ["read/once[1]/only"]


def test_types():
    for node, kind in ((None, None), (True, "boolean"), (0, "long"), (-4.0, "long"), (0.25, "double"), ("", "string"), ({}, "object"), ([], "object[]"), ([True, False], "boolean[]"), ([[1], [2]], "long[][]")):
        assert attrs.type_of(node) == kind
    for first in (3, 3.0, 0.5, "t", {"k": 1}, None):
        for second in (4, 0.75, "u", {}, None):
            one, two = attrs.type_of(first), attrs.type_of(second)
            both = one if one == two else "double" if (one, two) == ("long", "double") else "object"
            assert attrs.type_of([first, second]) == f"{both or 'object'}[]"
    assert attrs.list_types({"pages": 12, "title": "x", "share": [0.5, 2]}) == {"pages": "long", "title": "string", "share": "object[]"}
    with pytest.raises(ValueError):
        attrs.list_types("no object")


def test_resolve():
    base = Address("zip:/data/box.zip", "scans/left", "size")
    # an address of its own; a path from the root, and one from here; a group beside, and one from the root; an attribute
    for relative, found in (
        ("mem:q", Address("mem:q")), ("/other?g", Address("zip:/other", "g")), ("part", Address("zip:/data/box.zip/part")), ("?../right#n", Address("zip:/data/box.zip", "scans/right", "n")),
        ("?/top", Address("zip:/data/box.zip", "/top")), ("#n[2]", Address("zip:/data/box.zip", "scans/left", "n[2]")),
    ):
        assert base.resolve(relative) == found and base.resolve(Address.parse(str(found))) == (found if found.is_absolute else base.resolve(found))
    assert Address.parse("/plain/path").resolve("/elsewhere#x") == Address("/elsewhere", None, "x")
    assert Address.parse("http://host:80/a/b").resolve("/c") == Address("http://host:80/c")


def test_columns(spark):
    rng = random.Random(21)
    paths = [_messy_and_normal(rng) for _ in range(200)]
    df = spark.createDataFrame([*paths, (None, None)], "path string, normal string")
    assert df.where(~attrs.normalize_path_column(F.col("path")).eqNullSafe(F.col("normal"))).count() == 0
    texts = ["", None, "no json", '{"a":[1,{"b":null}],"c":2.0}', "[1,2.5]", "7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.select(attrs.set_column(F.col("t"), "a[1]/z", F.lit("true")).alias("put"), attrs.remove_column(F.col("t"), "a[0]").alias("cut"), attrs.list_types_column(F.col("t")).alias("types"), attrs.type_column(F.col("t")).alias("kind"))
    assert [tuple(r) for r in row.collect()] == [
        ('{"a":[null,{"z":true}]}', None, None, None), ('{"a":[null,{"z":true}]}', None, None, None), ('{"a":[null,{"z":true}]}', None, None, None),
        ('{"a":[1,{"z":true}],"c":2.0}', '{"a":[{}],"c":2.0}', {"a": "object[]", "c": "long"}, "object"), ('{"a":[null,{"z":true}]}', "[1,2.5]", None, "double[]"), ('{"a":[null,{"z":true}]}', "7", None, "long"),
    ]
    assert spark.range(1).select(attrs.set_column(F.lit('{"a":{"n":null}}'), "/", F.lit("[null]"), keep_nulls=True)).first()[0] == "[null]"


def test_addresses():
    a = Address.parse("/box?a/../b#x[0]/y")
    assert (a.container, a.group_path, a.attribute_path, a.is_absolute) == ("/box", "/b", "x/[0]/y", True)
    assert Address.parse("box").group_path == "/" and not Address.parse("box").is_absolute
    assert Address.parse("C:\\a\\b").is_absolute and Address.parse("file:///a").is_absolute
    assert normalize_group("/a//b/./../c/") == "a/c" and encode_path("a b%20c") == "a%20b%20c"


def test_versions():
    assert Version.parse("1.2.3-x") == Version(1, 2, 3, "-x") and Version.parse("2") == Version(2) and Version.parse(None) == Version(0)
    assert CURRENT.is_compatible(Version(4, 9)) and not CURRENT.is_compatible(Version(5)) and str(Version(1, 2, 3, "-x")) == "1.2.3-x"


def test_removals_of_one_text(spark):
    texts = ["", None, "no json", '{"a":[1,{"b":null,"z":"null"}],"c":2.0,"n":null}', "[1,2.5]", "7", '{"[0]":{"é":1},"a":[[5]]}']
    df, t = spark.createDataFrame([(x,) for x in texts], "t string"), F.col("t")
    paths = {"one": ["a[0]"], "two": ["a[0]", "a[0]"], "key": ["[0]/é", "[0]"], "none": [], "all": ["c", "/"]}
    for keep in (False, True):
        for r in df.select("t", attrs.remove_columns(t, paths, keep).alias("r"), *[attrs.remove_column(t, p[0], keep).alias(n) for n, p in paths.items() if len(p) == 1]).collect():
            node = attrs._node(r.t)
            assert r.one == r.r.one
            for name, each in paths.items():
                left = node
                for path in each:
                    left = attrs.remove(left, path)[0]
                assert r.r[name] == (None if left is None else attrs.dumps(left, keep))
    assert df.select(attrs.remove_columns(t, paths).alias("r")).where("t like '{\"a%'").first()[0]["none"] == '{"a":[1,{"z":"null"}],"c":2.0}'
