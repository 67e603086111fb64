"""Attribute paths into JSON values: ``a/b[2]/c`` with ``\\/`` and ``\\[`` for literal marks.

Plain functions serve single metadata documents on the driver; the Column forms serve tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INDEX = re.compile(r"\[(\d+)\]")
_DECODE = json.JSONDecoder().decode
_ENCODE = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":")).encode

_Steps = tuple[tuple[str, int | None], ...]


def path_tokens(path: str) -> list[str]:
    """Tokens of a path, escapes kept: keys, and ``[n]`` for array indices; no empty, ``.`` or ``..`` tokens."""
    raw, current, i = [], "", 0
    while i < len(path):
        c = path[i]
        index = _INDEX.match(path, i) if c == "[" else None
        if c == "\\" and i + 1 < len(path):
            current += path[i : i + 2]
            i += 2
        elif c == "/" or index:
            raw.append(current)
            current = ""
            if index:
                raw.append(index.group())
            i = index.end() if index else i + 1
        else:
            current += c
            i += 1
    raw.append(current)
    out: list[str] = []
    for token in raw:
        if token == "..":
            out[-1:] = []
        elif token not in ("", "."):
            out.append(token)
    return out


def normalize_path(path: str) -> str:
    """The path with single slashes around keys and indices, ``.`` and ``..`` resolved; it stays absolute or relative."""
    return ("/" if path.startswith("/") else "") + "/".join(path_tokens(path))


def _unescape(token: str) -> str:
    return token.replace("\\/", "/").replace("\\[", "[").replace("\\\\", "\\")


@lru_cache(maxsize=4096)
def _steps(path: str) -> _Steps:
    """The key that each token of a path stands for, and the index if it may be one."""
    found = [(token, _INDEX.fullmatch(token)) for token in path_tokens(path)]
    return tuple((_unescape(token), int(index[1]) if index else None) for token, index in found)


def get(root: Any, path: str, default: Any = None) -> Any:
    """The node at a path: an object's key is looked up first, then an array's index."""
    node = root
    for key, index in _steps(path):
        if isinstance(node, dict) and key in node:
            node = node[key]
        elif isinstance(node, list) and index is not None and index < len(node):
            node = node[index]
        else:
            return default
    return node


def set_value(root: Any, path: str, value: Any) -> Any:
    """``root`` with ``value`` at the path. Missing or unfit parents are made; a grown array
    is padded with 0 before a number, with null before anything else."""
    return _with_value(root, _steps(path), value)


def _with_value(root: Any, steps: _Steps, value: Any) -> Any:
    if not steps:
        return value
    (key, index), rest = steps[0], steps[1:]
    if index is not None and not (isinstance(root, dict) and key in root):
        out = list(root) if isinstance(root, list) else []
        number = isinstance(value, (int, float)) and not isinstance(value, bool) and not rest
        out += [0 if number else None] * (index + 1 - len(out))
        out[index] = _with_value(out[index], rest, value)
        return out
    fields = dict(root) if isinstance(root, dict) else {}
    fields[key] = _with_value(fields.get(key), rest, value)
    return fields


def remove(root: Any, path: str) -> tuple[Any, Any, bool]:
    """(root without the node, the node, whether it was there); later elements of an array move up."""
    return _without(root, _steps(path))


def _without(root: Any, steps: _Steps) -> tuple[Any, Any, bool]:
    if not steps:
        return None, root, root is not None
    (key, index), rest = steps[0], steps[1:]
    if isinstance(root, dict) and key in root:
        at: Any = key
    elif isinstance(root, list) and index is not None and index < len(root):
        at = index
    else:
        return root, None, False
    out = root.copy()
    if rest:
        out[at], old, found = _without(out[at], rest)
    else:
        old, found = out.pop(at), True
    return out, old, found


def merge(root: Any, values: dict[str, Any]) -> Any:
    """``root`` with all the paths of ``values`` set, in their order."""
    for path, value in values.items():
        root = set_value(root, path, value)
    return root


def without_nulls(node: Any) -> Any:
    """Objects lose their null members at every depth; arrays keep theirs."""
    if isinstance(node, dict):
        return {k: without_nulls(v) for k, v in node.items() if v is not None}
    return [without_nulls(v) for v in node] if isinstance(node, list) else node


def dumps(node: Any, keep_nulls: bool = False) -> str:
    return _ENCODE(node if keep_nulls else without_nulls(node))


def type_of(node: Any) -> str | None:
    """Inferred type: null, boolean, long (whole numbers, 1.0 too), double, string, object, or an array of these.

    An array of longs with a double after them is of doubles; any other mixture is of objects."""
    if node is None:
        return None
    if isinstance(node, bool):
        return "boolean"
    if isinstance(node, (int, float)):
        return "long" if float(node).is_integer() else "double"
    if isinstance(node, str):
        return "string"
    if isinstance(node, dict):
        return "object"
    kinds = [type_of(x) for x in node]
    found = kinds[0] if kinds else "object"
    for kind in kinds[1:]:
        if found == "long" and kind == "double":
            found = "double"
        elif kind != found:
            found = "object"
    return f"{found}[]" if found else "object[]"


def list_types(root: Any) -> dict[str, str | None]:
    """Types of the members of an object."""
    if not isinstance(root, dict):
        raise ValueError("attributes are no object")
    return {k: type_of(v) for k, v in root.items()}


def json_path(path: str) -> str:
    """An attribute path as a JSONPath for ``get_json_object`` and ``try_variant_get``."""
    out = "$"
    for token in path_tokens(path):
        out += token if _INDEX.fullmatch(token) else "['" + _unescape(token).replace("'", "\\'") + "']"
    return out


def get_column(text: Column, path: str, kind: str = "string", parsed: bool = False) -> Column:
    """The attribute at a path of a JSON text column; null where absent or of another type. With
    ``parsed`` the column is a variant already (``F.try_parse_json``, once for several attributes)."""
    return F.try_variant_get(text if parsed else F.try_parse_json(text), json_path(path), kind)


@F.arrow_udf(T.StringType())
def _array_type(text: pa.Array) -> pa.Array:
    return pa.array([type_of(json.loads(t)) if t is not None else None for t in text.to_pylist()], pa.string())


def type_column(text: Column, path: str = "", parsed: bool = False) -> Column:
    """``type_of`` of a node of a JSON text column, or with ``parsed`` a variant. Only arrays leave the JVM."""
    node = F.try_variant_get(text if parsed else F.try_parse_json(text), json_path(path), "variant")
    kind = F.schema_of_variant(node)
    number = F.try_variant_get(node, "$", "double")
    is_array = kind.startswith("ARRAY")
    return (
        F.when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .when(is_array, _array_type(F.when(is_array, F.to_json(node))))
        .when(kind.startswith("OBJECT"), "object")
        .when(number.isNotNull(), F.when(number == F.floor(number), "long").otherwise("double"))
    )


def _edited(change: Callable[..., Any]) -> Callable[..., Column]:
    """A function of texts as one of columns: ``change`` gets the values of a row (null: None) and gives a text."""

    @F.arrow_udf(T.StringType())
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([change(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], pa.string())

    return run


def _node(text: str | None) -> Any:
    try:
        return _DECODE(text) if text is not None else None
    except ValueError:
        return None


def _null_free(text: str | None) -> bool:
    """Whether no node of a JSON text can be null."""
    return text is not None and "null" not in text


def set_column(text: Column, path: str, value: Column, keep_nulls: bool = False) -> Column:
    """A JSON text column with ``value``, a column of JSON texts, at an attribute path, as ``set_value`` does.

    What is no JSON counts as absent. Nulls of objects are left out unless ``keep_nulls``."""

    def change(t: str | None, v: str | None) -> str:
        node, put = _node(t), _node(v)
        return dumps(set_value(node, path, put), keep_nulls or put is not None and _null_free(v) and _null_free(t or ""))

    return _edited(change)(text, value)


def _removed(node: Any, paths: Sequence[_Steps], keep_nulls: bool) -> str | None:
    for steps in paths:
        node = _without(node, steps)[0]
    return None if node is None else dumps(node, keep_nulls)


def remove_column(text: Column, path: str, keep_nulls: bool = False) -> Column:
    """A JSON text column without the node at an attribute path; null where that leaves nothing."""
    return remove_columns(text, {"left": [path]}, keep_nulls)["left"]


def remove_columns(text: Column, paths: Mapping[str, Sequence[str]], keep_nulls: bool = False) -> Column:
    """A struct of JSON texts: by name, what ``remove_column`` leaves with one path after the other. A text is read once for all of them."""

    @F.arrow_udf(T.StructType([T.StructField(name, T.StringType()) for name in paths]))
    def run(texts: pa.Array) -> pa.Array:
        rows = [(_node(t), keep_nulls or _null_free(t)) for t in texts.to_pylist()]
        columns = [[_steps(path) for path in each] for each in paths.values()]
        return pa.StructArray.from_arrays([pa.array([_removed(node, steps, keep) for node, keep in rows], pa.string()) for steps in columns], list(paths))

    return run(text)


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def list_types_column(text: pa.Array) -> pa.Array:
    """The types of the members of a column of JSON objects, as ``list_types``; null for anything else."""
    nodes = [_node(t) for t in text.to_pylist()]
    return pa.array([list(list_types(n).items()) if isinstance(n, dict) else None for n in nodes], pa.map_(pa.string(), pa.string()))


@F.arrow_udf(T.StringType())
def normalize_path_column(path: pa.Array) -> pa.Array:
    """``normalize_path`` of a column of attribute paths."""
    return pa.array([None if p is None else normalize_path(p) for p in path.to_pylist()], pa.string())


def normalize_group_column(path: Column) -> Column:
    """Group paths: one leading slash stripped, ``.`` dropped, ``..`` takes back a part; built in."""
    parts = F.split(F.regexp_replace(path, r"^[/\\]", ""), r"[/\\]+")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))),
    )
    return F.array_join(kept, "/")
