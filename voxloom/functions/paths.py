"""Keys of a store as Column expressions: components, parents, joining, relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """Parts of a path; an absolute one begins with ``/``, a trailing slash doesn't count."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(path.startswith("/"), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)


def compose(*parts: Column) -> Column:
    """Parts joined by single slashes; the first one may be absolute."""
    return F.regexp_replace(F.concat_ws("/", *parts), "/+", "/")


def parent(path: Column) -> Column:
    """What holds a path: ``/`` for a child of the root, null for the root and for a single relative name."""
    bare = F.regexp_replace(path, "/+$", "")
    up = F.regexp_replace(bare, "/+[^/]*$", "")
    return F.when(bare == "", None).when(~bare.contains("/"), None).when(up == "", "/").otherwise(up)


def relativize(path: Column, base: Column) -> Column:
    """The path seen from a base that holds it, else the path itself."""
    root = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    return F.when(path.startswith(root), F.substring(path, F.length(root) + 1, F.length(path))).when(path == base, "").otherwise(path)


def valid_bounds(off: Column, length: Column, size: Column) -> Column:
    """Whether a range lies in something of a size; a negative length reaches to its end."""
    return (off >= 0) & F.when(length < 0, off <= size).otherwise(off + length <= size)
