"""Addresses ``container?group#attribute`` of a node's attribute."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.attrs import normalize_path

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]+:")
_DRIVE = re.compile(r"^[A-Za-z]:")


def normalize_group(path: str) -> str:
    """A group path without its leading slash, ``.`` and ``..`` resolved."""
    out: list[str] = []
    for part in re.split(r"[/\\]+", path[1:] if path[:1] in ("/", "\\") else path):
        if part == "..":
            out[-1:] = []
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def join_groups(*nodes: str) -> str:
    return normalize_group("/".join(nodes))


@dataclass(frozen=True)
class Address:
    container: str
    group: str | None = None
    attribute: str | None = None

    @staticmethod
    def parse(text: str) -> Address:
        rest, hash_mark, attribute = text.partition("#")
        container, question, group = rest.partition("?")
        return Address(container, unquote(group) if question else None, unquote(attribute) if hash_mark else None)

    def __str__(self) -> str:
        group = "" if self.group is None else "?" + quote(self.group, safe="/:@!$&'()*+,;=-._~ ").replace(" ", "%20")
        attribute = "" if self.attribute is None else "#" + quote(self.attribute, safe="/:@!$&'()*+,;=-._~?[] ").replace(" ", "%20")
        return self.container + group + attribute

    @property
    def group_path(self) -> str:
        return "/" + normalize_group(self.group or "")

    @property
    def attribute_path(self) -> str:
        return normalize_path(self.attribute) if self.attribute else "/"

    @property
    def is_absolute(self) -> bool:
        return bool(_SCHEME.match(self.container) or _DRIVE.match(self.container) or self.container.startswith("/"))

    def resolve(self, relative: str | Address) -> Address:
        """Another address seen from this one: an absolute one replaces it, a path is appended or
        replaces the path, a group drops the attribute, an attribute only replaces that."""
        other = Address.parse(relative) if isinstance(relative, str) else relative
        if _SCHEME.match(other.container) or _DRIVE.match(other.container):
            return other
        if other.container.startswith("/"):
            root = re.match(r"^([A-Za-z][A-Za-z0-9+.-]+:(?://[^/]*)?)", self.container)
            return Address((root[1] if root else "") + other.container, other.group, other.attribute)
        if other.container:
            return Address(self.container.rstrip("/") + "/" + other.container, other.group, other.attribute)
        if other.group is not None:
            group = other.group if other.group.startswith("/") or not self.group else join_groups(self.group, other.group)
            return Address(self.container, group, other.attribute)
        return Address(self.container, self.group, other.attribute)


def container_column(text: Column) -> Column:
    return F.regexp_extract(text, r"^([^?#]*)", 1)


def group_column(text: Column) -> Column:
    """The group of an address, ``/`` if it has none."""
    return F.when(text.rlike(r"^[^#]*\?"), F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)).otherwise("/")


def attribute_column(text: Column) -> Column:
    """The attribute of an address, ``/`` if it has none."""
    return F.when(text.contains("#"), F.regexp_extract(text, r"#(.*)$", 1)).otherwise("/")


def _decoded(text: Column) -> Column:
    """Percent escapes decoded; a plus sign is one, and what isn't encoded right stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def decoded_group_column(text: Column) -> Column:
    """``group_column``, decoded."""
    return _decoded(group_column(text))


def decoded_attribute_column(text: Column) -> Column:
    """``attribute_column``, decoded."""
    return _decoded(attribute_column(text))


def is_absolute_column(text: Column) -> Column:
    """Whether the container of an address has a scheme, a drive or a leading slash."""
    return container_column(text).rlike(r"^([A-Za-z][A-Za-z0-9+.-]+:|[A-Za-z]:|/)")


@F.arrow_udf(T.StringType())
def resolve_column(base: pa.Array, relative: pa.Array) -> pa.Array:
    """``Address.resolve`` of two columns of addresses; null where either is."""
    rows = zip(base.to_pylist(), relative.to_pylist(), strict=True)
    return pa.array([None if b is None or r is None else str(Address.parse(b).resolve(r)) for b, r in rows], pa.string())


def encode_path(path: str) -> str:
    """Percent-encodes what a URI's path can't hold; what is encoded already stays."""
    return re.sub(r"%(?![0-9A-Fa-f]{2})", "%25", quote(path, safe="/:@!$&'()*+,;=-._~%"))
