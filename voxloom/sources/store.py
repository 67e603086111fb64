"""Containers: a tree of groups in a file system, with JSON attributes. Metadata work is on the driver."""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import replace
from typing import Any

import pyarrow.fs as pafs

from voxloom.errors import AttributeParseError, AttributeTypeError, NoSuchKeyError, StoreIOError
from voxloom.functions import attrs
from voxloom.functions.uri import normalize_group
from voxloom.functions.versions import CURRENT, Version
from voxloom.sources.dataset import CodecNames, Dataset

ATTRIBUTES = "attributes.json"
#: File systems of Arrow in which a write shows up as a whole or not at all, and a move is a copy.
WHOLE_OBJECTS = ("s3", "gcs", "abfs")


def filesystem(uri: str, **http: Any) -> tuple[pafs.FileSystem, str]:
    """File system and path of a location: a local path or any URI that Arrow's file systems read.

    ``http``: timeout in seconds and the styles of listings, for HTTP addresses."""
    if uri.startswith(("http://", "https://")):
        from voxloom.sources.http import http_filesystem

        return http_filesystem(uri, **http)
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return pafs.LocalFileSystem(), posixpath.abspath(uri)


def replace_file(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file so that no reader sees half of it: beside its place and moved there, or at once
    where a store only shows whole objects."""
    if fs.type_name in WHOLE_OBJECTS:
        with fs.open_output_stream(path) as f:
            f.write(data)
        return
    fs.create_dir(posixpath.dirname(path), recursive=True)
    temporary = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as f:
        f.write(data)
    fs.move(temporary, path)


class Container:
    """A container at a location. ``version_key`` is the root attribute that holds the format
    version, ``names`` are the names of codecs in metadata; pass those that existing containers
    use. ``http`` are the options of ``filesystem``."""

    def __init__(self, uri: str, create: bool = False, version_key: str = "formatVersion", names: CodecNames = CodecNames(), **http: Any):
        self.uri, self.version_key, self.names = uri.rstrip("/"), version_key, names
        self.fs, self.root = filesystem(self.uri, **http)
        there = self.fs.get_file_info(self.root).type == pafs.FileType.Directory
        if there:
            if not CURRENT.is_compatible(self.version()):
                raise StoreIOError(f"version {self.version()} can't be used by {CURRENT}")
        elif not create:
            raise NoSuchKeyError(f"no container at {uri}")
        if create:
            self.fs.create_dir(self.root, recursive=True)
            if self.attributes("") is None or attrs.get(self.attributes(""), version_key) is None:
                self.set_attributes("", {version_key: str(CURRENT)})

    def _path(self, *parts: str) -> str:
        return "/".join([self.root, *(p for p in map(normalize_group, parts) if p)])

    def version(self) -> Version:
        text = attrs.get(self.attributes(""), self.version_key)
        return Version.parse(text if isinstance(text, str) else None)

    def set_version(self, version: Version = CURRENT) -> None:
        """Notes the version of the format, unless data of a newer one are there."""
        if not version.is_compatible(self.version()):
            raise StoreIOError(f"version {self.version()} can't be used by {version}")
        self.set_attribute("", self.version_key, str(version))

    # groups
    def group_exists(self, group: str) -> bool:
        return self.fs.get_file_info(self._path(group)).type == pafs.FileType.Directory

    def dataset_exists(self, group: str, weak: bool = False) -> bool:
        """Whether a group is a dataset; with ``weak``, dimensions and a data type are enough."""
        if weak:
            node = self.attributes(group)
            return isinstance(node, dict) and node.get("dimensions") is not None and node.get("dataType") is not None
        return self.dataset(group) is not None

    def exists(self, group: str) -> bool:
        return self.group_exists(group) or self.dataset_exists(group)

    def create_group(self, group: str) -> None:
        self.fs.create_dir(self._path(group), recursive=True)

    def list(self, group: str = "") -> list[str]:
        """Names of the child groups, sorted; names with a leading dot are the store's own."""
        if not self.group_exists(group):
            raise NoSuchKeyError(f"no group {group}")
        found = self.fs.get_file_info(pafs.FileSelector(self._path(group)))
        return sorted(x.base_name for x in found if x.type == pafs.FileType.Directory and not x.base_name.startswith("."))

    def remove(self, group: str = "") -> bool:
        """Deletes a group and all below; true even if there is none."""
        if self.group_exists(group):
            self.fs.delete_dir(self._path(group))
        return True

    # attributes
    def attributes(self, group: str) -> Any:
        """All attributes of a group: any JSON value, None where there are none."""
        path = self._path(group) + "/" + ATTRIBUTES
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with self.fs.open_input_stream(path) as f:
            text = f.read().decode()
        try:
            return json.loads(text) if text.strip() else None
        except ValueError as e:
            raise AttributeParseError(f"attributes of {group or '/'} are no JSON: {e}") from e

    def get_attribute(self, group: str, path: str, kind: type | tuple[type, ...] | None = None) -> Any:
        """The attribute at a path, None where absent. Asked for as a string, any other node gives its JSON text."""
        node = attrs.get(self.attributes(group), path)
        if kind is str and node is not None and not isinstance(node, str):
            return attrs.dumps(node, keep_nulls=True)
        if kind is float and isinstance(node, int) and not isinstance(node, bool):
            return float(node)
        if kind is not None and node is not None and (not isinstance(node, kind) or isinstance(node, bool) and kind is not bool):
            raise AttributeTypeError(f"{path} is {attrs.type_of(node)}")
        return node

    def list_attributes(self, group: str) -> dict[str, str | None]:
        root = self.attributes(group)
        return {} if root is None else attrs.list_types(root)

    def _save(self, group: str, root: Any, keep_nulls: bool = False) -> None:
        if not self.group_exists(group):
            raise NoSuchKeyError(f"no group {group}")
        replace_file(self.fs, self._path(group) + "/" + ATTRIBUTES, attrs.dumps(root, keep_nulls).encode())

    def set_attribute(self, group: str, path: str, value: Any) -> None:
        self._save(group, attrs.set_value(self.attributes(group), path, value))

    def set_attributes(self, group: str, values: dict[str, Any]) -> None:
        self._save(group, attrs.merge(self.attributes(group), values))

    def replace_attributes(self, group: str, root: Any) -> None:
        self._save(group, root)

    def remove_attribute(self, group: str, path: str, kind: type | None = None) -> Any:
        """Deletes a node: whether it was there, or with ``kind`` the node itself; of another kind it stays."""
        if kind is not None:
            self.get_attribute(group, path, kind)
        root, old, found = attrs.remove(self.attributes(group), path)
        if found:
            self._save(group, root)
        return found if kind is None else old

    def remove_attributes(self, group: str, paths: list[str]) -> bool:
        return any([self.remove_attribute(group, p) for p in paths])

    # datasets
    def dataset(self, group: str) -> Dataset | None:
        return Dataset.from_json(self.attributes(group), self.names)

    def create_dataset(self, group: str, dataset: Dataset) -> None:
        self.create_group(group)
        self.set_dataset(group, dataset)

    def set_dataset(self, group: str, dataset: Dataset) -> None:
        """Replaces the metadata of a dataset; other attributes of its group and stored blocks stay."""
        for key in ("codecs", "compression", "compressionType", "defaultValue"):
            self.remove_attribute(group, "/" + key)
        self.set_attributes(group, {"/" + k: v for k, v in replace(dataset, names=self.names).to_json().items()})

    # stored blocks
    def block_path(self, group: str, key: tuple[int, ...]) -> str:
        return self._path(group) + "/" + "/".join(map(str, key))

    def block_exists(self, group: str, key: tuple[int, ...]) -> bool:
        return self.fs.get_file_info(self.block_path(group, key)).type == pafs.FileType.File

    def delete_block(self, group: str, key: tuple[int, ...]) -> bool:
        """Deletes a stored block; whether it existed."""
        if not self.block_exists(group, key):
            return False
        self.fs.delete_file(self.block_path(group, key))
        return True
