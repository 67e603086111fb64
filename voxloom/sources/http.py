"""Read-only containers over HTTP, as an Arrow file system."""

from __future__ import annotations

import io
import re
import urllib.error
import urllib.request
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs

from voxloom.errors import StoreIOError
from voxloom.functions.listing import STYLES
from voxloom.functions.uri import encode_path

#: Seconds that a request may take.
TIMEOUT = 5.0


class _RemoteFile(io.RawIOBase):
    """A file read by ranges; a server that ignores them sends the whole file once."""

    def __init__(self, url: str, size: int, timeout: float):
        self._url, self._size, self._timeout, self._at = url, size, timeout, 0
        self._whole: bytes | None = None

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def size(self) -> int:
        return self._size

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._size}[whence]
        return self._at

    def read(self, n: int = -1) -> bytes:
        end = self._size if n is None or n < 0 else min(self._size, self._at + n)
        if end <= self._at:
            return b""
        if self._whole is None:
            request = urllib.request.Request(self._url, headers={"Range": f"bytes={self._at}-{end - 1}"})
            with urllib.request.urlopen(request, timeout=self._timeout) as r:
                data = r.read()
            if r.status != 206:
                self._whole = data
        out = self._whole[self._at : end] if self._whole is not None else data
        self._at = end
        return out


class HttpHandler(pafs.FileSystemHandler):
    def __init__(self, base: str, timeout: float = TIMEOUT, styles: tuple[str, ...] = ("iis", "apache", "python")):
        self.base, self.timeout, self.styles = base.rstrip("/"), timeout, styles

    def get_type_name(self) -> str:
        return "http"

    def normalize_path(self, path: str) -> str:
        return path

    def _url(self, path: str) -> str:
        return f"{self.base}/{encode_path(path.strip('/'))}"

    def _info(self, path: str) -> pafs.FileInfo:
        try:
            with urllib.request.urlopen(urllib.request.Request(self._url(path), method="HEAD"), timeout=self.timeout) as r:
                if r.url.endswith("/"):  # servers redirect a directory to its name with a slash
                    return pafs.FileInfo(path, pafs.FileType.Directory)
                return pafs.FileInfo(path, pafs.FileType.File, size=int(r.headers.get("Content-Length", -1)))
        except urllib.error.HTTPError as e:
            if e.code in (403, 404, 410):
                return pafs.FileInfo(path, pafs.FileType.NotFound)
            raise StoreIOError(f"{self._url(path)}: {e}") from e
        except OSError as e:
            raise StoreIOError(f"{self._url(path)}: {e}") from e

    def get_file_info(self, paths: list[str]) -> list[pafs.FileInfo]:
        return [self._info(p) for p in paths]

    def get_file_info_selector(self, selector: pafs.FileSelector) -> list[pafs.FileInfo]:
        try:
            with urllib.request.urlopen(self._url(selector.base_dir) + "/", timeout=self.timeout) as r:
                page = r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if selector.allow_not_found and e.code == 404:
                return []
            raise StoreIOError(f"{selector.base_dir}: {e}") from e
        names: list[str] = []
        for style in self.styles:  # the first style that finds more than one entry, else the last
            names = re.findall(STYLES[style][0], page)
            if len(names) > 1:
                break
        out = []
        for name in names:
            path = f"{selector.base_dir.rstrip('/')}/{unquote(name.rstrip('/'))}"
            out.append(pafs.FileInfo(path, pafs.FileType.Directory) if name.endswith("/") else pafs.FileInfo(path, pafs.FileType.File))
        return out

    def open_input_file(self, path: str) -> pa.NativeFile:
        info = self._info(path)
        if info.type != pafs.FileType.File:
            raise FileNotFoundError(path)
        return pa.PythonFile(_RemoteFile(self._url(path), info.size, self.timeout), mode="r")

    def open_input_stream(self, path: str) -> pa.NativeFile:
        return self.open_input_file(path)

    def _read_only(self, *_: object, **__: object) -> None:
        raise StoreIOError("HTTP stores are read-only")

    create_dir = delete_dir = delete_dir_contents = delete_root_dir_contents = delete_file = move = copy_file = open_output_stream = open_append_stream = _read_only


def http_filesystem(uri: str, timeout: float = TIMEOUT, styles: tuple[str, ...] = ("iis", "apache", "python")) -> tuple[pafs.FileSystem, str]:
    """File system and path of an http or https address."""
    m = re.match(r"^(https?://[^/]+)(/.*)?$", uri)
    if not m:
        raise StoreIOError(f"no HTTP address: {uri}")
    return pafs.PyFileSystem(HttpHandler(m[1], timeout, styles)), unquote(m[2] or "").strip("/")
