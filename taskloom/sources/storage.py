"""A flat key store over a folder: local files, or any file system that Hadoop knows."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]+)://")
_WINDOWS = re.compile(r"^([A-Za-z]:[\\/]|\\\\)")


def scheme_of(path: str) -> str | None:
    found = _SCHEME.match(path)
    return found.group(1).lower() if found else None


class Storage:
    """Bytes by key below a base path.

    Keys are relative. A key that leaves the base (absolute, or with ``..``)
    is refused unless ``outside`` allows it; a URI must have the base's scheme.
    """

    def __init__(self, base: str | os.PathLike[str], outside: bool = False):
        self.base, self.outside = os.fspath(base), outside
        self.scheme = scheme_of(self.base) or "file"

    @property
    def is_local(self) -> bool:
        return self.scheme == "file"

    def path(self, key: str) -> str:
        """The full path or URI of a key."""
        if scheme := scheme_of(key):
            if scheme != self.scheme:
                raise ValueError(f"key {key!r} has another scheme than the store's {self.scheme!r}")
            if not self.outside and not key.startswith(self.base.rstrip("/") + "/"):
                raise ValueError(f"key {key!r} is outside of the store")
            return key
        if key.startswith("/") or _WINDOWS.match(key) or ".." in re.split(r"[\\/]", key):
            if not self.outside:
                raise ValueError(f"key {key!r} is outside of the store")
            if key.startswith("/") or _WINDOWS.match(key):
                return key
        return f"{self.base.rstrip('/')}/{key}"

    def _local(self, key: str) -> Path:
        full = self.path(key)
        return Path(unquote(urlsplit(full).path) if scheme_of(full) else full)

    def _remote(self, key: str):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError(f"{self.base} needs an active Spark session")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path(key) if key else self.base)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path, spark._jvm

    def save(self, key: str, data: bytes) -> str:
        """Writes aside and moves into place, so that readers see all of it or nothing."""
        if self.is_local:
            at = self._local(key)
            at.parent.mkdir(parents=True, exist_ok=True)
            aside = at.with_name(f".{at.name}.{uuid.uuid4().hex}.tmp")
            aside.write_bytes(data)
            os.replace(aside, at)
        else:
            fs, path, jvm = self._remote(key)
            aside = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}.tmp")
            out = fs.create(aside, True)
            try:
                out.write(data)
            finally:
                out.close()
            if not fs.rename(aside, path):
                # File systems that don't replace a file by a rename.
                fs.delete(path, False)
                if not fs.rename(aside, path):
                    raise OSError(f"{key!r} can't be moved into place")
        return self.path(key)

    def load(self, key: str) -> bytes:
        if not self.exists(key):
            raise KeyError(key)
        if self.is_local:
            return self._local(key).read_bytes()
        fs, path, jvm = self._remote(key)
        stream = fs.open(path)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        if self.is_local:
            return self._local(key).exists()
        fs, path, _ = self._remote(key)
        return bool(fs.exists(path))

    def delete(self, key: str) -> None:
        """Deletes a file or a folder; a missing key is no error."""
        if self.is_local:
            at = self._local(key)
            if at.is_dir():
                shutil.rmtree(at)
            else:
                at.unlink(missing_ok=True)
        else:
            fs, path, _ = self._remote(key)
            fs.delete(path, True)

    def list_keys(self) -> list[str]:
        """Keys of all files, sorted; a folder that Spark wrote is one key."""
        if self.is_local:
            base = Path(unquote(urlsplit(self.base).path) if scheme_of(self.base) else self.base)
            files = [str(f.relative_to(base)).replace(os.sep, "/") for f in base.rglob("*") if f.is_file()] if base.is_dir() else []
        else:
            fs, path, _ = self._remote("")
            files, found = [], fs.listFiles(path, True) if fs.exists(path) else None
            root = fs.makeQualified(path).toUri().getPath().rstrip("/") + "/"
            while found is not None and found.hasNext():
                files.append(found.next().getPath().toUri().getPath().removeprefix(root))
        tables = {f.rpartition("/")[0] for f in files if re.search(r"(^|/)(_SUCCESS|part-[^/]*)$", f)}
        hidden = re.compile(r"(^|/)[._][^/]*$")

        def table_of(key: str) -> str | None:
            return next((t for t in tables if key.startswith(t + "/")), None)

        return sorted({table_of(f) or f for f in files if table_of(f) or not hidden.search(f)})

    @staticmethod
    def format_hint(key: str) -> str | None:
        """The last extension in lower case, if any."""
        name = re.split(r"[\\/]", key)[-1]
        return name.rpartition(".")[2].lower() or None if "." in name else None
