"""Named append-only files of a store, on any filesystem that Hadoop reaches, or in memory."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def check_name(name: str) -> str:
    """Letters, digits, dots, hyphens and underscores; no dot in front."""
    if not name or name[0] == "." or not all(c.isalnum() or c in "._-" for c in name):
        raise ValueError(f"not a file name of a store: {name!r}")
    return name


class MemoryBlobs:
    """A test double: files are byte strings."""

    def __init__(self) -> None:
        self.files: dict[str, bytes] = {}

    def names(self) -> list[str]:
        return sorted(self.files)

    def exists(self, name: str) -> bool:
        return check_name(name) in self.files

    def create(self, name: str, data: bytes) -> None:
        if self.exists(name):
            raise FileExistsError(name)
        self.files[name] = data

    def read(self, name: str) -> bytes:
        return self.files[check_name(name)]

    def delete(self, name: str) -> None:
        del self.files[check_name(name)]


class Blobs:
    """Files in one folder; create() fails where the file exists and is atomic (written aside, then renamed)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm = spark._jvm
        self.folder = folder.rstrip("/")
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path())

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path()))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(check_name(name)))

    def create(self, name: str, data: bytes) -> None:
        if self.exists(name):
            raise FileExistsError(name)
        aside = self._path(f"_{name}.part")
        out = self._fs.create(aside, True)
        out.write(data)
        out.close()
        if not self._fs.rename(aside, self._path(name)):
            raise FileExistsError(name)

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(check_name(name)))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(check_name(name)), True)

    def read_json(self, name: str) -> dict:
        return json.loads(self.read(name))
