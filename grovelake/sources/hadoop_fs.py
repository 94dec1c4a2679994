"""Small files in any file system that Spark knows, through Hadoop's FileSystem; file:// by the system's own atomic calls."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def uri(place: str) -> str:
    """A place with a scheme; one without is in the local file system, s3:// is read as s3a://."""
    if place.startswith("s3://"):
        return "s3a://" + place[5:].rstrip("/")
    return place.rstrip("/") if "://" in place else "file://" + os.path.abspath(place)


def is_local(place: str) -> bool:
    return uri(place).startswith("file://")


class Folder:
    """Texts by name below a folder."""

    def __init__(self, spark: SparkSession, place: str):
        self.uri = uri(place)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def _local(self, name: str) -> str:
        return f"{self.uri.removeprefix('file://')}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        """What a folder below holds, in order; nothing if it isn't there."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        out = self._fs.create(self._path(name), overwrite)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def replace(self, name: str, text: str) -> None:
        """Write a text, whatever was there; readers see the old or the new one where renames are atomic."""
        if not self.uri.startswith("file://"):
            return self._write(name, text, True)
        beside = f"{self._local(name)}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(beside), exist_ok=True)
        with open(beside, "w") as f:
            f.write(text)
        os.replace(beside, self._local(name))

    def create(self, name: str, text: str) -> bool:
        """Write a text where there is none; False if there is one. Of several at the same time, one succeeds.

        Local files take a hard link; object stores a create without overwriting, as an object appears when it is complete; other
        file systems a rename, which must not replace what is there, as HDFS doesn't.
        """
        if self.exists(name):
            return False
        if self.uri.startswith("s3a://"):
            try:
                self._write(name, text, False)
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            return True
        beside = f"{name}.{uuid.uuid4().hex}"
        if self.uri.startswith("file://"):
            self.replace(beside, text)
            try:
                os.link(self._local(beside), self._local(name))
            except FileExistsError:
                return False
            finally:
                os.remove(self._local(beside))
            return True
        self._write(beside, text, False)
        if self._fs.rename(self._path(beside), self._path(name)):
            return True
        self._fs.delete(self._path(beside), False)
        return False

    def move(self, name: str, to: str) -> None:
        """Rename over what may be there."""
        if self.uri.startswith("file://"):
            return os.replace(self._local(name), self._local(to))
        self._fs.delete(self._path(to), False)
        self._fs.rename(self._path(name), self._path(to))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), False)

    def delete_all(self) -> None:
        """The folder with all that is in it."""
        self._fs.delete(self._path(""), True)
