"""Small files that make a run's output visible: written whole, in order, and never over another."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another run has published since this one was planned."""


class Folder:
    """A folder of any Hadoop file system, seen from the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def names(self, folder: str = "") -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write under a hidden name, then rename without overwriting; :class:`Conflict` if ``name`` is there.

        A reader sees the whole file or none, and a writer that dies leaves only a hidden file behind.
        """
        folder, _, last = name.rpartition("/")
        target = self._path(f"{self.root}/{name}")
        hidden = self._path(f"{self.root}/{folder}/.{last}.{uuid.uuid4().hex}")
        if self._fs.exists(target):
            raise Conflict(f"{target} was published by another run")
        stream = self._fs.create(hidden, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        fc = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), self._conf) if hidden.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            fc.rename(hidden, target, options)
        except Exception as exc:  # the JVM's own exception type depends on the file system
            self._fs.delete(hidden, False)
            if self._fs.exists(target):
                raise Conflict(f"{target} was published by another run") from exc
            raise

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def numbered(names: list[str], prefix: str) -> list[tuple[int, str]]:
    """``(number, name)`` of the files that are named ``prefix`` and digits, in order."""
    return sorted((int(n[len(prefix) :].split(".")[0]), n) for n in names if n.startswith(prefix) and n[len(prefix) :].split(".")[0].isdigit())
