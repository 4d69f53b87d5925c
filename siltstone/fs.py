"""Files through Hadoop's file systems: local paths, HDFS and object stores alike."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from siltstone.errors import EngineError, NotFound


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):  # noqa: ANN202  a JVM object
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):  # noqa: ANN202
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs(folder).listStatus(self._path(folder)))

    def data_files(self, folder: str) -> list[tuple[str, int]]:
        """(path, bytes) of all files below a folder but hidden ones and markers."""
        out, todo = [], [self._path(folder)]
        fs = self._fs(folder)
        while todo:
            for s in fs.listStatus(todo.pop()):
                if s.getPath().getName().startswith(("_", ".")):
                    continue
                if s.isDirectory():
                    todo.append(s.getPath())
                else:
                    out.append((s.getPath().toString(), int(s.getLen())))
        return sorted(out)

    def size(self, path: str) -> int:
        return int(self._fs(path).getFileStatus(self._path(path)).getLen())

    def read(self, path: str) -> bytes:
        if not self.exists(path):
            raise NotFound(f"no file {path}")
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_new(self, path: str, content: bytes) -> None:
        """The whole file or none of it, and never over another, also if two processes write at once: one of them gets an error.
        Local disks: a hard link to the finished file. HDFS: a rename, which doesn't replace. Object stores, where files appear whole when they
        are closed: creation on condition that there is none, for which stores that know it are asked."""
        target, fs = self._path(path), self._fs(path)
        kind = fs.getUri().getScheme()
        if kind in ("file", "hdfs", "viewfs"):
            part = self._path(f"{path}.{self.jvm.java.util.UUID.randomUUID()}.part")
            self._put(fs.create(part, True), content)
            try:
                done = self._linked(part, target) if kind == "file" else not fs.exists(target) and fs.rename(part, target)
            finally:
                fs.delete(part, False)
            if not done:
                raise EngineError(f"{path} was written by another process")
            return
        try:
            self._put(fs.createFile(target).overwrite(False).opt("fs.option.create.conditional.overwrite", "true").recursive().build(), content)
        except Py4JJavaError as e:
            if "Exist" in e.java_exception.getClass().getName():
                raise EngineError(f"{path} was written by another process") from None
            raise

    @staticmethod
    def _put(out, content: bytes) -> None:  # noqa: ANN001  a JVM stream
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def _linked(self, part, target) -> bool:  # noqa: ANN001  JVM paths
        try:
            os.link(part.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)
