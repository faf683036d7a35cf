"""Metadata files through Hadoop's FileSystem, so any scheme that Spark reads works.  Driver-side and small."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def qualified(self, path: str) -> str:
        fs, p = self._fs(path)
        return fs.makeQualified(p).toString()

    def create(self, path: str, value: Any) -> bool:
        """A new JSON file, whole or not at all; False if it exists: that is how commits exclude each other.

        It is written aside and then gets its name: by a link on local disks
        and by a rename elsewhere, both of which fail where the name is taken.
        Object stores have neither, but show a file only when it is whole.
        """
        fs, p = self._fs(path)
        if fs.exists(p):
            return False
        scheme, data = fs.getUri().getScheme(), bytearray(json.dumps(value).encode())
        aside = p if scheme in ("s3", "s3a", "s3n", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cos") else self.jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        try:
            out = fs.create(aside, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or fs.exists(p):
                return False
            raise
        out.write(data)
        out.close()
        if aside is p:
            return True
        try:
            if scheme == "file":
                try:
                    os.link(aside.toUri().getPath(), p.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return bool(fs.rename(aside, p))
        finally:
            fs.delete(aside, False)

    def read(self, path: str) -> Any:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """All files below: path, bytes, modification time in ms."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return out

    def size(self, path: str) -> int:
        fs, p = self._fs(path)
        return fs.getFileStatus(p).getLen()

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def folder(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.mkdirs(p)

    def rename(self, a: str, b: str) -> None:
        fs, p = self._fs(a)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(b)):
            raise OSError(f"cannot rename {a} to {b}")
