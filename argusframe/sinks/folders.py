"""Folders of the file system that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


class Files:
    """Small files and listings of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, base: str):
        self.java, self.conf, self.base = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), base.rstrip("/")
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.java.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, none if it is missing."""
        at = self.path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def age_s(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        now = self.java.java.lang.System.currentTimeMillis()
        return (now - self.fs.getFileStatus(self.path(name)).getModificationTime()) / 1000

    def read_json(self, name: str):
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(self.java.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, value) -> bool:
        """Writes a file beside its place and renames it; False if another has taken the place."""
        beside = self.path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        try:
            if not self.fs.exists(self.path(name)) and self.rename(beside, self.path(name)):
                return True
        except Exception:  # noqa: BLE001  an existing target raises on some file systems, others return False
            pass
        self.fs.delete(beside, False)
        return False

    def rename(self, old, new) -> bool:
        """Renames without overwriting, as FileContext does on every file system."""
        context = self.java.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.java.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        context.rename(self.fs.makeQualified(old), self.fs.makeQualified(new), self.java.java.lang.reflect.Array.newInstance(options, 0))
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or (local runs only) below a new folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="argusframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
