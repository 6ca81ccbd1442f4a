"""Tables written on the way, in the folder that driver and executors share; folders of any file system."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local temporary one only on a local master."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = spark.conf.get("vellum.local.scratch", None) or tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("vellum.local.scratch", path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df, read back from Parquet so that its lineage ends there, and its path."""
    path = f"{folder(df.sparkSession)}/vellum/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Folder:
    """A folder of any Hadoop file system, read and written as streams."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self.path.getFileSystem(self._conf)
        self._fs.setWriteChecksum(False)
        self._fs.setVerifyChecksum(False)
        self._fs.mkdirs(self.path)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), False)

    def names(self) -> dict[str, int]:
        """Files and when they were changed."""
        return {x.getPath().getName(): x.getModificationTime() for x in self._fs.listStatus(self.path)}

    def rename(self, old: str, new: str) -> None:
        """Replaces new in one step."""
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(context.makeQualified(self._fs.makeQualified(self._at(old))), self._fs.makeQualified(self._at(new)), how)

    def write(self, name: str, parts: Iterable[bytes]) -> None:
        out = self._fs.create(self._at(name), True)
        try:
            for part in parts:
                out.write(bytearray(part))
        finally:
            out.close()

    def read(self, name: str, step: int = 1 << 20) -> Iterator[bytes]:
        data = self._fs.open(self._at(name))
        try:
            while part := bytes(data.readNBytes(step)):
                yield part
        finally:
            data.close()
