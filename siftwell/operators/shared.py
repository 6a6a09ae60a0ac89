"""The folder that driver and executors share, tables written there on the way, and its files."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new folder on a single machine, an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftwell-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written once to the session's shared folder, so that rounds don't stack up lineage."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_LOCK = threading.Lock()


class Files:
    """The few file operations that versions and runs need, by Hadoop's file system of the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.context, self.path = spark.sparkContext, path.rstrip("/")
        self.jvm, self.conf = self.context._jvm, self.context._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[tuple[str, float, int]]:
        """(name, seconds since it changed, bytes) of what a folder has."""
        if not self.fs.exists(self._path(folder)):
            return []
        now = time.time()
        return [(s.getPath().getName(), now - s.getModificationTime() / 1000, s.getLen()) for s in self.fs.listStatus(self._path(folder))]

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a file with this text, whole; False if there is one."""
        draft = self._path(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        plain = self.context._gateway.new_array(kind, 1)
        plain[0] = kind.NONE
        with _LOCK:
            if not self.fs.exists(self._path(name)):
                try:
                    self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf).rename(draft, self._path(name), plain)
                    return True
                except Exception as e:
                    if "FileAlreadyExistsException" not in str(e):
                        raise
        self.delete(draft.getName() if "/" not in name else f"{name.rpartition('/')[0]}/{draft.getName()}")
        return False

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
