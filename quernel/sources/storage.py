"""Files of tables and catalogs, through Hadoop's file systems, so that any shared store works."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """Where tables without a folder of their own are kept: the folder that all executors share."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.abspath(os.path.join(os.environ.get("TMPDIR", "/tmp"), f"quernel-tables-{os.getpid()}"))
        sc.setCheckpointDir(found)
    return f"{found.rstrip('/')}/engine-{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str) -> DataFrame:
    """Write df under folder and read it back."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small files and folders by URI."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, uri: str):
        path = self.jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.conf), path

    def exists(self, uri: str) -> bool:
        fs, path = self._at(uri)
        return fs.exists(path)

    def read(self, uri: str) -> str:
        fs, path = self._at(uri)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, uri: str, text: str) -> bool:
        """Create a file with its whole content in one step; False if it is there already."""
        fs, path = self._at(uri)
        fresh = self.jvm.org.apache.hadoop.fs.Path(f"{uri}.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        fresh, path = fs.makeQualified(fresh), fs.makeQualified(path)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.conf)
        if not fs.exists(path):
            try:
                # without OVERWRITE: the loser of a race gets an error
                context.rename(fresh, path, self._no_options())
                return True
            except Exception as e:
                if not fs.exists(path):
                    raise e
        fs.delete(fresh, False)
        return False

    def _no_options(self):
        return self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)

    def names(self, uri: str) -> list[str]:
        fs, path = self._at(uri)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def remove(self, uri: str) -> None:
        fs, path = self._at(uri)
        fs.delete(path, True)

    def copy(self, a: str, b: str) -> None:
        fs, path = self._at(a)
        gs, other = self._at(b)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, gs, other, False, self.conf)
