"""The folder that all executors share, and tables or files written to it.

``spark.checkpoint.dir`` names it.  Where that is unset (tests on a local master) a folder under ``TMPDIR``, else
``/tmp``, is set, and deleted when the process ends; on a cluster an unset folder is an error, never a machine-local one.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder of this session."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.abspath(os.path.join(os.environ.get("TMPDIR", "/tmp"), f"quernel-shared-{os.getpid()}"))
        sc.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """(filesystem, path in it) of a URI; local paths too.  Usable on executors."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_bytes(uri: str, data: bytes) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read()
