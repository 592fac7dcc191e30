"""Tables in the folder that driver and executors share: they cut lineage, so a lost executor costs no recomputation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir.

    Where it is unset, a session that runs in one process gets a temporary folder, which goes when the process ends; on
    a cluster it is an error, since executors don't see each other's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="arbora-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_folder.get() or shared_dir(spark) + '/arbora'}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from files, not from lineage."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, at = _at(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; of a missing folder: nothing."""
    files, at = _at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def create(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it was there."""
    files, at = _at(spark, path)
    return files.createNewFile(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written beside its place, then renamed."""
    files, at = _at(spark, path)
    half = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.half")
    out = files.create(half, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(at, False)
    if not files.rename(half, at):
        raise OSError(f"can't write {path}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is saved within goes to one folder, deleted at the end. The results must have been written by then."""
    folder = new_path(spark, "scratch")
    token = _folder.set(folder)
    try:
        yield folder
    finally:
        _folder.reset(token)
        drop(spark, folder)
