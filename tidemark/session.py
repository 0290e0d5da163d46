"""Session settings and the shared scratch folder."""

import tempfile
import threading
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def tune(builder):
    """Settings the operators are designed around; sizes are left to the cluster."""
    return (builder
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.streaming.stateStore.providerClass",
                    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_root()


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once and read back: a stable cut of the lineage that outlives lost executors and stays columnar."""
    path = scratch_path(df.sparkSession, label)
    for paths in _open_scopes()[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes = threading.local()


def _open_scopes() -> list:
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    return _scopes.stack


@contextmanager
def scratch_scope(spark: SparkSession):
    """Removes what ``materialize`` wrote inside the block.

    For code that stores its result before the block ends; a frame that is used later still needs the files.
    """
    paths: list = []
    _open_scopes().append(paths)
    try:
        yield
    finally:
        _open_scopes().pop()
        for path in paths:
            system, target = _file_system(spark, path)
            system.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def is_folder(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target) and system.getFileStatus(target).isDirectory()


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Moves a folder in one step; false if the target is there already."""
    system, target = _file_system(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(to)
    return not system.exists(new) and system.rename(target, new)


def folders(spark: SparkSession, path: str) -> list:
    """Names of the folders inside of a folder; none if it is missing."""
    system, target = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(target) if s.isDirectory()] if system.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written through Spark's file systems."""
    system, target = _file_system(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
