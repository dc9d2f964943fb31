"""Readers for the Parquet tables of a data folder, and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # the temporary folder of a local session without a setting


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Spark's reader opens it, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_store(spark: SparkSession, path: str):
    """The path and its store, in the JVM."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    there, store = _in_store(spark, path)
    return store.exists(there)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies; one that is gone already is no error."""
    there, store = _in_store(spark, path)
    store.delete(there, True)


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: what tells whether something made from it is still right."""
    there, store = _in_store(spark, path)
    files = store.listStatus(there)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session is over; what is left is the store's to clean
        pass


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, removed when the program ends. Where that is unset, a temporary
    folder serves a local session; on a cluster other machines could not see one, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        session = spark.sparkContext.applicationId
        if session not in _LOCAL:
            _LOCAL[session] = "file://" + tempfile.mkdtemp(prefix="notelens-")
        base = _LOCAL[session]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Python workers get batches of no more than ``size`` bytes, or what the session allows, while the block runs."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(limit)
    allowed = was.lower().removesuffix("b")
    if not allowed.isdigit() or not 0 < int(allowed) <= size:
        spark.conf.set(limit, str(size))
    try:
        yield
    finally:
        spark.conf.set(limit, was)


class Scratch:
    """What an operator writes on its way to a result that it has staged elsewhere; removed when the block ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, shared_dir(spark, name)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.root)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
