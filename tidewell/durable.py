"""Durable intermediate results in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_owned: list[list[str]] = []  # paths of the open scratch blocks


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only an unset, local session gets a temporary one."""
    sc = spark.sparkContext
    path = spark.conf.get(SETTING, None) or sc.getConf().get(SETTING) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidewell-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block are deleted when it ends, so nothing that is still wanted may be read from them."""
    _owned.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _owned.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append(path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a table below the shared folder and read it back.

    Meant for prepared series that several later steps read: their scans then prune columns and skip row groups, and
    nothing before the table runs again, also when executors are lost.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
