"""Intermediate tables in the cluster's shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tabmeter-")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the session names. Where none is set, a local master
    uses a temporary folder of its machine; a cluster has to name one."""
    if folder := spark.conf.get(SETTING, None):
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    return _local_folder()


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """Write a table once and read it back, column by column, while in use.

    This cuts the lineage, so a lost executor costs no recomputation of what
    led to the table. The files are deleted on leaving.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/tabmeter-{uuid.uuid4().hex}"
    names = df.columns
    # Positional names: any column name is allowed, in any file format.
    df.toDF(*[f"c{i}" for i in range(len(names))]).write.parquet(path)
    try:
        yield spark.read.parquet(path).toDF(*names)
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
