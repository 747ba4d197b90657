"""Helpers of the training-data operators: tables in the shared folder, samples, batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


class Staged:
    """Tables written once to the shared folder, so that later jobs neither compute
    them again nor depend on the executors that made them."""

    _left: list[Staged] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        Staged._left.append(self)

    def write(self, frame: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{name}"
        frame.write.option("compression", compression).parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables that these frames read directly; they are no longer needed."""
        for frame in frames:
            for file in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
                self._delete(file.replace("file:///", "file:/"))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    @staticmethod
    @atexit.register
    def _sweep() -> None:
        for staged in Staged._left:
            if staged.spark.sparkContext._jsc is not None and staged.paths:
                staged._delete(staged.folder)


ROW = "llm_row"


def free(name: str, columns: list[str]) -> str:
    """`name`, made longer until no column has it, in capitals or not."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, staged: Staged, name: str = ROW) -> DataFrame:
    """`docs` with a number of each row in a further column, written, so that each later read
    finds the same numbers."""
    return staged.write(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(name).to_pylist() for name in names), strict=True)


DRAWS = 1 << 40


def drawn(share: float | Column, *names: str) -> Column:
    """Whether a row is in a sample of about that share of all rows: a hash of the named
    columns decides, so no task needs to see other rows, and it is the same each time."""
    return F.pmod(F.xxhash64(F.lit("sample"), *names), F.lit(DRAWS)) < F.lit(share) * F.lit(float(DRAWS))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
