"""Records of CSV files whose quoted cells hold line breaks, read in splits.

A task sees the lines of its splits of a file, but not whether a split begins inside a quoted
cell. So each split is first read both ways: for either beginning, does it end inside one?
One such row a split settles, in the order of the file, how every split begins. Then each
task puts its lines together to records; what is left open at the end of a split is joined
with the beginnings of the following ones.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabmeter.functions.columns import ref

# Tasks receive these functions themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The rest of a quoted cell, up to its closing quote; doubled quotes are part of it.
CLOSING = re.compile(rb'(?:[^"]|"")*"(?!")', re.DOTALL)
HEADER, WHOLE, OPENS, GOES_ON = 0, 1, 2, 3


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line that begins inside a quoted cell, or not, ends inside one. A quote opens
    a cell only at its beginning."""
    if b'"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            while line[at : at + 1] != b'"':
                at = line.find(b",", at) + 1
                if not at:
                    return False
            at += 1
        closed = CLOSING.match(line, at)
        if closed is None:
            return True
        at, inside = line.find(b",", closed.end()) + 1, False
        if not at:
            return False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): the lines as bytes, with the file and the split they come from."""
    found = spark.read.option("lineSep", "\n").text(path)
    return found.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def has_open_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes. Where none has, each line is a record."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).agg(F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False))).first()[0])


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(x).to_pylist() for x in ("file", "start", "line")), strict=True)


def _both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends: dict[tuple[str, int], tuple[bool, bool]] = {}
    for file, start, line in _splits(batches):
        from_out, from_in = ends.get((file, start), (False, True))
        ends[file, start] = ends_inside(line, from_out), ends_inside(line, from_in)
    if ends:
        columns = zip(*((*key, *value) for key, value in ends.items()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["file", "start", "from_out", "from_in"])


def beginnings(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether each split begins inside a quoted cell.

    A split ends as it began, the other way round, or the same whatever its beginning. The
    last one before that settles its end, and the turns since, decide."""
    found = lines.mapInArrow(_both_ways, "file string, start bigint, from_out boolean, from_in boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    turns = F.col("from_out") & ~F.col("from_in")
    turned = found.withColumn("turns", F.sum(turns.cast("int")).over(upto) % 2)
    settled = F.when(F.col("from_out") == F.col("from_in"), (F.col("from_out").cast("int") + F.col("turns")) % 2)
    known = turned.withColumn("settled", settled)
    return known.select(
        "file",
        "start",
        (
            (F.coalesce(F.last("settled", True).over(before), F.lit(0)) + F.coalesce(F.last("turns").over(before), F.lit(0))) % 2 == 1
        ).alias("inside"),
    )


def fragments(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """(file, start, kind, data): records, and what of records is at either end of a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, bytes]] = []
        held: list[bytes] = []
        here, kind, open_ = None, WHOLE, False

        def close(last: int) -> None:
            if held:
                out.append((*here, last, b"\n".join(held)))

        for file, start, line in _splits(batches):
            if (file, start) != here:
                close(OPENS if kind != GOES_ON else GOES_ON)
                held, here, open_ = [], (file, start), (file, start) in inside
                kind = GOES_ON if open_ else HEADER if start == 0 else WHOLE
            held.append(line)
            open_ = ends_inside(line, open_)
            if not open_:
                close(kind)
                held, kind = [], WHOLE
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        close(OPENS if kind != GOES_ON else GOES_ON)
        if out:
            yield _batch(out)

    return lines.mapInArrow(run, "file string, start bigint, kind int, data binary")


def _batch(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["file", "start", "kind", "data"])


def read_records(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """The cells of all records as text, a column each, named by the header of the first file.

    The driver and each task hold one row for each split that begins inside a cell, about a
    millionth of the bytes of the files."""
    lines = lines_of(spark, path)
    begins = beginnings(lines).where("inside").select("file", "start").collect()
    found = fragments(lines, {(r["file"], r["start"]) for r in begins})
    header = found.where(F.col("kind") == HEADER).orderBy("file").limit(1).collect()
    names = column_names(header[0]["data"].decode(encoding) if header else "")
    parts = found.where(F.col("kind").isin(OPENS, GOES_ON))
    order = Window.partitionBy("file").orderBy("start", "kind_order")
    opener = F.last(F.when(F.col("kind") == OPENS, F.col("start")), True).over(order)
    # a split's beginning comes before what it leaves open
    opened = parts.withColumn("kind_order", F.when(F.col("kind") == GOES_ON, 0).otherwise(1)).withColumn("opener", opener)
    joined = opened.groupBy("file", "opener").agg(
        F.array_sort(F.collect_list(F.struct("start", F.col("data").cast("string").alias("data")))).alias("parts")
    )
    spanning = joined.select(F.array_join(F.transform("parts", lambda p: p["data"]), "\n").cast("binary").alias("data"))
    records = found.where(F.col("kind") == WHOLE).select("data").unionAll(spanning)
    text = F.rtrim(F.decode("data", encoding), F.lit("\r"))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = records.select(text.alias("text")).where(F.trim("text") != "")
    return cells.select(F.from_csv("text", schema, {"escape": '"'}).alias("r")).select("r.*").toDF(*names)


def column_names(header: str) -> list[str]:
    """Cells of a header; blank ones and those that come twice get their number."""
    cells = next(csv.reader([header.removeprefix("\ufeff").rstrip("\r")]), [])
    names = [cell or f"_c{i}" for i, cell in enumerate(cells)]
    return [f"{name}{i}" if names.count(name) > 1 else name for i, name in enumerate(names)]
