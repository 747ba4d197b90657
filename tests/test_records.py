"""CSV records over line breaks, whatever the splits."""

import csv
import io
import random

import pytest

from tabmeter import load_table
from tabmeter.sources.records import beginnings, column_names, ends_inside, lines_of


def test_lines_end_inside_an_open_cell():
    cases = [
        (b"a,b", False, False),
        (b'a,"b', False, True),
        (b'a,"b""', False, True),
        (b'a,"b"""', False, False),
        (b'a,"b",c', False, False),
        (b'5" wide,b', False, False),
        (b'a,"b" x,"c', False, True),
        (b"plain", True, True),
        (b'end",x', True, False),
        (b'end","again', True, True),
        (b'""', True, True),
        (b'"', True, False),
    ]
    for line, before, after in cases:
        assert ends_inside(line, before) == after, (line, before)


def made_up(seed: int, rows: int) -> list[list[str]]:
    draw = random.Random(seed)
    cells = ["x", 'say "hi"', "two\nlines", "a,b", 'open "\n\n" quotes', "", "é", "\nfirst ", "long " * 30 + "\n" * 3, '"']
    return [[str(i), draw.choice(cells), draw.choice(cells), "z"] for i in range(rows)]


@pytest.mark.parametrize("size", [150, 5000])
def test_records_are_whole_in_small_splits(spark, tmp_path, size):
    rows = made_up(size, 120)
    for name in ("a.csv", "b.csv"):
        text = io.StringIO()
        csv.writer(text, lineterminator="\r\n" if name == "b.csv" else "\n").writerows([["n", "one", "two", "last"], *rows])
        (tmp_path / name).write_bytes(text.getvalue().encode())
    before = {x: spark.conf.get(x) for x in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for name in before:
            spark.conf.set(name, str(size))
        lines = lines_of(spark, str(tmp_path))
        assert beginnings(lines).where("inside").count() > 0 or size > 1000
        found = load_table(spark, str(tmp_path / "*.csv"), encoding="utf-8").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    expected = sorted((int(a), b or None, c or None, d) for a, b, c, d in rows * 2)
    assert sorted((tuple(r) for r in found), key=repr) == sorted(expected, key=repr)


def test_line_breaks_by_default(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('\ufeffa,b\r\n1,"x\r\ny"\r\n2,z\r\n\r\n3,"w"'.encode())
    assert sorted(tuple(r) for r in load_table(spark, str(path), "utf-8-sig").collect()) == [(1, "x\r\ny"), (2, "z"), (3, "w")]


def test_names_of_columns():
    assert column_names('\ufeffa,,"b\nc",a') == ["a0", "_c1", "b\nc", "a3"]
