import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabmeter import detect_schema, load_table, write_csv
from tabmeter.functions.dates import as_instant, shape


def types_of(found):
    return {c: info["dtype"] for c, info in found["columns"].items()}


def test_semantic_types(spark):
    rows = [
        (
            i,
            i % 3,
            i % 2,
            f"K{i}",
            f"u{i}@x.org",
            f"free text number {i}",
            "red" if i % 2 else "blue",
            f"{i % 12 + 1}/1/2020",
            "not a date" if i % 10 == 0 else "2020-01-01",
            dt.datetime(2020, 1, 1),
            i % 4 == 0,
            i * 1000,
            [i],
            None,
        )
        for i in range(200)
    ]
    df = spark.createDataFrame(
        rows,
        "order_id int, level int, bit int, key_id string, email string, note string, "
        "color string, seen string, created string, ts timestamp_ntz, ok boolean, "
        "shipping_days int, v array<int>, nothing string",
    )
    found = detect_schema(df)
    assert types_of(found) == {
        "order_id": "id",
        "level": "numeric",
        "bit": "boolean",
        "key_id": "id",
        "email": "text",
        "note": "text",
        "color": "categorical",
        "seen": "datetime",
        "created": "datetime",
        "ts": "datetime",
        "ok": "boolean",
        # A number reads as a date, so the name decides.
        "shipping_days": "datetime",
        "v": "categorical",
        "nothing": "boolean",
    }
    assert found["id_cols"] == ["order_id", "key_id"]
    assert found["columns"]["level"]["sample_values"] == ["0", "1", "2"]
    assert found["columns"]["nothing"]["null_pct"] == 100.0


def test_numbers_need_not_be_dates(spark):
    from tabmeter import Table

    df = spark.createDataFrame([(5,), (6,), (7,)], "shipping_days int")
    found = detect_schema(Table.of(df, numeric_dates=False))
    assert types_of(found) == {"shipping_days": "numeric"}


def test_shape_of_date_patterns():
    import re

    assert re.match(shape("M/d/yyyy H:mm"), "1/31/2020 9:05")
    assert not re.match(shape("M/d/yyyy"), "1-31-2020")
    assert re.match(shape("dd MMM yyyy"), "31 Jan 2020")
    assert re.match(shape("yyyyMMdd'T'HH"), "20200131T05")


def written(tmp_path, text, name="t.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


CSV = (
    "id,price,flag,mode,empty,mixed,when\n"
    '1, 1.5,True,"First, Class",,7,2020-01-01\n'
    '2,2,False,N/A,NA,x,01/02/2020 10:00\n'
    '3,1e3,true,"say ""hi""",,9,\n'
    ',nan,,null,,10,2020-01-03\n'
)


def test_csv_types_and_missing_tokens(spark, tmp_path):
    df = load_table(spark, written(tmp_path, CSV))
    assert dict(df.dtypes) == {
        "id": "bigint",
        "price": "double",
        "flag": "boolean",
        "mode": "string",
        "empty": "double",
        "mixed": "string",
        "when": "string",
    }
    rows = df.collect()
    assert [r["id"] for r in rows] == [1, 2, 3, None]
    assert [r["price"] for r in rows] == [1.5, 2.0, 1000.0, None]
    assert [r["mode"] for r in rows] == ["First, Class", None, 'say "hi"', None]


def test_csv_preview_and_line_breaks(spark, tmp_path):
    path = written(tmp_path, 'a,b\n1,"x\ny"\n2,z\n3,w\n')
    df = load_table(spark, path, nrows=2, multiline=True)
    assert [tuple(r) for r in df.collect()] == [(1, "x\ny"), (2, "z")]


def test_csv_encodings(spark, tmp_path):
    path = written(tmp_path, "a\ncafé\n", encoding="latin-1")
    assert load_table(spark, path).first()["a"] == "café"
    # The given encoding cannot decode the file, so the next is tried.
    assert load_table(spark, path, encoding="utf-8").first()["a"] == "café"
    path = written(tmp_path, "a\ncafé\n", "u.csv")
    assert load_table(spark, path, encoding="utf-8").first()["a"] == "café"


def test_the_replacement_character_is_a_character(spark, tmp_path):
    path = written(tmp_path, "a\ncafé\n\ufffd\n", "r.csv")
    assert [r["a"] for r in load_table(spark, path, encoding="utf-8").collect()] == ["café", "\ufffd"]


def test_windows_letters(spark, tmp_path):
    path = written(tmp_path, "a\n€5 “net”\n", "w.csv", encoding="cp1252")
    assert load_table(spark, path, encoding="cp1252").first()["a"] == "€5 “net”"


def test_json_lines_and_documents(spark, tmp_path):
    lines = written(tmp_path, '{"a": 1}\n{"a": 2}\n', "l.json")
    document = written(tmp_path, '[\n {\n  "a": 1\n },\n {\n  "a": 2\n }\n]\n', "d.json")
    for path in (lines, document):
        assert sorted(r["a"] for r in load_table(spark, path).collect()) == [1, 2]


def test_large_whole_numbers_read_as_double(spark, tmp_path):
    df = load_table(spark, written(tmp_path, "a\n1\n99999999999999999999\n"))
    assert df.dtypes == [("a", "double")]


def test_json_and_parquet(spark, tmp_path):
    path = written(tmp_path, '[{"a": 1, "b": "x"}, {"a": 2, "b": null}]', "t.JSON")
    assert sorted(tuple(r) for r in load_table(spark, path).collect()) == [(1, "x"), (2, None)]
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert load_table(spark, str(tmp_path / "t.parquet")).count() == 3


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="Unsupported file type '.txt'"):
        load_table(spark, "data.txt")


def test_csv_sink(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    write_csv(spark.createDataFrame([(1, None), (2, "x")], "a int, `b c` string"), path)
    assert sorted(tuple(r) for r in load_table(spark, path).collect()) == [(1, None), (2, "x")]


def test_dates_in_common_forms(spark):
    texts = {
        "31 Jan 2018": "2018-01-31 00:00:00",
        "Jan 31, 2018": "2018-01-31 00:00:00",
        "31.01.2018": "2018-01-31 00:00:00",
        "1/31/18": "2018-01-31 00:00:00",
        "1/31/98": "1998-01-31 00:00:00",
        "1/31/2018 10:56 PM": "2018-01-31 22:56:00",
        "2018/01/31 10:56": "2018-01-31 10:56:00",
        "31/1/18": None,
        "Jan 32, 2018": None,
        "in Jan 31, 2018 or so": None,
    }
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = frame.select("t", as_instant(F.col("t"), frame.schema["t"].dataType).cast("string").alias("at")).collect()
    assert {r["t"]: r["at"] for r in found} == texts
