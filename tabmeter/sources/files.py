"""Readers and writers for the supported file formats."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabmeter.functions.columns import NUMBER, ref
from tabmeter.plans.statpass import Probe, run_probes
from tabmeter.sources.records import has_open_lines, read_records

# Cells of a text file that stand for a missing value.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# Cells read as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
# Encodings tried after the given one, and their names in Java.
FALLBACK_ENCODINGS = ("utf-8", "utf-8-sig", "latin-1")
JAVA_ENCODINGS = {
    "latin-1": "ISO-8859-1",
    "cp1252": "ISO-8859-1",
    "utf-8": "UTF-8",
    "utf-8-sig": "UTF-8",
}

#: What Windows writes where Latin-1 has control characters.
WINDOWS_LETTERS = {
    chr(code): bytes([code]).decode("cp1252")
    for code in range(0x80, 0xA0)
    if bytes([code]).decode("cp1252", errors="ignore")
}

SUPPORTED = (".csv", ".parquet", ".json")
WHOLE_NUMBER = r"^\s*[+-]?[0-9]+\s*$"
UNDECODABLE = "\ufffd"
CORRUPT = "_corrupt_record"

# What the cells of a column read as: one bit per kind.
WHOLE, DECIMAL, BOOLEAN, TEXT, BROKEN = 1, 2, 4, 8, 16


def load_table(
    spark: SparkSession,
    source: str,
    encoding: str = "latin-1",
    nrows: int | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Read a file or a folder of files by its suffix.

    `nrows` previews that many rows of a CSV. Files are split between tasks, as
    large ones need, also where quoted CSV cells hold line breaks; `multiline` reads each
    in one task. JSON that doesn't read as lines is read as documents.
    """
    suffix = PurePosixPath(str(source)).suffix.lower()
    if suffix not in SUPPORTED:
        raise ValueError(f"Unsupported file type '{suffix}'. Supported: {', '.join(SUPPORTED)}")
    if suffix == ".parquet":
        return spark.read.parquet(str(source))
    if suffix == ".json":
        lines = spark.read.option("multiLine", multiline).json(str(source))
        if lines.columns != [CORRUPT]:
            return lines
        return spark.read.option("multiLine", True).json(str(source))
    return read_csv(spark, str(source), encoding, nrows, multiline)


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "latin-1",
    nrows: int | None = None,
    multiline: bool = False,
) -> DataFrame:
    """CSV with a header; each column takes the narrowest type all cells fit.

    One pass over all cells finds the types. An encoding which cannot decode
    some cell is given up for the next; for UTF-8 the bytes decide, as the
    character that stands for broken ones may also be meant.
    """
    for name in (encoding, *FALLBACK_ENCODINGS):
        unicode = JAVA_ENCODINGS.get(name.lower()) == "UTF-8"
        if unicode and not _is_utf8(spark, path):
            continue
        raw = _strings(spark, path, name, multiline)
        if nrows is not None:
            raw = raw.limit(nrows)
        kinds = run_probes(raw, [Probe(c, _kinds(ref(c))) for c in raw.columns])
        kinds = {c: int(found or 0) for c, found in kinds.items()}
        if unicode or not any(found & BROKEN for found in kinds.values()):
            break
    return raw.select(*[_typed(ref(c), kinds[c]).alias(c) for c in raw.columns])


def _strings(spark: SparkSession, path: str, encoding: str, multiline: bool) -> DataFrame:
    java = JAVA_ENCODINGS.get(encoding.lower(), encoding)
    if not multiline and has_open_lines(spark, path):
        raw = read_records(spark, path, java)
    else:
        reader = spark.read.option("header", True).option("encoding", java).option("multiLine", multiline)
        raw = reader.option("escape", '"').csv(path)
    if encoding.lower() != "cp1252":
        return raw
    controls, letters = zip(*WINDOWS_LETTERS.items())
    return raw.select(*[F.translate(ref(c), "".join(controls), "".join(letters)).alias(c) for c in raw.columns])


def _is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether all bytes are UTF-8; lines are read as they are, and no character spans two."""
    return bool(spark.read.text(path).agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True))).first()[0])


def _is_missing(cell: Column) -> Column:
    return cell.isNull() | cell.isin(*MISSING_TOKENS)


def _kinds(cell: Column) -> Column:
    """The kinds among the cells of a column, as one small aggregate."""
    kind = (
        F.when(_is_missing(cell), 0)
        .when(cell.rlike(WHOLE_NUMBER) & cell.try_cast("bigint").isNotNull(), WHOLE)
        .when(cell.rlike(NUMBER), DECIMAL)
        .when(cell.isin(*TRUE_TOKENS, *FALSE_TOKENS), BOOLEAN)
        .when(cell.contains(UNDECODABLE), TEXT | BROKEN)
        .otherwise(TEXT)
    )
    return F.bit_or(kind)


def _typed(cell: Column, kinds: int) -> Column:
    """A column without any value reads as double."""
    kinds &= ~BROKEN
    cell = F.when(~_is_missing(cell), cell)
    if kinds == WHOLE:
        return cell.try_cast("bigint")
    if kinds in (0, DECIMAL, WHOLE | DECIMAL):
        return F.trim(cell).try_cast("double")
    if kinds == BOOLEAN:
        return cell.isin(*TRUE_TOKENS)
    return cell


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cells are written as they are, blanks at their ends too; quotes inside are doubled."""
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
