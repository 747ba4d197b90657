"""Column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

# The characters Python's str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What reads as a number. A failed cast costs far more than this test.
NUMBER = (
    r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    r"|^\s*[+-]?(?i:inf|infinity)\s*$"
)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """Column by exact name; names may hold dots, spaces or parentheses."""
    return F.col(quoted(name))


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole to two digits, 0.0 for an empty whole.

    The product is taken before the division, so only one operation rounds.
    """
    return F.round(F.coalesce(F.try_divide(part * 100, whole), F.lit(0.0)), 2)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), digits)


def finite(value: Column, digits: int = 4) -> Column:
    """NaN and infinities become NULL, anything else is rounded."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, F.round(value, digits))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def count_true(flags: Sequence[Column]) -> Column:
    """How many of the conditions hold; flat, so that thousands of them can be planned."""
    if not flags:
        return F.lit(0)
    return F.size(F.filter(F.array(*flags), lambda flag: flag))


def total(values: Sequence[Column]) -> Column:
    """Sum of many numbers of one type, as flat as count_true."""
    return F.aggregate(F.array(*values), F.lit(0).cast("bigint"), lambda left, right: left + right)


def text_form(value: Column, dtype: T.DataType) -> Column:
    """The string a rule is compared with: booleans read True / False."""
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    return value.cast("string")


def as_number(value: Column, dtype: T.DataType) -> Column:
    """Lenient number: whatever does not read as one is NULL."""
    if isinstance(dtype, T.BooleanType):
        return value.cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return value.cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(value.rlike(NUMBER), F.trim(value).try_cast("double"))
    return F.lit(None).cast("double")


def equals_literal(value: Column, dtype: T.DataType, literal) -> Column:
    """Null-safe `value = literal` which never casts text to a number."""
    if isinstance(dtype, T.BooleanType):
        if isinstance(literal, (bool, int, float)):
            return F.coalesce(value.cast("int") == F.lit(literal).cast("double"), F.lit(False))
        return F.lit(False)
    if isinstance(dtype, T.NumericType) != isinstance(literal, (bool, int, float)):
        return F.lit(False)
    if isinstance(literal, bool):
        literal = int(literal)
    return value.eqNullSafe(F.lit(literal))


def row_key(value: Column, dtype: T.DataType) -> Column:
    """Form of a column in which values can be grouped: nested values as JSON."""
    if isinstance(dtype, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(value)), {"ignoreNullFields": "false"})
    if isinstance(dtype, (T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value
