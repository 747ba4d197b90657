"""Lenient date parsing, independent of row order."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

# Tried in turn after the ISO form.
DATE_FORMATS = (
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "M/d/yyyy H:mm:ss",
    "yyyy/M/d",
    "yyyy/M/d H:mm:ss",
    "d-MMM-yyyy",
    "yyyyMMdd",
    "d MMM yyyy",
    "MMM d, yyyy",
    "d.M.yyyy",
    "M/d/yyyy h:mm a",
    "yyyy/M/d H:mm",
    "M/d/yy",
)

# Years of two digits up to this one are after 2000, as in POSIX.
LAST_SHORT_YEAR = 2068

# Numbers beyond what 64 bits of nanoseconds hold are no dates.
NANOSECONDS = 2.0**63

# A value of another shape is not parsed at all: a failed parse costs far more
# than this test, and a column of free text would fail on every row.
ISO_SHAPE = r"^(?!0000)[0-9]{4}(-[0-9]{1,2}(-[0-9]{1,2}([T ].*)?)?)?$"


def shape(pattern: str) -> str:
    """Regular expression that every text of a date pattern matches."""
    found, separated = "", re.search(r"[^A-Za-z]", pattern)
    for part in re.finditer(r"'([^']*)'|([A-Za-z])\2*|[^A-Za-z']+", pattern):
        run = part.group(0)
        if part.group(1) is not None:
            found += re.escape(part.group(1) or "'")
        elif run[0] in "yudHhKkmsSn" or run in ("M", "MM", "L", "LL"):
            # Patterns without separators need the width of each part.
            found += "[0-9]+" if separated else f"[0-9]{{{len(run)}}}"
        elif run[0] in "MLEa":
            found += "[^0-9]{1,20}"
        elif part.group(2):
            found += ".+"
        else:
            found += re.escape(run)
    return f"^{found}$"


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def wall_clock(text: Column, pattern: str) -> Column:
    """The time a text tells by a pattern, in no time zone; NULL where it tells none."""
    readable = F.try_to_timestamp(text, F.lit(pattern)).isNotNull()
    instant = F.to_timestamp_ntz(text, F.lit(pattern))
    if re.search(r"(?<![yu])(yy|uu)(?![yu])", pattern):
        before = instant - F.make_ym_interval(F.lit(100), F.lit(0))
        instant = F.when(F.year(instant) > LAST_SHORT_YEAR, before).otherwise(instant)
    return F.when(readable, instant)


def as_instant(
    value: Column,
    dtype: T.DataType,
    formats: Sequence[str] = DATE_FORMATS,
    numeric_dates: bool = True,
) -> Column:
    """Wall-clock timestamp, or NULL where the value is not a date.

    With `numeric_dates` numbers count as nanoseconds since 1970.
    """
    if is_datetime(dtype):
        return value.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        stripped = F.trim(value)
        parsed = [F.when(stripped.rlike(ISO_SHAPE), stripped.try_cast("timestamp_ntz"))]
        for pattern in formats:
            instant = wall_clock(stripped, pattern)
            parsed.append(F.when(stripped.rlike(shape(pattern)), instant))
        return F.coalesce(*parsed)
    if isinstance(dtype, T.NumericType) and numeric_dates:
        number = value.cast("double")
        seconds = F.floor(number / 1e9)
        days = F.floor(seconds / 86400).cast("int")
        midnight = F.dateadd(F.lit("1970-01-01").cast("date"), days).cast("timestamp_ntz")
        instant = midnight + F.make_dt_interval(secs=F.pmod(seconds, F.lit(86400)))
        return F.when(F.abs(number) < NANOSECONDS, instant)
    return F.lit(None).cast("timestamp_ntz")
