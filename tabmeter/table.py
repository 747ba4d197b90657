"""The table under assessment: a normalised DataFrame and its column kinds."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabmeter.functions.columns import ref, row_key
from tabmeter.functions.dates import as_instant, is_datetime


@dataclass(frozen=True)
class Table:
    """Missing values are NULL only: NaN is turned into NULL once, on entry."""

    df: DataFrame
    types: dict[str, T.DataType]
    date_options: dict
    # Hidden columns of df with the parsed form of text dates.
    parsed_as: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, source: "DataFrame | Table", **date_options) -> "Table":
        if isinstance(source, Table):
            return replace(source, date_options=source.date_options | date_options) if date_options else source
        columns = []
        for field in source.schema.fields:
            value = ref(field.name)
            if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
                value = F.nanvl(value, F.lit(None).cast(field.dataType))
            elif isinstance(field.dataType, T.NullType):
                value = value.cast("string")
            columns.append(value.alias(field.name))
        df = source.select(*columns)
        return cls(df, {f.name: f.dataType for f in df.schema.fields}, date_options)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def columns(self) -> list[str]:
        return list(self.types)

    @property
    def numeric(self) -> list[str]:
        """Numeric columns; booleans are not among them."""
        return [c for c, t in self.types.items() if isinstance(t, T.NumericType)]

    @property
    def datetimes(self) -> list[str]:
        return [c for c, t in self.types.items() if is_datetime(t)]

    @property
    def texts(self) -> list[str]:
        return [c for c, t in self.types.items() if isinstance(t, T.StringType)]

    def __contains__(self, column) -> bool:
        return column in self.types

    def ordinal(self, column: str) -> int:
        return self.columns.index(column)

    def with_dates(self, columns: Iterable[str]) -> "Table":
        """Parse text dates once per row, however many aggregates read them."""
        texts = [c for c in dict.fromkeys(columns) if isinstance(self.types.get(c), T.StringType)]
        hidden = {c: f"__instant_{self.ordinal(c)}" for c in texts}
        df = self.df.withColumns({hidden[c]: self.instant(c) for c in texts}) if texts else self.df
        return replace(self, df=df, parsed_as=hidden)

    def instant(self, column: str) -> Column:
        if column in self.parsed_as:
            return ref(self.parsed_as[column])
        return as_instant(ref(column), self.types[column], **self.date_options)

    def number(self, column: str) -> Column:
        return ref(column).cast("double")

    def keys(self) -> list[Column]:
        """Every column in a form that can be grouped and hashed."""
        return [row_key(ref(c), t).alias(c) for c, t in self.types.items()]
