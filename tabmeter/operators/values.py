"""Frequencies of the values of many columns at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabmeter.functions.columns import ref, row_key, text_form
from tabmeter.functions.dates import is_datetime
from tabmeter.plans.statpass import union
from tabmeter.table import Table

TOP = 5
SAMPLE = 3
# Longer texts are grouped by so many letters and a digest.
HEAD = 32
DIGEST = ("digest_1", "digest_2")
# Up to so many ranked values are looked up through the driver, more by a join.
LOOKUP = 10_000


def _family(dtype: T.DataType) -> str | None:
    """The type in which values of a kind share one grouping key."""
    if isinstance(dtype, (T.BooleanType, T.IntegralType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if is_datetime(dtype):
        return "timestamp_ntz"
    return None


def _text(table: Table, column: str) -> Column:
    dtype = table.types[column]
    return text_form(row_key(ref(column), dtype), dtype)


def _typed_cell(table: Table, column: str, family: str) -> Column:
    value = ref(column)
    if isinstance(table.types[column], T.BooleanType):
        value = value.cast("int")
    return F.struct(F.lit(table.ordinal(column)).alias("ordinal"), value.cast(family).alias("value"))


def _text_cell(table: Table, column: str, *extra: Column) -> Column:
    """A text by its first HEAD letters and, if it has more, 128 bits of hash."""
    text = _text(table, column)
    long = F.char_length(text) > HEAD
    return F.struct(
        F.lit(table.ordinal(column)).alias("ordinal"),
        F.left(text, F.lit(HEAD)).alias("value"),
        *[F.when(long, F.xxhash64(F.lit(seed), text)).alias(name) for seed, name in enumerate(DIGEST, 1)],
        *extra,
    )


def _cells(table: Table, cells: list[Column]) -> DataFrame:
    rows = table.df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rows.where("value IS NOT NULL")


def value_counts(table: Table, columns: list[str]) -> list[DataFrame]:
    """(ordinal, value, n) of the present values, one frame per type family.

    The columns of a family are turned into rows and grouped in their own type.
    Equal values combine before the shuffle, so a value held by most rows
    travels once per task; the key includes the value, so none gathers in a
    single task. Of a text longer than HEAD letters only its first letters and a digest
    (DIGEST) travel.
    """
    families: dict[str | None, list[str]] = {}
    for column in columns:
        families.setdefault(_family(table.types[column]), []).append(column)
    frames = []
    for family, members in families.items():
        if family is None:
            present = _cells(table, [_text_cell(table, c) for c in members])
        else:
            present = _cells(table, [_typed_cell(table, c, family) for c in members])
        frames.append(present.groupBy(*present.columns).agg(F.count(F.lit(1)).alias("n")))
    return frames


def _named(table: Table, frame: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(c) for c in table.columns])
    return frame.withColumn("column", F.get(names, F.col("ordinal")))


def distinct_counts(
    source: DataFrame | Table, columns: list[str] | None = None, rsd: float | None = None
) -> DataFrame:
    """(column, ordinal, unique_count): distinct present values per column.

    Exact unless `rsd` names a relative deviation to accept: then one pass of
    sketches replaces the grouping.
    """
    table = Table.of(source)
    columns = table.columns if columns is None else columns
    if rsd is not None:
        found = table.df.agg(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.lit(table.ordinal(c)).alias("ordinal"),
                        F.approx_count_distinct(row_key(ref(c), table.types[c]), rsd).alias(
                            "unique_count"
                        ),
                    )
                    for c in columns
                ]
            ).alias("rows")
        )
        return found.select(F.inline("rows"))
    return _named(table, _unique(table, columns, value_counts(table, columns))).select("column", "ordinal", "unique_count")


def _unique(table: Table, columns: list[str], frames: list[DataFrame]) -> DataFrame:
    found = [f.select("ordinal", "n") for f in frames]
    # A column without any value has no group, so each gets an empty one.
    every = F.explode(F.array(*[F.lit(table.ordinal(c)) for c in columns])).alias("ordinal")
    found.append(table.spark.range(1).select(every, F.lit(None).cast("bigint").alias("n")))
    return union(found).groupBy("ordinal").agg(F.count("n").alias("unique_count"))


def _candidates(frames: list[DataFrame], by_count: bool, most: int) -> DataFrame:
    """(ordinal, value, n, rank, digests) of what may be among the first of each column. The rank
    limit is applied before the shuffle too, so a column sends few rows per task. Long texts
    with the same first letters tie, and all that tie with a wanted one stay, without a rank."""
    kept = []
    for frame in frames:
        order = Window.partitionBy("ordinal").orderBy(*([F.desc("n")] if by_count else []), F.asc("value"))
        late = DIGEST[0] in frame.columns
        ranked = frame.withColumn("rank", (F.rank() if late else F.row_number()).over(order)).where(F.col("rank") <= most)
        digests = [F.col(x) if late else F.lit(None).cast("bigint").alias(x) for x in DIGEST]
        rank = F.lit(None).cast("int").alias("rank") if late else "rank"
        kept.append(ranked.select("ordinal", F.col("value").cast("string").alias("value"), "n", rank, *digests))
    return union(kept)


def _whole_texts(table: Table, columns: list[str], found: DataFrame, few: bool) -> DataFrame:
    """`found` with the whole texts for the digests, from a second look at their columns.

    If few are wanted they are sent to the tasks, which send back one text for each."""
    wanted = found.where(F.col(DIGEST[0]).isNotNull()).select("ordinal", *DIGEST)
    cells = _cells(table, [_text_cell(table, c, _text(table, c).alias("whole")) for c in columns])
    keys = ["ordinal", *DIGEST]
    texts = cells.join(F.broadcast(wanted) if few else wanted, keys, "left_semi")
    texts = texts.groupBy(*keys).agg(F.min("whole").alias("whole"))
    return found.join(texts, keys, "left").withColumn("value", F.coalesce("whole", "value")).drop("whole")


def _ranked(table: Table, candidates: DataFrame, by_count: bool, most: int) -> DataFrame:
    """The first rows of each column, and rows of other kinds (without n) as they are."""
    held = candidates.limit(LOOKUP + 1).collect()
    few = len(held) <= LOOKUP
    found = table.spark.createDataFrame(held, candidates.schema) if few else candidates
    names = table.columns
    long = {r["ordinal"] for r in held if r[DIGEST[0]] is not None}
    if not few:
        long = {i for i, c in enumerate(names) if _family(table.types[c]) is None}
    if long:
        found = _whole_texts(table, [names[i] for i in sorted(long)], found, few)
    order = Window.partitionBy("ordinal", F.col("n").isNull()).orderBy(*([F.desc("n")] if by_count else []), F.asc("value"))
    place = F.when(F.col("n").isNotNull(), F.coalesce("rank", F.row_number().over(order)))
    ranked = found.withColumn("rank", place).where(F.col("rank").isNull() | (F.col("rank") <= most))
    return _named(table, ranked)


def top_values(
    source: DataFrame | Table, columns: list[str] | None = None, most: int = TOP
) -> DataFrame:
    """(column, ordinal, rank, value, n): most frequent values, ties by value."""
    table = Table.of(source)
    if columns is None:
        columns = [c for c in table.columns if not isinstance(table.types[c], T.NumericType)]
    return _first_values(table, columns, True, most)


def _first_values(table: Table, columns: list[str], by_count: bool, most: int) -> DataFrame:
    if not columns:
        return table.spark.createDataFrame([], "column string, ordinal int, rank int, value string, n bigint")
    candidates = _candidates(value_counts(table, columns), by_count, most)
    return _ranked(table, candidates, by_count, most).select("column", "ordinal", "rank", "value", "n")


def value_summary(source: DataFrame | Table, most: int = TOP, by_count: bool = True) -> DataFrame:
    """(column, ordinal, unique_count, rank, value, n) of all columns: a row with the number of
    distinct values of each column, and rows with its most frequent values, or its smallest
    ones. Both come from the same grouping, which is shuffled once."""
    table = Table.of(source)
    found = _ranked(table, _summary(table, most, by_count), by_count, most)
    return found.select("column", "ordinal", "unique_count", "rank", "value", "n")


def _summary(table: Table, most: int, by_count: bool) -> DataFrame:
    frames = value_counts(table, table.columns)
    unique = _unique(table, table.columns, frames)
    return _candidates(frames, by_count, most).unionByName(unique, allowMissingColumns=True)


def sample_values(
    source: DataFrame | Table, columns: list[str] | None = None, most: int = SAMPLE
) -> DataFrame:
    """(column, ordinal, rank, value, n): smallest distinct values of each column."""
    table = Table.of(source)
    return _first_values(table, table.columns if columns is None else columns, False, most)
