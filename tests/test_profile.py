"""Statistics against pandas, which the tests alone use as an oracle."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tabmeter import column_table, dataset_summary, profile
from tabmeter.operators.correlation import correlation_matrix, strong_pairs
from tabmeter.operators import median, values
from tabmeter.operators.median import median_frame, medians
from tabmeter.operators.profile import missing_map, numeric_stats, summary_frame, top_missing
from tabmeter.operators.values import distinct_counts, sample_values, top_values
from tabmeter.table import Table

INF = float("inf")


def frame(n=400):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "count": rng.integers(0, 5, n),
            "price": rng.lognormal(size=n),
            "gaps": np.where(rng.uniform(size=n) < 0.3, np.nan, rng.normal(size=n)),
            "flat": 0.1,
            "flag": rng.uniform(size=n) < 0.25,
            "word": rng.choice(["a", "b", "c", None], n),
            "day": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 9, n), "D"),
        }
    )
    return pdf


@pytest.fixture(scope="module")
def pdf():
    return frame()


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5)


@pytest.fixture(scope="module")
def stats(df):
    return profile(df)


def test_numeric_columns_match_pandas(stats, pdf):
    for name in ("count", "price", "gaps", "flag"):
        s, info = pdf[name].astype("float64"), stats["columns"][name]
        expected = {
            "mean": s.mean(),
            "std": s.std(),
            "min": s.min(),
            "max": s.max(),
            "median": s.median(),
            "skewness": s.skew(),
            "kurtosis": s.kurtosis(),
        }
        for key, value in expected.items():
            assert info[key] == pytest.approx(value, abs=6e-5), (name, key)
        assert info["zeros_count"] == (s == 0).sum()
        assert info["null_count"] == s.isna().sum()
        assert info["unique_count"] == s.nunique()


def test_constant_column(stats):
    flat = stats["columns"]["flat"]
    assert (flat["std"], flat["skewness"], flat["kurtosis"]) == (0.0, 0.0, 0.0)
    assert stats["correlation_matrix"]["flat"]["price"] is None


def test_top_values(stats, pdf):
    assert stats["columns"]["word"]["top_values"] == pdf["word"].value_counts().to_dict()
    assert len(stats["columns"]["day"]["top_values"]) == 5


def test_totals(stats, pdf):
    gaps = int(pdf.isna().sum().sum())
    assert stats["total_missing_cells"] == gaps
    assert stats["overall_missing_pct"] == round(gaps / pdf.size * 100, 2)
    assert stats["duplicate_rows"] == int(pdf.duplicated().sum())
    assert list(stats["missing_map"])[:1] == ["gaps"]
    counts = [stats[f"{k}_col_count"] for k in ("numeric", "categorical", "datetime")]
    assert counts == [4, 1, 1]


def test_correlation_matches_pandas(stats, pdf):
    expected = pdf[["count", "price", "gaps"]].corr().round(4)
    for a in expected:
        for b in expected:
            assert stats["correlation_matrix"][a][b] == pytest.approx(expected.loc[a, b], abs=1e-4)


def test_wide_correlation_matches_pandas(spark):
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(size=(300, 14)) + 1e6, columns=[f"x.{i}" for i in range(14)])
    wide["x.1"] = wide["x.0"] * 2 + rng.normal(size=300) / 10
    wide.iloc[:90, 3] = np.nan
    wide.iloc[60:200, 4] = np.nan
    wide["x.9"] = 5.0
    df = spark.createDataFrame(wide).repartition(3)
    expected = wide.corr()
    found = correlation_matrix(df).collect()
    assert len(found) == 14 * 14
    for r in found:
        value = expected.loc[r["row_column"], r["col_column"]]
        if np.isnan(value):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(value, abs=1e-4)


def test_strong_pairs_of_500_columns(spark):
    rng = np.random.default_rng(8)
    wide = pd.DataFrame(rng.normal(size=(200, 500)), columns=[f"c{i}" for i in range(500)])
    wide["c499"] = 3.0 - wide["c7"]
    wide.iloc[::3, 250] = np.nan
    wide["c300"] = wide["c250"] * 1e-3
    names = list(wide)
    stats = {("mean", c): wide[c].mean() for c in names} | {("std", c): wide[c].std() for c in names}
    found = strong_pairs(Table.of(spark.createDataFrame(wide).repartition(5)), names, stats, 0.95)
    assert sorted((r["j"], r["i"], round(r["r"], 6)) for r in found.collect()) == [(300, 250, 1.0), (499, 7, 1.0)]


def test_pairs_without_common_rows_or_spread(spark):
    rows = [(1.0, None, 1.0), (2.0, None, 1.0), (None, 3.0, 1.0), (None, 4.0, 1.0)]
    cells = correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double")).collect()
    found = {(r["row_column"], r["col_column"]): r["r"] for r in cells}
    assert len(found) == 9 and found["a", "a"] == found["b", "b"] == 1.0
    assert found["a", "b"] is found["b", "a"] is found["c", "c"] is found["a", "c"] is None
    assert correlation_matrix(spark.createDataFrame([("x",)], "t string")).count() == 0


def test_correlation_cut_to_the_first_columns(df):
    assert correlation_matrix(df, first=2).count() == 4


def test_short_and_infinite_columns(spark):
    rows = [(1.0, 1.0, INF), (2.0, None, 1.0), (4.0, None, 2.0)]
    found = {r["column"]: r for r in numeric_stats(spark.createDataFrame(rows, "a double, b double, c double")).collect()}
    assert found["a"]["skewness"] == pytest.approx(pd.Series([1, 2, 4]).skew(), abs=1e-4)
    assert found["a"]["kurtosis"] is None
    assert found["b"]["std"] is None and found["b"]["skewness"] is None
    assert found["c"]["mean"] is None and found["c"]["max"] is None and found["c"]["min"] == 1.0


def test_summary(df, pdf):
    found = dataset_summary(df)
    assert (found["row_count"], found["column_count"]) == pdf.shape
    assert found["columns"] == list(pdf)
    row = summary_frame(df).first()
    assert row["duplicate_row_count"] == found["duplicate_row_count"]
    assert row["total_missing_cells"] == found["total_missing_cells"]
    assert row["missing_cell_pct"] == found["missing_cell_pct"]


def test_no_rows(df):
    none = df.limit(0)
    found = profile(none)
    assert (found["row_count"], found["overall_missing_pct"]) == (0, 0.0)
    assert set(found["missing_map"].values()) == {0.0}
    assert dataset_summary(none)["missing_cell_pct"] == 0.0


def test_missing_tables(df, pdf):
    ordered = [r["column"] for r in missing_map(df).collect()]
    assert ordered[:2] == ["gaps", "word"] and set(ordered) == set(pdf)
    assert [r["status"] for r in top_missing(df).collect()] == ["Warning", "Warning"]
    assert top_missing(df, 1).count() == 1


def test_column_table(spark, stats, pdf):
    rows = column_table(spark, stats).collect()
    assert [r["Column"] for r in rows] == list(pdf)
    assert rows[5]["Mean"] is None


def test_distinct_counts(spark):
    df = spark.createDataFrame(
        [(1, 0.0, "x", [1], None), (1, -0.0, "x", [1], None), (2, float("nan"), None, [2], None)],
        "a int, b double, c string, d array<int>, e string",
    )
    found = {r["column"]: r["unique_count"] for r in distinct_counts(df).collect()}
    assert found == {"a": 2, "b": 1, "c": 1, "d": 2, "e": 0}
    rough = {r["column"]: r["unique_count"] for r in distinct_counts(df, rsd=0.01).collect()}
    assert rough == found


def test_ties_are_broken_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaaccdefg"], "v string").repartition(4)
    assert [r["value"] for r in top_values(df).orderBy("rank").collect()] == list("abcde")
    assert [r["value"] for r in sample_values(df).orderBy("rank").collect()] == list("abc")


def test_top_values_limit_ranks_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("CAST(id % 7 AS STRING) v")
    table = Table.of(df)
    ranked = values._candidates(values.value_counts(table, ["v"]), True, 5)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("lookup", [2, 10_000])
def test_long_texts_rank_as_whole_texts(spark, monkeypatch, lookup):
    """Texts with equal first letters tie until they are looked up, few or many of them."""
    monkeypatch.setattr(values, "LOOKUP", lookup)
    head = "é" * values.HEAD
    texts = [head + str(i) for i in range(40)] * 2 + [head] * 2 + ["short"] * 3 + [head + "7"] + [None, ""]
    df = spark.createDataFrame([(t, i % 3) for i, t in enumerate(texts)], "text string, k int").repartition(4)
    counts = Counter(t for t in texts if t is not None)
    expected = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:6]
    found = top_values(df, ["text"], 6).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in found] == expected and [r["rank"] for r in found] == [1, 2, 3, 4, 5, 6]
    smallest = sample_values(df, ["text"], 4).orderBy("rank").collect()
    assert [r["value"] for r in smallest] == sorted(counts)[:4]
    unique = {r["column"]: r["unique_count"] for r in values.value_summary(df).collect() if r["n"] is None}
    assert unique == {"text": len(counts), "k": 3}
    assert distinct_counts(df, ["text"]).first()["unique_count"] == len(counts)


def test_texts_are_grouped_without_moving_them(spark):
    df = spark.createDataFrame([("long text " * 20, 1)], "text string, k int")
    for frame in values.value_counts(Table.of(df), ["text"]):
        plan = frame._jdf.queryExecution().executedPlan()
        exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.toString())
        assert exchanges and all("digest_1" in x and "text" not in x for x in exchanges)


@pytest.mark.parametrize("bits", [1, 5, 12])
def test_medians_by_narrowing(spark, monkeypatch, bits):
    monkeypatch.setattr(median, "BITS", bits)
    rng = np.random.default_rng(11)
    n = 3000
    pdf = pd.DataFrame(
        {
            "even": rng.normal(size=n),
            "third": np.where(rng.uniform(size=n) < 0.34, 1.0, rng.normal(size=n)),
            "edge": np.repeat([1.0, 2.0], n // 2),
            "tied": rng.integers(0, 3, n).astype("float64"),
            "odd": np.where(np.arange(n) == 0, np.nan, rng.exponential(size=n)),
            "wild": np.where(np.arange(n) % 4 == 0, np.inf, rng.normal(size=n)),
        }
    )
    found = medians(spark.createDataFrame(pdf).repartition(3), list(pdf))
    for name in pdf:
        assert found[name] == pytest.approx(pdf[name].median(), abs=1e-12), name


def test_doubles_keep_their_order_as_integers():
    numbers = [-np.inf, -1e300, -2.0, -1e-300, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.5, 2.0, 1e300, np.inf]
    found = median.ordered(np.array(numbers))
    assert (np.diff(found) > 0).all()
    assert [median.unordered(int(x)) for x in found] == numbers


def test_six_passes_are_enough_for_any_shape(spark, monkeypatch):
    passes, count = [], median.count_ranges
    monkeypatch.setattr(median, "count_ranges", lambda *a: passes.append(1) or count(*a))
    rng = np.random.default_rng(5)
    exponents = rng.uniform(-300, 300, 4001)
    close = 1.0 + np.arange(4001) * 2.0**-52
    pdf = pd.DataFrame(
        {
            "far": 10.0**exponents * np.where(np.arange(4001) % 2 == 0, 1, -1),
            "positive": 10.0**exponents,
            "close": close,
            "both": np.where(np.arange(4001) % 2 == 0, close, 10.0**exponents),
        }
    )
    found = medians(spark.createDataFrame(pdf), list(pdf))
    assert found == {name: np.sort(pdf[name])[2000] for name in pdf}
    assert len(passes) <= 6


def test_sketched_medians_are_near_the_middle(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": rng.exponential(size=20_000), "same": 7.0, "none": None, "some": np.nan}, dtype="float64")
    pdf.loc[:99, "some"] = np.arange(100)
    rows = median_frame(spark.createDataFrame(pdf).repartition(7), accuracy=400).collect()
    found = {r["column"]: r["median"] for r in rows}
    assert found["same"] == 7.0 and found["none"] is None and abs(found["some"] - 49.5) <= 1
    assert abs((pdf["x"] <= found["x"]).mean() - 0.5) < 2.3 / 400
    with pytest.raises(ValueError, match="accuracy"):
        median_frame(spark.createDataFrame(pdf), accuracy=4)


def test_median_without_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert medians(df, ["a", "b"]) == {"a": None, "b": 1.0}


def test_values_are_grouped_and_shuffled_once(spark):
    from tabmeter.operators.values import distinct_counts, top_values, value_summary

    df = spark.range(500).selectExpr("id % 7 a", "CAST(id % 11 AS STRING) b", "CAST(id % 3 AS DOUBLE) c", "id > 9 d")
    rows, frame = value_summary(df).collect(), values._summary(Table.of(df), 5, True)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 3  # one for each family of types
    found = {r["column"]: r["unique_count"] for r in rows if r["rank"] is None}
    assert found == {r["column"]: r["unique_count"] for r in distinct_counts(df).collect()} == {"a": 7, "b": 11, "c": 3, "d": 2}
    tops = sorted((r["column"], r["rank"], r["value"], r["n"]) for r in rows if r["rank"])
    assert tops == sorted((r["column"], r["rank"], r["value"], r["n"]) for r in top_values(df, df.columns).collect())


def test_written_tables_read_the_same(spark):
    from tabmeter import detect_schema, profile

    df = spark.range(60).selectExpr("id AS order_id", "id % 4 AS size", "CAST(id % 3 AS STRING) AS kind", "date'2024-01-01' AS d")
    assert profile(df, materialize=True) == profile(df)
    assert detect_schema(df, materialize=True) == detect_schema(df)
