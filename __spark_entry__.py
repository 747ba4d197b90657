
from __future__ import annotations

import atexit
import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabmeter import (
    classify_columns,
    column_table,
    issue_frame,
    load_table,
    pillar_frame,
    profile,
    recommendation_frame,
    score,
    score_table,
    write_csv,
)
from tabmeter.config import DEFAULT_SCORING
from tabmeter.operators.ai_readiness import class_balance, class_counts, correlated_pairs, feature_spread
from tabmeter.operators.accuracy import zscore_outliers
from tabmeter.operators.completeness import bad_rows, column_nulls
from tabmeter.operators.consistency import rule_violations
from tabmeter.operators.correlation import correlation_matrix
from tabmeter.operators.duplicates import duplicate_count, duplicate_rows
from tabmeter.operators.forest import isolation_forest, scored_rows
from tabmeter.operators.median import median_frame
from tabmeter.operators.profile import (
    dataset_summary,
    missing_map,
    numeric_stats,
    summary_frame,
    top_missing,
    type_counts,
)
from tabmeter.operators.timeliness import date_ranges, day_gaps, max_gaps
from tabmeter.operators.validity import (
    enum_samples,
    enum_violations,
    id_nulls,
    parse_failure_counts,
    range_violations,
)
from tabmeter.operators.values import distinct_counts, sample_values, top_values
from tabmeter.plans.staging import remove, scratch_folder, staged
from tabmeter.plans.report import write_result
from tabmeter.plans.scoring import check

SMOKE_DIR = "/root/testdata/sf0.001"

# Line items with their orders, and defects planted by fixed expressions that
# read the same in both dialects.
DQ_COLUMNS = {
    "order_id": "CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_orderkey END",
    "customer_id": "o_custkey",
    "quantity": "CASE WHEN l_partkey % 97 = 0 THEN -l_quantity ELSE l_quantity END",
    "sales": "CASE WHEN l_partkey % 4 = 1 THEN NULL ELSE l_extendedprice END",
    "discount_rate": "CASE WHEN l_suppkey % 13 = 0 THEN l_discount + 1.5 ELSE l_discount END",
    "ship_mode": "CASE WHEN l_partkey % 25 = 1 THEN ' Express ' ELSE l_returnflag END",
    "order_date_txt": (
        "CASE WHEN l_orderkey % 33 = 0 THEN 'not a date' "
        "ELSE CAST(CAST(o_orderdate AS DATE) AS {text}) END"
    ),
    "order_date": "o_orderdate",
    "ship_date": "l_shipdate",
    "late_risk": "CASE WHEN l_shipdate >= o_orderdate THEN 0 ELSE 1 END",
    "delivery_status": "o_orderstatus",
}

DQ_RULES = {
    "dataset": {"expected_date_range": {"start": "1993-01-01", "end": "2030-12-31"}},
    "columns": {
        "numeric_ranges": [
            {"column": "quantity", "min": 1, "max": 50},
            {"column": "discount_rate", "min": 0.0, "max": 1.0},
            {"column": "sales", "min": 0.0},
            {"column": "absent", "min": 0},
        ],
        "categorical_enums": [
            {"column": "ship_mode", "allowed_values": ["A", "N", "R"]},
            {"column": "delivery_status", "allowed_values": ["F", "O", "P"]},
            {"column": "late_risk", "allowed_values": [0, 1]},
        ],
        "datetime_columns": ["order_date_txt", "order_date", "ship_date"],
        "required_id_columns": ["order_id", "customer_id"],
        "known_sparse_columns": [],
    },
    "consistency_rules": [
        {
            "name": "shipping_after_order",
            "description": "Nothing leaves before it is ordered",
            "left_column": "ship_date",
            "right_column": "order_date",
            "operator": ">=",
        },
        {"name": "shipping_days_match", "tolerance_days": 2},
        {
            "name": "late_delivery_risk_vs_status",
            "description": "Late rows should be finished orders",
            "risk_column": "late_risk",
            "status_column": "delivery_status",
            "risk_value": 1,
            "expected_status": "F",
        },
    ],
    "ai_readiness": {
        "target_column": "late_risk",
        "id_columns": ["order_id", "customer_id"],
        "leakage_risk_columns": ["delivery_status"],
    },
}



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dq(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return joined.selectExpr(
        *[f"{expr.format(text='STRING')} AS {name}" for name, expr in DQ_COLUMNS.items()]
    )


def entry(spark: SparkSession) -> DataFrame:
    """The scorecard of the line items with planted defects."""
    return _scorecard(spark, SMOKE_DIR)


def _score(spark: SparkSession, sf_dir: str):
    return score(dq(spark, sf_dir), DEFAULT_SCORING, DQ_RULES, materialize=True)


def _scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pillar_frame(spark, _score(spark, sf_dir)).drop("issues")


def _band(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _score(spark, sf_dir)
    row = (found.overall_score, found.band, found.band_label, found.band_color)
    schema = "overall_score double, band string, band_label string, band_color string"
    return spark.createDataFrame([row], schema)


# Pillars that read the joined table more than twice get it written once.
MANY_PASSES = ("accuracy", "ai_readiness")


def _pillar(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, stage = dq(spark, sf_dir), name in MANY_PASSES
        found = check(name, source, DQ_RULES, materialize=stage)
        return found.to_frame(spark, name).select(
            "pillar", "score", "passed_checks", "total_checks", F.size("issues").alias("issue_count")
        )

    return run


def _auto_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeliness without configured columns: dates are found by type, name and content."""
    unnamed = DQ_RULES | {"columns": {k: v for k, v in DQ_RULES["columns"].items() if k != "datetime_columns"}}
    found = check("timeliness", dq(spark, sf_dir), unnamed)
    return found.to_frame(spark, "timeliness").select(
        "pillar", "score", "passed_checks", "total_checks", F.size("issues").alias("issue_count")
    )


def _events_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zscore_outliers(table(spark, sf_dir, "events"))


def _duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dq(spark, sf_dir)
    found = duplicate_count(rows)
    return spark.createDataFrame([(found,)], "duplicate_rows bigint")


def _scratch_file(spark: SparkSession, name: str) -> str:
    """A new file in the shared folder, deleted when the session's program ends."""
    path = f"{scratch_folder(spark).rstrip('/')}/{uuid.uuid4().hex}-{name}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch_file(spark, "orders.csv")
    source = table(spark, sf_dir, "orders").withColumn(
        "note", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE o_orderpriority END")
    )
    write_csv(source, path)
    return load_table(spark, path).withColumn("o_orderdate", F.to_date("o_orderdate").cast("string"))


# Cells with quotes and line breaks, by a fixed rule.
NOTE = """CASE WHEN c_custkey % 7 = 0 THEN concat('say "', c_name, '"', chr(10), 'twice, or more')
    WHEN c_custkey % 11 = 0 THEN concat(chr(10), c_name, ',"') ELSE c_name END"""


def _csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch_file(spark, "notes.csv")
    write_csv(table(spark, sf_dir, "customer").select("c_custkey", F.expr(NOTE).alias("note"), "c_mktsegment"), path)
    return load_table(spark, path)


def _json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch_file(spark, "events.json")
    source = table(spark, sf_dir, "events")
    source.write.option("ignoreNullFields", False).json(path)
    when = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    return load_table(spark, path).select(*source.columns).withColumn("ts", when)


def _preview_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch_file(spark, "customer.csv")
    write_csv(table(spark, sf_dir, "customer"), path)
    return load_table(spark, path, nrows=7).agg(F.count(F.lit(1)).alias("n"))


def _parquet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, f"{sf_dir}/supplier.parquet")


# More columns than Spark generates code for, missing by a fixed rule.
WIDE_COLUMNS = 1500


def _wide_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # i and i % 11 leave the same remainder, so 11 rules make all the columns.
    rules = [f"CASE WHEN (l_partkey * {i}) % 11 >= 5 THEN l_suppkey END AS r{i}" for i in range(11)]
    wide = [f"r{i % 11} AS c{i}" for i in range(1, WIDE_COLUMNS + 1)]
    return bad_rows(table(spark, sf_dir, "lineitem").selectExpr(*rules).selectExpr(*wide))


# Forms in which dates come as text.
DATE_FORMS = {
    "slashes": "M/d/yyyy",
    "slashes_minutes": "M/d/yyyy H:mm",
    "slashes_seconds": "M/d/yyyy H:mm:ss",
    "year_first": "yyyy/M/d",
    "iso": "yyyy-MM-dd",
    "month_name": "d-MMM-yyyy",
    "digits": "yyyyMMdd",
    "month_word": "d MMM yyyy",
    "month_first": "MMM d, yyyy",
    "dots": "d.M.yyyy",
    "half_days": "M/d/yyyy h:mm a",
    "year_first_minutes": "yyyy/M/d H:mm",
    "short_year": "M/d/yy",
}


def _slash_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    texts = orders.select(*[F.date_format("o_orderdate", form).alias(name) for name, form in DATE_FORMS.items()])
    return date_ranges(texts, list(DATE_FORMS)).select(
        "column",
        F.col("min_date").cast("string").alias("min_date"),
        F.col("max_date").cast("string").alias("max_date"),
        "date_range_days",
    )


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [
        classify_columns(table(spark, sf_dir, name)).select(
            F.lit(name).alias("table_name"),
            "column",
            "semantic_type",
            "null_count",
            "unique_count",
            "cardinality_ratio",
        )
        for name in ("orders", "events", "documents", "labels")
    ]
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return found


def _correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = dq(spark, sf_dir).withColumn("revenue", F.col("sales") * 1.0001)
    return correlated_pairs(copies, DQ_RULES)


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(42.0))
    return feature_spread(items.withColumn("rare", F.expr("CAST(l_orderkey % 5000 = 0 AS DOUBLE)")))


def _planted_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows far out in several columns, and how many of them are not among the 5 % most isolated."""
    far = {"l_quantity": 1000, "l_extendedprice": 1000000, "l_discount": 50, "l_tax": 50}
    planted = F.col("l_orderkey") % 997 == 0
    items = table(spark, sf_dir, "lineitem").withColumns(
        {name: F.when(planted, F.col(name) + by).otherwise(F.col(name)) for name, by in far.items()}
    )
    with staged(scored_rows(items.select("l_orderkey", *far, "l_linenumber"))) as scored:
        cut = scored.agg(F.percentile_approx("score", 0.95, 10000)).first()[0]
        found = scored.agg(
            F.count_if(planted).alias("planted"),
            F.count_if(planted & (F.col("score") < cut)).alias("missed"),
            F.count(F.lit(1)).alias("sample_size"),
        ).first()
    return spark.createDataFrame([tuple(found)], "planted bigint, missed bigint, sample_size bigint")


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation_forest(table(spark, sf_dir, "lineitem"))


def _complete_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest leaves out rows with a missing value; its share is within the expected one."""
    gaps = {
        "l_quantity": F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")),
        "l_tax": F.when(F.col("l_suppkey") % 7 != 0, F.col("l_tax")),
    }
    found = isolation_forest(table(spark, sf_dir, "lineitem").withColumns(gaps))
    share = F.col("outlier_count") / F.col("sample_size")
    return found.select("sample_size", "contamination", share.between(0.04, 0.05).alias("within"))


def _table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("labels", "documents", "events"):
        source = table(spark, sf_dir, name)
        size, kinds = dataset_summary(source), type_counts(source)
        rows.append((name, size["row_count"], size["column_count"], size["memory_usage_mb"], *kinds.values()))
    names = "numeric_columns bigint, text_columns bigint, date_columns bigint"
    return spark.createDataFrame(
        rows, f"table_name string, row_count bigint, column_count bigint, size_mb double, {names}"
    )


def _leading_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading 20 of 24 numeric columns."""
    from oracles import wave

    waves = [F.expr(wave(k)).alias(f"c{k}") for k in range(24)]
    found = correlation_matrix(table(spark, sf_dir, "lineitem").select(*waves), first=20)
    return found.select("row_column", "col_column", "r")


def _result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read back from the JSON record of a result."""
    path = _scratch_file(spark, "result.json")
    write_result(spark, _score(spark, sf_dir), path)
    fields = "score double, passed_checks int, total_checks int"
    record = F.from_json("value", f"overall_score double, pillars map<string, struct<{fields}>>").alias("record")
    read = spark.read.text(path, wholetext=True).select(record).select("record.*")
    return read.select("overall_score", F.explode("pillars").alias("pillar", "found")).select(
        "overall_score", "pillar", "found.*"
    )


def _whole_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_violations(
        dq(spark, sf_dir).withColumnRenamed("discount_rate", "discount rate"), DQ_RULES
    )


SKETCH = 400  # what a quantile sketch remembers; ranks are off by 2.3 / SKETCH at most


def _median_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ranks of sketched medians are as near the middle as promised."""
    items = table(spark, sf_dir, "lineitem")
    found = {r["column"]: r["median"] for r in median_frame(items, accuracy=SKETCH).collect()}
    rows = []
    for name, middle in found.items():
        value, n = F.col(name).cast("double"), F.count(name)
        room = n * (2.3 / SKETCH)
        near = (F.count_if(value < middle) <= n / 2 + room) & (F.count_if(value <= middle) >= n / 2 - room)
        rows.append(F.struct(F.lit(name).alias("column"), n.alias("n"), near.alias("near")))
    return items.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _text_summary(frame: DataFrame) -> DataFrame:
    return frame.select("column", F.col("rank").cast("bigint").alias("rank"), "value", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "column_nulls": lambda s, d: column_nulls(dq(s, d)).drop("ordinal"),
    "bad_rows": lambda s, d: bad_rows(dq(s, d)),
    "wide_bad_rows": _wide_bad_rows,
    "completeness_score": _pillar("completeness"),
    "numeric_profile": lambda s, d: numeric_stats(table(s, d, "lineitem")).drop(
        "skewness", "kurtosis"
    ),
    "median_profile": lambda s, d: median_frame(table(s, d, "lineitem")),
    "median_sketches": _median_sketches,
    "skew_kurtosis": lambda s, d: numeric_stats(table(s, d, "events")).select(
        "column", (F.col("skewness") + 0.0).alias("skewness"), (F.col("kurtosis") + 0.0).alias("kurtosis")
    ),
    "correlation_matrix": lambda s, d: correlation_matrix(table(s, d, "lineitem")).select(
        "row_column", "col_column", "r"
    ),
    "correlated_pairs": _correlated,
    "distinct_counts": lambda s, d: distinct_counts(table(s, d, "orders"))
    .unionAll(distinct_counts(table(s, d, "documents")))
    .drop("ordinal"),
    "top_values": lambda s, d: _text_summary(
        top_values(table(s, d, "events"), ["event_type", "ts", "props"])
    ).unionAll(_text_summary(top_values(table(s, d, "documents"), ["text", "lang", "source"]))),
    "sample_values": lambda s, d: _text_summary(
        sample_values(table(s, d, "orders"), table(s, d, "orders").columns)
    ),
    "missing_map": lambda s, d: missing_map(dq(s, d)).drop("ordinal"),
    "top_missing": lambda s, d: top_missing(dq(s, d)),
    "duplicate_rows": lambda s, d: duplicate_rows(
        table(s, d, "events").select("user_id", "event_type")
    ),
    "duplicate_count": _duplicate_count,
    "id_nulls": lambda s, d: id_nulls(dq(s, d), DQ_RULES),
    "uniqueness_score": _pillar("uniqueness"),
    "range_violations": lambda s, d: range_violations(dq(s, d), DQ_RULES),
    "enum_violations": lambda s, d: enum_violations(dq(s, d), DQ_RULES),
    "enum_samples": lambda s, d: enum_samples(dq(s, d), DQ_RULES),
    "datetime_parse_failures": lambda s, d: parse_failure_counts(dq(s, d), DQ_RULES),
    "validity_score": _pillar("validity"),
    "rule_violations": _whole_rate,
    "consistency_score": _pillar("consistency"),
    "date_window": lambda s, d: date_ranges(
        dq(s, d), ["order_date_txt", "order_date", "ship_date"]
    ).select(
        "column",
        F.col("min_date").cast("string").alias("min_date"),
        F.col("max_date").cast("string").alias("max_date"),
        "date_range_days",
    ),
    "slash_dates": _slash_dates,
    "date_gaps": lambda s, d: max_gaps(dq(s, d), ["order_date_txt", "order_date", "ship_date"]),
    "day_gaps": lambda s, d: day_gaps(table(s, d, "events"), ["ts"]).select(
        "column", F.col("day").cast("string").alias("day"), "gap_days"
    ),
    "timeliness_score": _pillar("timeliness"),
    "auto_dates_score": _auto_dates,
    "zscore_outliers": _events_zscores,
    "zscore_outliers_dq": lambda s, d: zscore_outliers(dq(s, d), DQ_RULES),
    "accuracy_score": _pillar("accuracy"),
    "isolation_forest": _forest,
    "planted_outliers": _planted_outliers,
    "forest_of_complete_rows": _complete_forest,
    "table_sizes": _table_sizes,
    "leading_matrix": _leading_matrix,
    "result_file": _result_file,
    "feature_spread": _spread,
    "class_counts": lambda s, d: class_counts(table(s, d, "labels"), "toxic"),
    "many_classes": lambda s, d: class_counts(table(s, d, "lineitem"), "l_partkey"),
    "class_balance": lambda s, d: class_balance(table(s, d, "labels"), "toxic"),
    "ai_readiness_score": _pillar("ai_readiness"),
    "classify_columns": _classified,
    "dataset_summary": lambda s, d: summary_frame(dq(s, d)),
    "column_table": lambda s, d: column_table(s, profile(table(s, d, "events"))),
    "scorecard": _scorecard,
    "score_table": lambda s, d: score_table(s, _score(s, d)),
    "quality_band": _band,
    "issues": lambda s, d: issue_frame(s, _score(s, d)),
    "recommendations": lambda s, d: recommendation_frame(s, _score(s, d)),
    "csv_round_trip": _csv_round_trip,
    "csv_line_breaks": _csv_line_breaks,
    "json_round_trip": _json_round_trip,
    "preview_count": _preview_count,
    "parquet_table": _parquet_table,
}


def _llm():
    """The queries of the training-data subpackage, or None where it can't be imported."""
    try:
        from tabmeter.llm import queries as llm_queries
    except ImportError:
        return None
    return llm_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    llm = _llm()
    return dict(QUERIES) | (llm.QUERIES if llm else {})


def oracle_sql() -> dict[str, str]:
    from oracles import oracles

    llm = _llm()
    own = oracles(DQ_COLUMNS) | {"csv_line_breaks": f"SELECT c_custkey, {NOTE} AS note, c_mktsegment FROM customer"}
    return own | (llm.ORACLES if llm else {})
