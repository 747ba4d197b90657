import pytest
from pyspark.sql import functions as F

from tabmeter.operators.forest import OVERDRAW, TREE_ROWS, TREES, cut_count, draw, isolation_forest, scored_rows


def table(spark, rows, copies=0):
    """Points of a square, a few far away, and `copies` equal rows."""
    near = spark.range(rows).selectExpr("sin(id * 1.3) AS x", "cos(id * id) AS y", "id % 11 * 0.1D AS z")
    far = spark.range(rows // 100).selectExpr("id + 30D AS x", "-40D - id AS y", "5D AS z")
    return near.unionAll(far).unionAll(spark.range(copies).selectExpr("0.5D AS x", "0.5D AS y", "0.5D AS z"))


@pytest.mark.parametrize("rows, copies", [(120, 0), (6000, 0), (4000, 3000)])
def test_partitions_change_nothing(spark, rows, copies):
    found = []
    for partitions in (1, 3, 8):
        frame = table(spark, rows, copies).repartition(partitions)
        scores = scored_rows(frame).agg(F.sum(F.round("score", 9)), F.max("score"), F.min("score")).first()
        found.append((isolation_forest(frame).first(), round(scores[0], 3), *scores[1:]))
    assert found[0] == found[1] == found[2]


def test_far_rows_are_the_most_isolated(spark):
    scored = scored_rows(table(spark, 5000)).orderBy(F.desc("score")).limit(50).collect()
    assert all(row["x"] >= 30 for row in scored)
    assert isolation_forest(table(spark, 5000), contamination=0.01).first()["outlier_count"] == 50


def test_draws_follow_the_number_of_rows(spark):
    frame = table(spark, 20_000, copies=10_000).toDF("v0", "v1", "v2")
    n = frame.count()
    drawn = draw(frame, n).toPandas()
    expected = TREES * OVERDRAW * TREE_ROWS
    assert abs(len(drawn) / expected - 1) < 0.05
    assert drawn.groupby("tree").size().between(250, 450).all() and drawn["tree"].nunique() == TREES
    share = ((drawn[["v0", "v1", "v2"]] == 0.5).all(axis=1)).mean()
    assert abs(share - 10_000 / n) < 0.02


@pytest.mark.parametrize("most, found", [(0.5, 0), (1, 1), (3, 1), (4, 4), (5, 5), (9.9, 5), (10, 10), (99, 10)])
def test_the_cut_is_exact_and_keeps_ties_together(spark, most, found):
    scores = [0.9, 0.8, 0.8, 0.8, 0.8 - 1e-8, *[0.3] * 5]
    assert cut_count(spark.createDataFrame([(s,) for s in scores], "score double"), most) == found
