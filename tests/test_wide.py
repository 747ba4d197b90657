"""Tables with more columns than one expression tree can hold."""

from tabmeter import check_completeness
from tabmeter.operators.completeness import bad_rows

WIDTH = 2000


def wide(spark, every=0):
    """Text columns; of each row one value in `every` is missing."""
    names = [f"c{i}" for i in range(WIDTH)]
    if every:
        exprs = [f"IF((id + {i}) % {every} = 0, NULL, 'v') AS {c}" for i, c in enumerate(names)]
    else:
        exprs = [f"'v' AS {c}" for c in names]
    return spark.range(4).selectExpr(*exprs)


def test_bad_rows_of_a_wide_table(spark):
    assert tuple(bad_rows(wide(spark)).first()) == (4, 0, 0.0)
    gaps = wide(spark).selectExpr(*[f"IF({i} < 1001, NULL, c{i}) AS c{i}" for i in range(WIDTH)])
    assert tuple(bad_rows(gaps).first()) == (4, 4, 100.0)


def test_completeness_of_a_wide_table(spark):
    assert check_completeness(wide(spark)).score == 100.0
    assert check_completeness(wide(spark, every=4)).score == 75.0


def test_gaps_of_a_wide_row_are_counted_in_compiled_code(spark, capsys):
    """101 fields: 50, 51 and 52 gaps; a lambda would be interpreted field by field."""
    names = [f"c{i}" for i in range(97)] + ["a.`b", "${user.dir}", "$", "nan"]
    rows = spark.range(50, 53).selectExpr(
        *[f"IF({i} < id - 1, NULL, 'v') AS `{c.replace('`', '``')}`" for i, c in enumerate(names[:-1])],
        "double('nan') AS nan",
    )
    rows = rows.toDF(*names)
    assert rows.columns == names
    found = bad_rows(rows)
    assert tuple(found.first()) == (3, 2, 66.67)
    assert check_completeness(rows).details["bad_row_count"] == 2
    found.explain()
    assert "lambda" not in capsys.readouterr().out
