import pytest
from pyspark.sql import functions as F

from llm_cases import CLASHES, ODD, SCHEMA, prose


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls everywhere, empty, blank and very long texts, repeats, and extra columns."""
    rows = ODD + [(100 + i, prose(i, 60), "en", f"s{i % 3}", None) for i in range(12)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame.withColumns({name: F.lit("extra") for name in CLASHES})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
