"""The registered queries on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF_DIR = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def test_one_query_for_each_operator_and_the_pipeline():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op1_chat", "op3_covertree", "op11_vector_codes", "op12_bisector", "op13_debruijn"])
def test_query_matches_its_oracle(spark, name):
    assert compare(spark, duck(SF_DIR), name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


@pytest.mark.parametrize("number", [2, 4, 5, 6, 7, 8, 9, 10])
def test_query_covers_every_document(spark, number):
    name = next(n for n in entry.queries() if n.startswith(f"op{number}_"))
    found = entry.queries()[name](spark, SF_DIR)
    docs = entry.table(spark, SF_DIR, "documents")
    ids = found.select("doc_id").distinct()
    assert ids.count() == docs.count() and docs.join(ids, "doc_id", "left_anti").count() == 0
