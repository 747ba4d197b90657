"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tabmeter.llm import bisector, chat, covertree, debruijn, licenses, linecrf, packing, preference, simhash, sql, substrings, unigram, vectorcodes, wordbpe

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str, run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return preference.quality_scores(docs, labels)


QUERIES: dict[str, Query] = {
    "op1_chat": _table("conversations", chat.chat_report),
    "op3_covertree": _table("embeddings", covertree.linked_vectors),
    "op2_packing": _table("documents", packing.packing_report),
    "op4_preference": _preference,
    "op5_wordbpe": _table("documents", wordbpe.encoding_report),
    "op6_suffix_array": _table("documents", substrings.removal_report),
    "op8_line_crf": _table("documents", linecrf.quality_rules),
    "op7_simhash": _table("documents", simhash.near_duplicates),
    "op9_licenses": _table("documents", licenses.scan_licenses),
    "op10_unigram": _table("documents", unigram.predict_languages),
    "op11_vector_codes": _table("embeddings", vectorcodes.compression_report),
    "op12_bisector": _table("embeddings", bisector.cluster_vectors),
    "op13_debruijn": _table("documents", debruijn.removal_report),
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op1_chat": sql.CHAT, "op3_covertree": sql.VECTORS} | {
    "op11_vector_codes": sql.CODED,
    "op12_bisector": sql.CLUSTERED,
    "op13_debruijn": sql.PASSAGES,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
