"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabmeter.llm.common import Staged

MAX_ROUNDS = 60


def connected_components(links: DataFrame, staged: Staged) -> DataFrame:
    """(node, component) of every node in `links` (a, b) that can reach a smaller one, with
    the smallest it can reach.

    Each round points the neighbours of a node at the smallest of them, first the larger
    neighbours, then the smaller ones, which keeps reachability and halves paths; it ends
    when a round changes nothing. Only links are shuffled, the smallest neighbour is
    combined before the shuffle, and every round is written to the shared folder, so a
    lost executor costs one round. Null ends and loops are ignored. Empty links give an
    empty result.
    """
    edges = staged.write(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        # larger neighbours of a node move to its smallest neighbour
        large = (
            edges.select(F.col("b").alias("node"), F.col("a").alias("far"))
            .join(low, "node")
            .select(F.col("far").alias("a"), F.col("m").alias("b"))
            .unionAll(low.where("m < node").select(F.col("node").alias("a"), F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        # smaller neighbours, and the node itself, move to the smallest of them
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(floor, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(floor.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = staged.write(small, "round")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        staged.drop(edges)
        edges = after
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
    raise RuntimeError(f"the components did not settle in {MAX_ROUNDS} rounds")
