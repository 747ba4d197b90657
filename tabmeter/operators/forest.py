"""Isolation forest: multivariate outliers (Liu, Ting and Zhou, 2008).

Training needs only a fixed number of rows per tree, so the trees are grown as
one small group each and the model is a bounded array. Which rows train a tree
is decided by a hash of their values and by how many rows share them, so it
depends neither on the order nor on the partitions. Every complete row of the
table is then scored in one pass of Arrow batches. The scores are counted on a
fixed grid, and once more within the step of the grid that the cut falls into.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabmeter.functions.columns import count_true, ref
from tabmeter.plans.staging import staged
from tabmeter.plans.statpass import Probe, run_probes
from tabmeter.table import Table

# Tasks receive these functions themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 100
TREE_ROWS = 256
# Drawn rows beyond what a tree needs, as each row is drawn independently.
OVERDRAW = 1.35
SEED = 42
# Scores lie in (0, 1); the grid bounds what is shuffled and sorted.
SCORE_STEPS = 100_000
# Hashes are read as fractions of this.
FRACTIONS = 1 << 40
# Below these the check is skipped.
MIN_ROWS = 50
MIN_COLUMNS = 2
SKIPPED = "Insufficient data for Isolation Forest"

NODE_SCHEMA = "tree int, node int, feature int, split double, low int, high int, depth double"
RESULT_SCHEMA = "outlier_count bigint, outlier_pct double, sample_size bigint, contamination double"


def mean_path(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 2.0)
    harmonic = np.log(safe - 1.0) + np.euler_gamma
    return np.where(n > 2, 2.0 * harmonic - 2.0 * (n - 1.0) / safe, np.where(n == 2, 1.0, 0.0))


def path_scores(forest: dict, values: np.ndarray) -> np.ndarray:
    """Anomaly score per row of values, from the mean depth over all trees.

    The trees are flat arrays: at node k, values below split[k] go to low[k],
    others to high[k]; a leaf points to itself and holds the depth it stands for.
    """
    feature, split, depth = forest["feature"], forest["split"], forest["depth"]
    # Children side by side, so one look-up finds the next node.
    children = np.stack([forest["low"], forest["high"]], axis=1).ravel()
    flat = np.ascontiguousarray(values).ravel()
    row_starts = np.arange(len(values)) * values.shape[1]
    total = np.zeros(len(values))
    for root in forest["roots"]:
        at = np.full(len(values), root)
        for _ in range(forest["height"]):
            value = flat.take(row_starts + feature.take(at))
            at = children.take(2 * at + (value >= split.take(at)))
        total += depth.take(at)
    return 2.0 ** (-total / len(forest["roots"]) / forest["scale"])


def has_all(columns: list[str]) -> Column:
    """True for a row with no missing value among the columns."""
    return count_true([ref(c).isNull() for c in columns]) == 0


def complete_probe(table: Table) -> Probe:
    return Probe("complete rows", F.count_if(has_all(table.numeric)))


def complete_rows(table: Table, columns: list[str]) -> DataFrame:
    """Rows with no missing value among the columns, as v0, v1, ..."""
    return table.df.where(has_all(columns)).select(
        *[table.number(c).alias(f"v{i}") for i, c in enumerate(columns)]
    )


def fraction(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the values alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(FRACTIONS)) / F.lit(float(FRACTIONS))


def draw(rows: DataFrame, n: int) -> DataFrame:
    """(tree, turn, values...): the rows that train each tree.

    A row is drawn for OVERDRAW * TREE_ROWS / n of all trees, on average. How many
    copies of equal rows are drawn, and for which trees, follows from a hash of
    their values and from their number; the numbers are combined before they are
    shuffled, and the hashes that are drawn are few whatever the table.
    """
    names = rows.columns
    per_row = min(float(TREES), TREES * OVERDRAW * TREE_ROWS / n)
    hashed = rows.withColumn("key", F.xxhash64(*names))
    counted = hashed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    copies = F.floor(F.col("n") * per_row + fraction(F.col("key"))).alias("copies")
    drawn = counted.select("key", copies).where("copies > 0")
    values = hashed.join(F.broadcast(drawn), "key").groupBy("key", "copies")
    first = F.floor(fraction(F.col("key"), F.lit("tree")) * TREES)
    # copy j goes to the j-th tree from the first one on, round and round
    turns = F.sequence(F.lit(0), F.least("copies", F.lit(TREES)).cast("int") - 1)
    dealt = values.agg(*[F.min(c).alias(c) for c in names]).withColumn("j", F.explode(turns))
    times = F.least(F.ceil((F.col("copies") - F.col("j")) / TREES), F.lit(int(OVERDRAW * TREE_ROWS) + 1))
    return (
        dealt.withColumn("tree", F.pmod(first + F.col("j"), F.lit(TREES)).cast("int"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))
        .select("tree", *names, fraction(F.col("key"), F.col("tree"), F.col("copy")).alias("turn"))
    )


def grow_tree(drawn: pd.DataFrame) -> pd.DataFrame:
    """One tree from at most TREE_ROWS of its drawn rows."""
    tree = int(drawn["tree"].iloc[0])
    drawn = drawn.sort_values([*drawn.columns[::-1]]).head(TREE_ROWS)
    values = drawn.drop(columns=["tree", "turn"]).to_numpy("float64")
    values = np.nan_to_num(values, posinf=1e300, neginf=-1e300)
    limit = int(np.ceil(np.log2(max(len(values), 2))))
    random = np.random.default_rng([SEED, tree])
    nodes: list[list] = [[0, np.inf, 0, 0, 0.0]]
    waiting = [(0, values, 0)]
    while waiting:
        node, part, level = waiting.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        choices = np.flatnonzero(high > low)
        if level >= limit or len(part) < 2 or not len(choices):
            nodes[node] = [0, np.inf, node, node, level + float(mean_path(len(part)))]
            continue
        feature = int(random.choice(choices))
        split = random.uniform(low[feature], high[feature])
        below = part[:, feature] < split
        children = (len(nodes), len(nodes) + 1)
        nodes += [[0, np.inf, 0, 0, 0.0], [0, np.inf, 0, 0, 0.0]]
        nodes[node] = [feature, split, *children, 0.0]
        for child, side in zip(children, (below, ~below)):
            if side.any():
                waiting.append((child, part[side], level + 1))
            else:
                nodes[child] = [0, np.inf, child, child, float(level + 1)]
    grown = pd.DataFrame(nodes, columns=["feature", "split", "low", "high", "depth"])
    grown.insert(0, "node", np.arange(len(grown)))
    grown.insert(0, "tree", tree)
    return grown


def train(rows: DataFrame, n: int) -> dict:
    """The forest: at most TREES * (2 * TREE_ROWS - 1) nodes, whatever the table."""
    # A fixed number of tasks: merged by size, all trees would grow in one.
    tasks = min(TREES, rows.sparkSession.sparkContext.defaultParallelism)
    drawn = draw(rows, n).repartition(tasks, "tree")
    grown = drawn.groupBy("tree").applyInPandas(grow_tree, NODE_SCHEMA)
    nodes = grown.toArrow().to_pandas().sort_values(["tree", "node"])
    sizes = nodes.groupby("tree")["node"].size()
    starts = sizes.cumsum() - sizes
    offset = nodes["tree"].map(starts).to_numpy()
    sample = min(n, TREE_ROWS)
    return {
        "feature": nodes["feature"].to_numpy("int64"),
        "split": nodes["split"].to_numpy("float64"),
        "low": nodes["low"].to_numpy("int64") + offset,
        "high": nodes["high"].to_numpy("int64") + offset,
        "depth": nodes["depth"].to_numpy("float64"),
        "roots": starts.to_numpy("int64"),
        "height": int(np.ceil(np.log2(max(sample, 2)))),
        "scale": float(mean_path(sample)),
    }


def score_column(rows: DataFrame, forest: dict) -> Column:
    """Anomaly score of each row: near 1 for outliers, below 0.5 for inliers."""
    model = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def isolation(*values: pd.Series) -> pd.Series:
        return pd.Series(path_scores(model.value, np.column_stack(values)))

    return isolation(*rows.columns)


def cut_count(scored: DataFrame, most: float) -> int:
    """How many of the highest scores count, at most `most`: rows with an equal score
    count together or not at all."""
    score, kept, low, width = F.col("score"), 0, 0.0, 1.0
    for _ in range(2):  # the whole range, then the step in which the limit is crossed
        step = F.floor((score - low) / width * SCORE_STEPS)
        inside = scored.where((score >= low) & (score < low + width))
        grid = inside.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
        # No more rows than the grid has steps, so one task sorts them.
        running = F.sum("n").over(Window.orderBy(F.desc("step"))).alias("running")
        crossed = grid.select("step", "n", running).where(F.col("running") > most - kept)
        over = crossed.orderBy("running").first()
        if over is None:
            return kept + (grid.agg(F.sum("n")).first()[0] or 0)
        kept += over["running"] - over["n"]
        low, width = low + over["step"] * width / SCORE_STEPS, width / SCORE_STEPS
    return kept


def isolation_forest(
    source: DataFrame | Table, contamination: float = 0.05, complete: int | None = None
) -> DataFrame | None:
    """One row (outlier_count, outlier_pct, sample_size, contamination) over the numeric
    columns; None if there is too little data.

    All complete rows are scored, and the most isolated ones count as outliers,
    up to the expected share. `complete` is their number, where it is known.
    """
    table = Table.of(source)
    columns = table.numeric
    if len(columns) < MIN_COLUMNS:
        return None
    n = complete
    if n is None:
        n = int(run_probes(table.df, [complete_probe(table)])["complete rows"])
    if n < MIN_ROWS:
        return None
    rows = complete_rows(table, columns)
    forest = train(rows, n)
    cores = table.spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # scoring costs far more than moving a row
        rows = rows.repartition(cores)
    with staged(rows.select(score_column(rows, forest).alias("score"))) as scored:
        found = cut_count(scored, contamination * n)
    result = (found, round(found * 100 / n, 2), n, float(contamination))
    return table.spark.createDataFrame([result], RESULT_SCHEMA)


def scored_rows(source: DataFrame | Table) -> DataFrame:
    """The table's complete numeric rows with their anomaly score."""
    table = Table.of(source)
    columns = table.numeric
    rows = complete_rows(table, columns)
    forest = train(rows, rows.count())
    return rows.withColumn("score", score_column(rows, forest)).toDF(*columns, "score")
