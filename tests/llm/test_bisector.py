import hashlib

import numpy as np
from pyspark.sql import functions as F

from llm_cases import CLASHES
from tabmeter.llm import bisector
from vector_cases import VECTORS, floored, gap, moved, odd_vectors, spread

WIDTH = bisector.DIMENSIONS


def nearest(vector, centroids):
    return min(range(len(centroids)), key=lambda i: (gap(vector, centroids[i]), i))


def by_hand(rows, clusters, rounds):
    ints = [(vec_id, floored(v, bisector.SCALE)) for vec_id, v in rows]
    named = [(hashlib.sha256(f"{bisector.SEED}:{i}".encode()).hexdigest(), v) for i, v in ints if i is not None]
    start = sorted(named) + sorted(("~", v) for i, v in ints if i is None)
    centroids = [v for _, v in start[:clusters]]
    vectors = [v for _, v in ints]
    for _ in range(rounds):
        centroids = moved(centroids, vectors, [nearest(v, centroids) for v in vectors])
    found = [(i, nearest(v, centroids), gap(v, centroids[nearest(v, centroids)])) for i, v in ints]
    inertia = {c: sum(d for _, own, d in found if own == c) for _, c, _ in found}
    texts = [",".join(map(str, c)) for c in centroids]
    return sorted(
        (str(i), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(texts[c].encode()).hexdigest())
        for i, c, d in found
    )


def rows_of(frame):
    return sorted((str(r[0]), *r[1:]) for r in frame.collect())


def test_tournaments_find_the_nearest_and_ties_go_to_the_smaller_number():
    draw = np.random.default_rng(5)
    for k in (1, 2, 3, 7, 8):
        centroids = draw.integers(-2, 3, (k, 3))
        centroids[k // 2] = centroids[0]  # equal centroids: the first has all
        vectors = draw.integers(-2, 3, (300, 3))
        expected = [nearest(v.tolist(), centroids.tolist()) for v in vectors]
        assert bisector.Bisectors(centroids).winners(vectors).tolist() == expected


def test_matches_rounds_worked_out_by_hand(spark):
    rows = [(i, v, i % 3) for i, v in enumerate(spread(120, WIDTH, 1))]
    rows += [(7, spread(1, WIDTH, 2)[0], 0), (7, spread(1, WIDTH, 2)[0], 0), (None, spread(1, WIDTH, 3)[0], 0)]
    table = spark.createDataFrame(rows + odd_vectors(WIDTH), VECTORS).repartition(5)
    table = table.withColumns({name: F.lit("extra") for name in (*CLASHES, "ints", "entry", "cluster", "distance")})
    expected = by_hand([r[:2] for r in rows], 8, bisector.ROUNDS)
    found = bisector.cluster_vectors(table)
    assert rows_of(found) == expected
    assert found.columns == [x.split()[0] for x in bisector.RESULT.split(", ")]


def test_early_rounds_are_rounds_too(spark):
    rows = [(i, v, 0) for i, v in enumerate(spread(60, WIDTH, 4))]
    for rounds in (0, 1, 2):
        found = bisector.cluster_vectors(spark.createDataFrame(rows, VECTORS), rounds=rounds)
        assert rows_of(found) == by_hand([r[:2] for r in rows], 8, rounds)


def test_copies_of_one_vector_are_one_cluster(spark):
    rows = [(i, [-0.3] * WIDTH, 0) for i in range(50)]
    found = bisector.cluster_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in found} == {(0, 0, 0)}
    digest = hashlib.sha256(",".join(["-308"] * WIDTH).encode()).hexdigest()
    assert {r["centroid_sha256"] for r in found} == {digest}


def test_fewer_rows_than_clusters_and_none(spark):
    rows = [(i, v, 0) for i, v in enumerate(spread(3, WIDTH, 6))]
    found = bisector.cluster_vectors(spark.createDataFrame(rows, VECTORS))
    assert rows_of(found) == by_hand([r[:2] for r in rows], 3, bisector.ROUNDS)
    for empty in ([], odd_vectors(WIDTH)):
        none = bisector.cluster_vectors(spark.createDataFrame(empty, VECTORS))
        assert none.collect() == [] and len(none.columns) == 6


def test_inertia_beyond_a_long_is_null(spark):
    far = [(i, [60000.0 * (-1) ** i] * WIDTH, 0) for i in range(400)]
    found = bisector.cluster_vectors(spark.createDataFrame(far, VECTORS), clusters=1).collect()
    assert {r["inertia"] for r in found} == {None} and {r["distance"] for r in found} == {64 * 61440000**2}
