from collections import Counter, defaultdict

import numpy as np
import pytest

from tabmeter.llm import covertree

NAN, INF = float("nan"), float("inf")
ODD = [
    (1, None, 1), (2, [0.0] * 4, 1), (3, [NAN, 1.0, 1.0, 1.0], 1), (4, [None, 1.0, 1.0, 1.0], 1), (5, [1.0] * 3, 1),
    (6, [2.0] * 3, 1), (7, [1.0] * 4, None), (None, [1.0] * 4, 1), (8, [1.0] * 4, 1), (9, [1.0] * 4, 1), (9, [1.0] * 4, 1),
    (10, [], 1), (11, [1e-30] * 3, 1), (12, [3e38] * 3, 1), (13, [INF, 1.0, 1.0, 1.0], 1), (14, [1.0] * 4, 2), (15, [-1.0] * 4, 1),
]


def brute(rows, cosine=0.93):
    groups = defaultdict(list)
    for i, (vec, value, label) in enumerate(rows):
        values = np.array([NAN if x is None else x for x in value or []], float)
        if vec is not None and label is not None and len(values) and np.isfinite(values).all() and values.any():
            values = values / np.abs(values).max()
            groups[label, len(values)].append((i, values / np.linalg.norm(values)))
    near, low = defaultdict(set), {i: i for i in range(len(rows))}
    for own in groups.values():
        units = np.array([u for _, u in own])
        for a, b in zip(*np.nonzero(units @ units.T >= cosine), strict=True):
            if a != b:
                near[own[a][0]].add(own[b][0])
    ids, todo = {i: r[0] for i, r in enumerate(rows)}, True
    low = dict(ids)
    while todo:
        todo = False
        for i, others in near.items():
            least = min(low[j] for j in others)
            if least < low[i]:
                low[i], todo = least, True
    return Counter((ids[i], len(near[i]), low[i], ids[i] == low[i]) for i in range(len(rows)))


def run(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    return Counter(map(tuple, covertree.linked_vectors(frame.selectExpr("*", "1 AS kind", "2 AS size", "3 AS unit")).collect()))


def test_odd_rows(spark):
    assert run(spark, ODD) == brute(ODD)
    assert run(spark, []) == Counter()


@pytest.mark.parametrize("cell, pivots", [(4096, 4096), (40, 300), (40, 8)])
def test_clusters_chains_and_a_crowd(spark, monkeypatch, cell, pivots):
    """One cell a label; many cells and small balls; blocks without pivots."""
    monkeypatch.setattr(covertree, "CELL", cell)
    monkeypatch.setattr(covertree, "BLOCK", cell)
    monkeypatch.setattr(covertree, "PIVOTS", pivots)
    draw = np.random.default_rng(4)
    rows, crowd = [], draw.normal(size=12)
    for i in range(260):
        centre = draw.normal(size=12)
        if i % 3 == 0:  # a third of all are near one vector
            value = crowd + draw.normal(size=12) * 0.08
        elif i % 7 == 0 and rows:  # chains of near copies
            value = np.array(rows[-1][1]) + draw.normal(size=12) * 0.12
        else:
            value = centre
        rows.append((1000 - i, np.float32(value).tolist(), i % 2 if i % 3 else 0))
    rows += [(2000 + i, rows[0][1], 0) for i in range(30)]
    assert run(spark, rows) == brute(rows)


def test_trees_cover_and_nets_are_apart():
    draw = np.random.default_rng(5)
    vectors = np.concatenate([draw.normal(size=(60, 5)), np.repeat(draw.normal(size=(1, 5)), 9, axis=0)])
    vectors += 0.01 * draw.normal(size=vectors.shape)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)

    def check(nodes, level, some):
        assert sorted(i for n in nodes for i in n.members.tolist()) == sorted(some.tolist())
        for n in nodes:
            gaps = covertree.distances(vectors[n.members] @ vectors[n.centre])
            assert gaps.max() <= n.radius + 1e-6
            if level < len(covertree.RADII):
                assert gaps.max() <= covertree.RADII[level] + 1e-6
            if n.children:
                check(n.children, level + 1, n.members)
        if level < len(covertree.RADII):
            centres = vectors[[n.centre for n in nodes]]
            apart = covertree.distances(centres @ centres.T) + 9 * np.eye(len(nodes))
            assert apart.min() >= covertree.RADII[level] - 1e-6

    check(covertree.grow(vectors, np.arange(len(vectors))), 0, np.arange(len(vectors)))


def test_walk_finds_what_comparing_all_pairs_finds(monkeypatch):
    monkeypatch.setattr(covertree, "SMALL", 4)
    draw = np.random.default_rng(6)
    vectors = np.repeat(draw.normal(size=(12, 6)), 12, axis=0) + 0.25 * draw.normal(size=(144, 6))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    weights = draw.integers(1, 5, 144)
    linked = vectors @ vectors.T >= 0.93
    np.fill_diagonal(linked, False)
    links = covertree.Links(vectors, weights, 0.93)
    links.within(covertree.grow(vectors, np.arange(144)))
    assert (links.counts == linked @ weights).all()
    left, right = np.arange(70), np.arange(70, 144)
    links = covertree.Links(vectors, weights, 0.93)
    links.between(covertree.grow(vectors, left), covertree.grow(vectors, right))
    linked[:70, :70] = linked[70:, 70:] = False
    assert (links.counts == linked @ weights).all()
