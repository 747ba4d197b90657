"""Vectors that the tests of integer vectors share."""

import math
import random

VECTORS = "vec_id bigint, embedding array<float>, label int"


def spread(n: int, width: int, seed: int, step: float = 1 / 64) -> list[list[float]]:
    """Made-up vectors around a few centres, on a grid so that ties are common."""
    draw = random.Random(seed)
    centres = [[draw.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    return [[round((x + draw.gauss(0, 0.2)) / step) * step for x in draw.choice(centres)] for _ in range(n)]


def odd_vectors(width: int) -> list[tuple]:
    """Rows that no operator on integer vectors keeps."""
    inf, nan = math.inf, math.nan
    return [
        (900, None, 1),
        (901, [], 1),
        (902, [0.5] * (width - 1) + [None], 1),
        (903, [0.5] * (width - 1) + [nan], None),
        (904, [inf] + [0.5] * (width - 1), 2),
        (905, [-inf] * width, 2),
        (906, [1e30] * width, 2),
        (907, [0.5] * (width + 1), 2),
        (None, None, None),
    ]


def floored(vector: list[float], scale: int) -> list[int]:
    return [math.floor(scale * x) for x in vector]


def gap(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def moved(entries: list[list[int]], vectors: list[list[int]], chosen: list[int]) -> list[list[int]]:
    """Entries at the floor of the mean of the vectors that chose them."""
    out = []
    for i, entry in enumerate(entries):
        own = [v for v, c in zip(vectors, chosen, strict=True) if c == i]
        out.append([sum(column) // len(own) for column in zip(*own, strict=True)] if own else entry)
    return out
