"""Near-duplicate vectors: dual traversal of cover trees.

Vectors of one label are dealt to cells around pivots, and cells are split into blocks of
bounded size. A vector also visits the cells that its distance to the pivot, less the
cell's covering radius, leaves within reach. In a task two blocks meet: each is made into
a tree of nested nets with halving radii, and the trees are walked together. A pair of nodes
is dropped if the distance of their centres less both covering radii exceeds the threshold,
taken whole if the distance plus both radii doesn't, and opened otherwise. A task gives one
count a vector and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabmeter.llm.common import Staged, drawn
from tabmeter.llm.components import connected_components

COSINE = 0.93
CELL = 4096  # vectors of a cell, about
BLOCK = 4096  # vectors of a block at most, but for uneven hashing
PIVOTS = 4096  # bound of the sample that pivots are chosen from
DENSE = 0.02  # share of a label's sample from which on a small ball is a cell of its own
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
SLACK = 1e-9  # bounds are kept this far from the threshold, so that rounding can't cross it
SMALL = 1 << 12  # pairs that are compared rather than opened
AT_ONCE = 1 << 15  # pairs that are compared together


@dataclass
class Node:
    """A centre, what it covers, and how far that reaches."""

    centre: int
    members: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def net(vectors: np.ndarray, some: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
    """Centres more than `radius` apart among `some`, each with those it covers."""
    near = 1.0 - radius * radius / 2.0
    centres: list[int] = []
    kept = np.empty((len(some), vectors.shape[1]))
    owner = np.full(len(some), -1)
    for at in range(0, len(some), 512):
        block = vectors[some[at : at + 512]]
        cosines = block @ kept[: len(centres)].T
        i, j = np.nonzero(cosines >= near)
        order = np.lexsort([cosines[i, j], i])  # the last of a row is its nearest centre
        owner[at + i[order]] = j[order]
        inner = block @ block.T
        for i in np.flatnonzero(owner[at : at + 512] < 0):
            if owner[at + i] < 0:
                new = (inner[i] >= near) & (owner[at : at + 512] < 0)
                new[i] = True
                owner[at : at + 512][new] = len(centres)
                kept[len(centres)] = block[i]
                centres.append(int(some[at + i]))
    order = np.argsort(owner, kind="stable")
    groups = np.split(some[order], np.flatnonzero(np.diff(owner[order])) + 1)
    return list(zip(centres, groups, strict=True))


def grow(vectors: np.ndarray, some: np.ndarray, level: int = 0) -> list[Node]:
    """The nodes of one level, with their children down to single vectors."""
    if level >= len(RADII):
        return [Node(int(i), np.array([i]), 0.0) for i in some]
    nodes = []
    for centre, members in net(vectors, some, RADII[level]):
        reach = distances(vectors[members] @ vectors[centre]).max()
        node = Node(centre, members, 0.0 if len(members) == 1 else float(reach) + SLACK)
        if len(members) > 1:
            node.children = grow(vectors, members, level + 1)
        nodes.append(node)
    return nodes


def distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


class Links:
    """Weights linked to each vector, and which vectors hang together."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, cosine: float) -> None:
        self.vectors, self.weights, self.cosine = vectors, weights, cosine
        self.reach = math.sqrt(2.0 - 2.0 * cosine)
        self.counts = np.zeros(len(vectors), np.int64)
        self.parent = list(range(len(vectors)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.root(j)] = self.root(i)

    def star(self, some: np.ndarray) -> None:
        for j in some[1:].tolist():
            self.join(int(some[0]), j)

    def pairs(self, one: np.ndarray, two: np.ndarray) -> None:
        """Pairs (one[k], two[k]) that are links."""
        np.add.at(self.counts, one, self.weights[two])
        np.add.at(self.counts, two, self.weights[one])
        nodes, place = np.unique(np.concatenate([one, two]), return_inverse=True)
        a, b = place[: len(one)], place[len(one) :]
        low, before = np.arange(len(nodes)), None
        while before is None or (low != before).any():
            before = low.copy()
            np.minimum.at(low, a, before[b])
            np.minimum.at(low, b, before[a])
            low = low[low]
        for i, j in zip(nodes[low].tolist(), nodes.tolist(), strict=True):
            self.join(i, j)

    def all_between(self, one: np.ndarray, two: np.ndarray) -> None:
        self.counts[one] += self.weights[two].sum()
        self.counts[two] += self.weights[one].sum()
        self.star(np.concatenate([one, two]))

    def all_within(self, some: np.ndarray) -> None:
        self.counts[some] += self.weights[some].sum() - self.weights[some]
        self.star(some)

    def compare(self, ones: list[Node], twos: list[Node], i: np.ndarray, j: np.ndarray) -> None:
        """Links between what ones[i[k]] and twos[j[k]] cover, for all k together."""
        flat = [np.concatenate([n.members for n in x]) for x in (ones, twos)]
        size = [np.array([len(n.members) for n in x]) for x in (ones, twos)]
        first = [np.cumsum(x) - x for x in size]
        many = size[0][i] * size[1][j]
        begin = 0
        for end in [*np.flatnonzero(np.diff(np.cumsum(many) // AT_ONCE)) + 1, len(many)]:
            p, q, n = i[begin:end], j[begin:end], many[begin:end]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(size[1][q], n)
            one = flat[0][np.repeat(first[0][p], n) + inside // wide]
            two = flat[1][np.repeat(first[1][q], n) + inside % wide]
            link = np.einsum("nd,nd->n", self.vectors[one], self.vectors[two]) >= self.cosine
            self.pairs(one[link], two[link])
            begin = end

    def between(self, ones: list[Node], twos: list[Node], same: bool = False) -> None:
        """Links between two lists of nodes, or (same) between different nodes of one list."""
        centres = [np.array([n.centre for n in x]) for x in (ones, twos)]
        radii = [np.array([n.radius for n in x]) for x in (ones, twos)]
        size = [np.array([len(n.members) for n in x]) for x in (ones, twos)]
        # nodes of like radius together: the largest of a part bounds all of it
        parts = [np.flatnonzero(radii[1] <= RADII[-3]), np.flatnonzero(radii[1] > RADII[-3])]
        for at in range(0, len(ones), 1024):
            left = self.vectors[centres[0][at : at + 1024]]
            for part in parts:
                part = part[part > at] if same else part
                if not len(part):
                    continue
                cosines = left @ self.vectors[centres[1][part]].T
                most = self.reach + radii[0][at : at + 1024] + radii[1][part].max() + SLACK
                least = np.where(most < 2.0, 1.0 - most * most / 2.0, -2.0) - SLACK
                i, j = np.nonzero(cosines >= least[:, None])
                gap, value, i, j = distances(cosines[i, j]), cosines[i, j], at + i, part[j]
                both = radii[0][i] + radii[1][j]
                close = gap - both <= self.reach + SLACK
                if same:
                    close &= j > i
                i, j, gap, both, value = (x[close] for x in (i, j, gap, both, value))
                alone = (size[0][i] == 1) & (size[1][j] == 1)
                link = alone & (value >= self.cosine)
                self.pairs(centres[0][i[link]], centres[1][j[link]])
                whole = ~alone & (gap + both <= self.reach - SLACK)
                for p, q in zip(i[whole], j[whole], strict=True):
                    self.all_between(ones[p].members, twos[q].members)
                small = size[0][i] * size[1][j] <= SMALL
                for p, q in zip(i[~alone & ~whole & ~small], j[~alone & ~whole & ~small], strict=True):
                    self.between(ones[p].children or [ones[p]], twos[q].children or [twos[q]])
                few = ~alone & ~whole & small
                if few.any():
                    self.compare(ones, twos, i[few], j[few])

    def within(self, nodes: list[Node]) -> None:
        """All links among what the nodes of one list cover."""
        self.between(nodes, nodes, same=True)
        for node in nodes:
            if len(node.members) == 1:
                continue
            if 2.0 * node.radius <= self.reach - SLACK:
                self.all_within(node.members)
            elif len(node.members) ** 2 <= 16 * SMALL:
                i, j = np.nonzero(np.triu(self.vectors[node.members] @ self.vectors[node.members].T >= self.cosine, 1))
                self.pairs(node.members[i], node.members[j])
            else:
                self.within(node.children)


WORK = "kind string, cell int, one int, two int, side int, rep bigint, size bigint, unit array<double>"
FOUND = "a bigint, b bigint, n bigint"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def meet(table: pa.Table, cosine: float) -> pa.Table:
    """(a, b, n): for each vector of a task the weight linked to it, and where it hangs."""
    vectors, side = matrix(table.column("unit")), table.column("side").to_numpy()
    rep, size = table.column("rep").to_numpy(), table.column("size").to_numpy()
    links = Links(vectors, size, cosine)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if side.max() > 1:  # one block with itself
        links.within(grow(vectors, np.arange(len(side))))
    elif len(left) and len(right):
        links.between(grow(vectors, left), grow(vectors, right))
    some = np.flatnonzero(links.counts)
    roots = np.array([links.root(int(i)) for i in some], int)
    return pa.table({"a": rep[some], "b": rep[roots], "n": links.counts[some]})


@dataclass
class Cells:
    """Pivots of the labels that have many vectors; those from `dense` on are small balls."""

    pivots: dict[str, np.ndarray]
    dense: dict[str, int]
    radius: dict[tuple[str, int], float] = field(default_factory=dict)
    blocks: dict[tuple[str, int], int] = field(default_factory=dict)
    visits: dict[tuple[str, int], int] = field(default_factory=dict)

    def home(self, kind: str, vectors: np.ndarray, ball: float) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its distance to the pivot."""
        gap = distances(vectors @ self.pivots[kind].T)
        first = self.dense[kind]
        cell = gap[:, :first].argmin(axis=1)
        if first < gap.shape[1]:
            small = gap[:, first:].argmin(axis=1) + first
            inside = gap[np.arange(len(gap)), small] <= ball
            cell = np.where(inside, small, cell)
        return cell, gap[np.arange(len(gap)), cell]


def choose_cells(sample: dict[str, np.ndarray], sizes: dict[str, int], ball: float) -> Cells:
    """Pivots by farthest-first order, and the centres of crowded balls."""
    cells = Cells({}, {})
    for kind, vectors in sample.items():
        wanted = min(len(vectors), math.ceil(sizes[kind] / CELL))
        chosen, nearest = [0], distances(vectors @ vectors[0])
        while len(chosen) < wanted and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(vectors @ vectors[chosen[-1]]))
        inside = distances(np.clip(vectors @ vectors.T, -1, 1)) <= ball
        free, balls = np.ones(len(vectors), bool), []
        while (count := (inside & free).sum(axis=1)).max(initial=0) >= max(4, DENSE * len(vectors)):
            balls.append(int(count.argmax()))
            free &= ~inside[balls[-1]]
        cells.pivots[kind], cells.dense[kind] = vectors[chosen + balls], len(chosen)
    return cells


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(kind, embedding, rep, size, unit): distinct vectors that can link, with their smallest
    id and how many rows have them. `kind` is the label and the number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, good = [], []
            for value in batch.column("embedding"):
                vector = np.asarray(value.values.to_numpy(zero_copy_only=False), float)
                with np.errstate(all="ignore"):
                    scaled = vector / np.abs(vector).max() if len(vector) else vector
                    unit = scaled / np.linalg.norm(scaled)
                good.append(bool(len(vector)) and bool(np.isfinite(unit).all()))
                units.append(unit if good[-1] else None)
            kept = pa.array(good, pa.bool_())
            names = ["kind", "embedding", "rep", "size"]
            arrays = [batch.column(x) for x in names] + [pa.array(units, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "unit"]).filter(kept)

    schema = rows.select("embedding").schema[0].dataType.simpleString()
    sound = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    whole = rows.where(sound & ~F.exists("embedding", lambda x: x.isNull()) & (F.size("embedding") > 0))
    classes = whole.groupBy("kind", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    return classes.mapInArrow(run, f"kind string, embedding {schema}, rep bigint, size bigint, unit array<double>")


def work_rows(homes: DataFrame, cells: Cells, reach: float) -> DataFrame:
    """The rows of every task: blocks of a cell with each other, and with its visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            index: list[int] = []
            fields = zip(*(batch.column(x).to_pylist() for x in ("kind", "cell", "n", "rep", "size")), strict=True)
            for i, (kind, cell, n, rep, size) in enumerate(fields):
                key, lot = (kind, cell), _lot(rep)
                split = kind in cells.pivots
                blocks = cells.blocks[key] if split else math.ceil(n / BLOCK)
                own = lot % blocks
                if not split or cell < cells.dense[kind]:  # a small ball's vectors all link, see linked_vectors
                    for other in range(blocks):
                        one, two = min(own, other), max(own, other)
                        rows.append((kind, cell, one, two, 2 if one == two else int(own == two), rep, size))
                        index.append(i)
                if not split:
                    continue
                for visit in range(cells.visits.get(key, 0)):
                    rows.append((kind, cell, own, -1 - visit, 0, rep, size))
                    index.append(i)
            names, reps, weights = (batch.column(x).to_pylist() for x in ("kind", "rep", "size"))
            for i, other in visits(cells, batch, reach):
                lots = cells.visits.get((names[i], other), 1)
                for block in range(cells.blocks[names[i], other]):
                    rows.append((names[i], other, block, -1 - _lot(reps[i]) % lots, 1, reps[i], weights[i]))
                    index.append(i)
            if rows:
                types = [pa.string(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), types, strict=True)]
                units = batch.column("unit").take(pa.array(index))
                names = ["kind", "cell", "one", "two", "side", "rep", "size", "unit"]
                yield pa.RecordBatch.from_arrays([*arrays, units], names)

    return homes.mapInArrow(run, WORK)


def _lot(rep: int) -> int:
    return (rep * 0x9E3779B97F4A7C15 >> 20) & 0x7FFFFFFF


def visits(cells: Cells, batch: pa.RecordBatch, reach: float) -> Iterator[tuple[int, int]]:
    """(row, cell): later cells of its kind that may hold a vector within reach of the row's."""
    kinds, home = np.array(batch.column("kind").to_pylist(), object), batch.column("cell").to_numpy()
    for kind in set(kinds) & cells.pivots.keys():
        own = np.flatnonzero(kinds == kind)
        pivots = cells.pivots[kind]
        radius = np.array([cells.radius.get((kind, c), -np.inf) for c in range(len(pivots))])
        gap = distances(matrix(batch.column("unit").take(pa.array(own))) @ pivots.T)
        near = (gap - radius <= reach + SLACK) & (np.arange(len(pivots)) > home[own][:, None])
        rows, others = np.nonzero(near)
        yield from zip(own[rows].tolist(), others.tolist(), strict=True)


def linked_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `rows` (vec_id, embedding, label).

    Two rows link if their labels are equal and not null and the cosine of their vectors, in
    double precision, is at least `cosine`. Vectors that are null, empty, zero or hold a null
    or non-finite component link with nothing, nor do vectors of different length or rows
    without a vec_id. n_links counts the other rows linked directly, component_id is the
    smallest vec_id reachable, and kept says whether it is the row's own. Equal vectors are
    one vector with a weight, and rows that repeat a vec_id count one by one. An empty table
    gives an empty result; other columns are not read.
    """
    spark = rows.sparkSession
    staged, reach = Staged(spark), math.sqrt(2.0 - 2.0 * cosine)
    ball = reach / 2.0 - SLACK
    kind = F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string"))
    given = rows.select("vec_id", "embedding", "label", kind.alias("kind"))
    units = staged.write(unit_vectors(given), "units")
    kinds = staged.write(units.groupBy("kind").agg(F.count("*").alias("n")), "kinds")
    large = kinds.where(F.col("n") > CELL).orderBy(F.desc("n"), "kind").limit(PIVOTS // 16)
    sizes = {row["kind"]: row["n"] for row in large.collect()}  # the other kinds are one cell each
    total = sum(sizes.values())
    sample: dict[str, np.ndarray] = {}
    if sizes:
        share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, PIVOTS / total + 16 / n))])
        some = units.where(F.col("kind").isin(list(sizes))).where(drawn(share[F.col("kind")], "rep"))
        rows = some.select("kind", "rep", "unit").limit(4 * PIVOTS).collect()  # PIVOTS, and 16 a label, are expected
        for row in sorted(rows, key=lambda row: (row["kind"], row["rep"])):
            sample.setdefault(row["kind"], []).append(row["unit"])
        sample = {k: np.array(v) for k, v in sample.items()}
    sizes = {k: n for k, n in sizes.items() if k in sample}
    cells = choose_cells(sample, sizes, ball)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("kind").to_pylist()
            cell, gap = np.zeros(len(names), np.int32), np.zeros(len(names))
            kinds = np.array(names, object)
            for kind in set(names) & cells.pivots.keys():
                own = np.flatnonzero(kinds == kind)
                vectors = matrix(batch.column("unit").take(pa.array(own)))
                cell[own], gap[own] = cells.home(kind, vectors, ball)
            names = ["n", "rep", "size", "unit"]
            arrays = [batch.column("kind"), pa.array(cell), pa.array(gap), *(batch.column(x) for x in names)]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "cell", "gap", *names])

    homes = units.join(kinds, "kind").mapInArrow(
        settle, "kind string, cell int, gap double, n bigint, rep bigint, size bigint, unit array<double>"
    )
    if sizes:
        homes = staged.write(homes, "homes")
        some = F.col("kind").isin(list(sizes))
        stats = homes.where(some).groupBy("kind", "cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
        for row in stats.collect():  # cells, of which there are at most twice PIVOTS
            key = (row["kind"], row["cell"])
            cells.radius[key] = row["radius"]
            cells.blocks[key] = math.ceil(row["n"] / BLOCK)

        def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch.column("kind").to_pylist()
                out = [(kinds[i], other) for i, other in visits(cells, batch, reach)]
                if out:
                    names = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays(names, ["kind", "cell"])

        for row in homes.where(some).mapInArrow(calls, "kind string, cell int").groupBy("kind", "cell").count().collect():
            cells.visits[row["kind"], row["cell"]] = math.ceil(row["count"] / BLOCK)
    tasks = work_rows(homes, cells, reach).groupBy("kind", "cell", "one", "two")
    found = tasks.applyInArrow(lambda table: meet(table, cosine), FOUND)
    dense = [f"{kind} {c}" for kind, first in cells.dense.items() for c in range(first, len(cells.pivots[kind]))]
    if dense:
        crowd = homes.where(F.concat_ws(" ", "kind", "cell").isin(dense))
        sums = crowd.groupBy("kind", "cell").agg(F.min("rep").alias("b"), F.sum("size").alias("all"))
        bulk = crowd.join(F.broadcast(sums), ["kind", "cell"]).select(
            F.col("rep").alias("a"), "b", (F.col("all") - F.col("size")).alias("n")
        )
        found = found.unionAll(bulk)
    found = staged.write(found, "found")
    joined = connected_components(found.select("a", "b"), staged)
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    classes = staged.write(
        units.select("kind", "embedding", "rep", "size")
        .join(counts, F.col("rep") == F.col("a"), "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("kind", "embedding", "size", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component")),
        "classes",
    )
    known = given.join(classes, ["kind", "embedding"], "left").where(F.col("vec_id").isNotNull())
    lost = given.where(F.col("vec_id").isNull()).select("vec_id", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("component"))
    own = F.coalesce("component", "vec_id")
    return (
        known.select("vec_id", "size", "n", "component")
        .unionAll(lost)
        .select(
            "vec_id",
            F.coalesce(F.col("size") - 1 + F.col("n"), F.lit(0).cast("bigint")).alias("n_links"),
            own.alias("component_id"),
            F.col("vec_id").eqNullSafe(own).alias("kept"),
        )
    )
