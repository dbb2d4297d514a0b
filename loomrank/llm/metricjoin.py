"""Near-duplicate vectors by an exact metric range join.

Unit vectors a cosine of c apart lie sqrt(2 - 2c) apart, which is a metric. Pivots part them into cells, each vector going
to its nearest pivot. A vector also visits the cells that may hold something in its range: those whose bisector is no further
than the range and whose ring of distances about the pivot, widened by the range, it lies in. Of two cells only one is
visited by the other's vectors. Cells join on their own, in blocks and by rising distance from the pivot, so that blocks
whose distances differ by more than the range are never multiplied.

Vectors within half the range of a pivot are its core: by the triangle inequality all of a core are linked, so their links
are counted and not compared. A core of a third of all vectors costs its size. Pivots lie further than two ranges apart, so
that no link joins two cores. Equal vectors are compared as one, with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.llm.common import components, map_batches, materialise
from loomrank.llm.simhash import joined

COSINE = 0.95
#: Vectors that pivots are chosen among; pivots at least and at most.
SAMPLE, PIVOTS, MOST_PIVOTS = 2048, 12, 256
#: Vectors that a cell, or a part of it, keeps in memory while visitors pass.
CELL_ROWS = 200_000
#: Vectors of a block.
BLOCK = 2048
#: Slack of distances in double precision.
SLACK = 1e-9


def usable(vec: Column) -> Column:
    """Whether a vector can link: it has components, all of them finite and not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by their greatest component first, for squares may overflow."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def hosts(a: np.ndarray | int, b: np.ndarray | int):
    """Whether the first of two cells (or parts) is where they meet: of each two exactly one is, of many each about half the time."""
    low = np.minimum(a, b)
    return np.where((np.add(a, b) & 1) == 1, low == a, low != a)


def choose_pivots(sample: np.ndarray, n: int, reach: float) -> np.ndarray:
    """Up to ``n`` of the unit vectors ``sample``, those with most others in half the reach first, further than two reaches apart."""
    dist = np.sqrt(np.maximum(0, 2 - 2 * sample @ sample.T))
    order = np.argsort(-(dist <= reach / 2).sum(1), kind="stable")
    taken: list[int] = []
    for i in order.tolist():
        if len(taken) == n:
            break
        if not taken or dist[i, taken].min() > 2 * reach + 1e-6:
            taken.append(i)
    return sample[taken]


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The row numbers of each number of components in a list column, with their vectors as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows, None] + np.arange(size)]


def assigned(classes: DataFrame, pivots: dict[int, np.ndarray], reach: float) -> DataFrame:
    """``node, w, dim, cell, core, dist, vec`` of ``classes(node, w, vec)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("vec")
            cell, dist, dim = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            for rows, vectors in by_size(column):
                dim[rows] = vectors.shape[1]
                p = pivots.get(vectors.shape[1])
                if p is None:  # no vector of this size is in the sample: one cell, in parts
                    dist[rows] = 1
                    continue
                dots = units(vectors) @ p.T
                cell[rows] = dots.argmax(1)
                dist[rows] = np.sqrt(np.maximum(0, 2 - 2 * dots.max(1)))
            core = np.array([d in pivots for d in dim.tolist()], bool) & (dist <= reach / 2 - SLACK)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("w"), pa.array(dim), pa.array(cell), pa.array(core), pa.array(dist), column], ["node", "w", "dim", "cell", "core", "dist", "vec"])

    kind = classes.schema["vec"].dataType.simpleString()
    return map_batches(classes.select("node", "w", "vec"), run, f"node long, w long, dim int, cell int, core boolean, dist double, vec {kind}")


class Units:
    """The parts that join on their own: each cell's core and its other vectors, each in parts of bounded size."""

    def __init__(self, stats: list, rows: int):
        self.first: dict[tuple[int, int, bool], int] = {}
        self.parts: dict[tuple[int, int, bool], int] = {}
        self.ring: dict[tuple[int, int, bool], tuple[float, float]] = {}
        self.cores: set[int] = set()
        self.number = 0
        for s in sorted(stats, key=lambda s: (s.dim, s.cell, s.core)):
            key = (s.dim, s.cell, s.core)
            self.first[key], self.parts[key], self.ring[key] = self.number, -(-s.n // rows), (s.low, s.high)
            if s.core:
                self.cores.update(range(self.number, self.number + self.parts[key]))
            self.number += self.parts[key]


def dealt(rows: DataFrame, pivots: dict[int, np.ndarray], of: Units, reach: float) -> DataFrame:
    """``unit, visits, dist, node, w, vec``: each vector in its own unit, and as a visitor where a link may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, cell, core, dist, node = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "core", "dist", "node"))
            row, unit, visits, far = [], [], [], []

            def put(rows: np.ndarray, units_: np.ndarray | int, visitor: bool, d: np.ndarray) -> None:
                row.append(rows)  # noqa: B023
                unit.append(np.broadcast_to(np.asarray(units_, np.int32), rows.shape))  # noqa: B023
                visits.append(np.full(len(rows), visitor))  # noqa: B023
                far.append(d)  # noqa: B023

            for key in sorted({k for k in zip(dim.tolist(), cell.tolist(), core.tolist(), strict=True)}):
                size, c, is_core = key
                mine = np.flatnonzero((dim == size) & (cell == c) & (core == is_core))
                part = node[mine] % of.parts[key]
                put(mine, of.first[key] + part, False, dist[mine])
                if is_core:
                    continue
                for other in range(of.parts[key]):
                    there = (part != other) & hosts(other, part)
                    put(mine[there], of.first[key] + other, True, dist[mine[there]])
            for rows, vectors in by_size(b.column("vec")):
                p = pivots.get(vectors.shape[1])
                rows_, vectors = rows[~core[rows]], vectors[~core[rows]]
                if p is None or not len(rows_):
                    continue
                dots = units(vectors) @ p.T
                size, home = vectors.shape[1], cell[rows_]
                gaps = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                for c in range(len(p)):
                    d = np.sqrt(np.maximum(0, 2 - 2 * dots[:, c]))
                    if (key := (size, c, False)) in of.first:
                        low, high = of.ring[key]
                        near = dots[np.arange(len(home)), home] - dots[:, c] <= reach * gaps[home, c] + SLACK
                        there = (home != c) & hosts(c, home) & near & (d >= low - reach - SLACK) & (d <= high + reach + SLACK)
                        for part in range(of.parts[key]):
                            put(rows_[there], of.first[key] + part, True, d[there])
                    if (key := (size, c, True)) in of.first:
                        there = d <= of.ring[key][1] + reach + SLACK
                        for part in range(of.parts[key]):
                            put(rows_[there], of.first[key] + part, True, d[there])
            take, *cols = (np.concatenate(x) for x in (row, unit, visits, far))
            for i in range(0, len(take), 4096):
                some = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in cols), *(b.column(c).take(pa.array(take[some])) for c in ("node", "w", "vec"))], ["unit", "visits", "dist", "node", "w", "vec"])

    kind = rows.schema["vec"].dataType.simpleString()
    return map_batches(rows, run, f"unit int, visits boolean, dist double, node long, w long, vec {kind}")


class Side:
    """Vectors of one unit by rising distance: unit vectors in both precisions, distances, ids, weights."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        flat = table["vec"].combine_chunks()
        self.exact = np.concatenate([v for _, v in by_size(flat)]) if len(flat) else np.zeros((0, 1))
        self.exact = units(self.exact) if len(flat) else self.exact
        self.quick = self.exact.astype(np.float32)
        self.dist, self.node, self.w = (table[c].to_numpy() for c in ("dist", "node", "w"))


def linked(x: Side, y: Side, i: slice, j: slice, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of two blocks with the cosine. Single precision decides all but what lies close to it."""
    dots = x.quick[i] @ y.quick[j].T
    close = 1e-5 + x.quick.shape[1] * 1.2e-7
    a, b = np.nonzero(dots >= cosine - close)
    if len(a):
        unsure = np.flatnonzero(dots[a, b] < cosine + close)
        keep = np.ones(len(a), bool)
        for k in range(0, len(unsure), 1 << 16):
            u = unsure[k : k + (1 << 16)]
            keep[u] = np.einsum("ij,ij->i", x.exact[i][a[u]], y.exact[j][b[u]]) >= cosine
        a, b = a[keep], b[keep]
    return a + i.start, b + j.start


def joins(cosine: float, reach: float, cores: set[int]):
    """``node, n, root`` of a unit: how many a vector is linked to there, and one it is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        home: Side | None = None
        label = count = None

        def settle() -> None:
            """The unit's own vectors are complete: they are compared with each other, unless all are linked."""
            nonlocal home, label, count
            core = held[0].column("unit")[0].as_py() in cores
            home = Side(held)
            label, count = np.arange(len(home.node)), np.zeros(len(home.node), np.int64)
            for at in range(0, 0 if core else len(label), BLOCK):
                mine = slice(at, min(at + BLOCK, len(label)))
                until = int(np.searchsorted(home.dist, home.dist[mine.stop - 1] + reach + SLACK, "right"))
                for to in range(at, until, BLOCK):
                    a, b = linked(home, home, mine, slice(to, min(to + BLOCK, until)), cosine)
                    a, b = a[a < b], b[a < b]
                    np.add.at(count, a, home.w[b])
                    np.add.at(count, b, home.w[a])
                    unite(a, b)

        def unite(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal label
            x, y = label[a], label[b]
            if (x != y).any():
                label = joined(label, np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0))

        def visited(batch: pa.RecordBatch) -> pa.RecordBatch:
            guests = Side([batch])
            n, first = np.zeros(len(guests.node), np.int64), np.full(len(guests.node), -1)
            lo, hi = np.searchsorted(home.dist, [guests.dist.min() - reach - SLACK, guests.dist.max() + reach + SLACK])
            for to in range(int(lo), int(hi), BLOCK):
                g, h = linked(guests, home, slice(0, len(n)), slice(to, min(to + BLOCK, int(hi))), cosine)
                if len(g):
                    np.add.at(n, g, home.w[h])
                    np.add.at(count, h, guests.w[g])
                    new = first[g] < 0
                    first[g[new]] = h[new]
                    unite(first[g], h)
            some = n > 0
            return pa.RecordBatch.from_arrays([pa.array(guests.node[some]), pa.array(n[some]), pa.array(home.node[first[some]])], ["node", "n", "root"])

        for b in batches:
            visits = b.column("visits").to_numpy(zero_copy_only=False)
            own = int(len(visits) - visits.sum())  # sorted: the unit's own come first
            if own:
                held.append(b.slice(0, own))
            if own < b.num_rows:
                if home is None:
                    settle()
                for i in range(own, b.num_rows, BLOCK):
                    yield visited(b.slice(i, min(BLOCK, b.num_rows - i)))
        if held:
            if home is None:
                settle()
            some = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(home.node[some]), pa.array(count[some]), pa.array(home.node[label[some]])], ["node", "n", "root"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``key, n_links, component_id, kept`` of every row: the other rows within the cosine, the least key reachable over links, whether it is that one.

    Vectors that are null or empty, or have a null, non-finite or no non-zero component link with nothing, not even their
    equals; neither do vectors of different sizes. Repeated rows link with each other, and all rows come back. A null key
    names no component unless all its keys are null, and such a row is never kept; rows that share a key may all be kept.
    An empty table gives no rows. No other column is read, so names can't clash.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vec].dataType.simpleString() == "array<float>" else "double"
    v = F.col("vec")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vec}`").cast(f"array<{kind}>").alias("vec"))
    # equal vectors are told by two hashes of 64 bits
    marked = rows.withColumn("ok", usable(v)).select("key", "vec", F.when(F.col("ok"), F.xxhash64("vec")).alias("k1"), F.when(F.col("ok"), F.xxhash64(F.lit(12), "vec")).alias("k2"))
    grouped = marked.where("k1 is not null").groupBy("k1", "k2").agg(F.min("key").alias("first"), F.count("*").alias("w"), F.first("vec").alias("vec"))
    classes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()))
    reach = math.sqrt(2 - 2 * cosine)
    n = classes.count()
    wanted = min(MOST_PIVOTS, max(PIVOTS, -(-n // CELL_ROWS)))
    pivots: dict[int, np.ndarray] = {}
    drawn = [r.vec for r in classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vec").collect()]
    for size in sorted({len(x) for x in drawn}):
        pivots[size] = choose_pivots(units(np.array([x for x in drawn if len(x) == size])), wanted, reach)
    placed = materialise(assigned(classes, pivots, reach))
    stats = placed.groupBy("dim", "cell", "core").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.min("node").alias("head"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    stats = stats.collect()  # a row a pivot and size of vector
    of = Units(stats, CELL_ROWS)
    if of.number:
        moved = dealt(placed, pivots, of, reach).repartitionById(of.number, F.col("unit")).sortWithinPartitions("visits", "dist")
        found = materialise(map_batches(moved, joins(cosine, reach, of.cores), "node long, n long, root long"))
    else:
        found = materialise(spark.createDataFrame([], "node long, n long, root long"))
    heads = spark.createDataFrame([(s.dim, s.cell, s.weight, s.head) for s in stats if s.core], "dim int, cell int, weight long, head long")
    inside = placed.where("core").select("node", "w", "dim", "cell").join(F.broadcast(heads), ["dim", "cell"])
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(inside.select(F.col("node").alias("a"), F.col("head").alias("b")))
    counts = found.select("node", "n").unionByName(inside.select("node", (F.col("weight") - F.col("w")).alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
    reached = classes.select("k1", "k2", "first", "w", "node").join(counts, "node", "left").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = reached.groupBy("root").agg(F.min("first").alias("component"))
    told = reached.join(least, "root").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("links"), "component")
    out = marked.drop("vec").join(told, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.when(F.col("c1").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
