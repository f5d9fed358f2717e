"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square test stops.

A 2-stable projection of a difference to m dimensions has a squared length of its true square times a chi-square
variable of m degrees. The projections of all rows are cut by a kd-tree into cells; the tree is fitted on a bounded
sample, every row goes into the index. A query visits its nearest cells first. In a cell it takes rows in order of
projected distance, leaf by leaf of the cell's own kd-tree, verifies them in small batches on the original vectors,
and stops at the first row so far away that one there which beats the k-th neighbour found would have a projection
that long only with probability 1 - confidence. The same test decides which further cells it goes to.

Rows take part if they have an id and a vector without null or non-finite components that isn't zero. Only
vectors of a query's length are its candidates. Ties go to the smaller id; a query's own id is no candidate. Of several
rows with one id the nearest counts as a candidate; asked is the least of their vectors. Equal rows count once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windloom.llm.common import stored

#: Dimensions of the projection (even), confidence of the stopping test, rows in a leaf.
DIM, CONFIDENCE, LEAF = 16, 0.92, 32
#: Rows meant for a cell; rows on which the cells are fitted and number of cells, at most; queries that meet a cell at once.
CELL_ROWS, SAMPLE, CELLS, QUERIES = 8192, 100_000, 16_384, 4096
#: Cells to which a query goes in the first rounds; in the last one to all that the test leaves.
ROUNDS = (1, 4)


def chi_square_quantile(p: float, m: int) -> float:
    """For even m, where the distribution has a closed form."""
    lo, hi = 0.0, 1000.0
    while hi - lo > 1e-9:
        x = (lo + hi) / 2
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        lo, hi = (x, hi) if 1 - math.exp(-x / 2) * total < p else (lo, x)
    return hi


def projection(length: int, dim: int) -> np.ndarray:
    return np.random.default_rng([20240101, length]).standard_normal((length, dim))


def gaps(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    gap = np.maximum(0.0, np.maximum(low - q, q - high))
    return np.einsum("ij,ij->i", gap, gap)


class KdTree:
    """Median splits on the widest axis down to leaves; boxes of the leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.bounds: list[tuple[int, int]] = []
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                self.bounds.append((a, b))
                continue
            own = self.order[a:b]
            axis = int(np.argmax(np.ptp(points[own], axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = own[np.argpartition(points[own, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in self.bounds])
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in self.bounds])


class Cells:
    """Splits (axis, value) of a kd-tree over a sample, as arrays; a point's cell is the leaf that it falls into."""

    def __init__(self, points: np.ndarray, wanted: int):
        self.axis, self.cut, self.child = [], [], []
        self.count = 0
        self._split(points, wanted)
        self.axis, self.cut, self.child = np.array(self.axis, int), np.array(self.cut), np.array(self.child, int).reshape(-1, 2)

    def _split(self, points: np.ndarray, wanted: int) -> int:
        """The node's number; of a leaf -1 - its cell."""
        spread = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(1)
        if wanted <= 1 or spread.max() <= 0:
            self.count += 1
            return -self.count
        axis = int(np.argmax(spread))
        cut = float(np.median(points[:, axis]))
        left = points[:, axis] < cut
        if not left.any():
            cut = float(np.nextafter(cut, np.inf))
            left = points[:, axis] < cut
        me = len(self.axis)
        self.axis.append(axis)
        self.cut.append(cut)
        self.child.append((0, 0))
        self.child[me] = (self._split(points[left], wanted // 2), self._split(points[~left], wanted - wanted // 2))
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), int) if len(self.axis) else np.full(len(points), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = self.child[node, (points[inner, self.axis[node]] >= self.cut[node]).astype(int)]
        return -1 - at


class Index:
    """One cell: ids, vectors, projections and their kd-tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dim: int = DIM):
        self.ids, self.vectors = ids, vectors
        self.points = vectors @ projection(vectors.shape[1], dim)
        self.tree = KdTree(self.points)

    def search(self, own: int, q: np.ndarray, point: np.ndarray, k: int, kth: float, stop: float, batch: int = 32) -> tuple[list[tuple[float, int]], int]:
        """The k nearest of this cell within kth as (distance, id), ordered, and how many rows were verified."""
        tree, best, verified = self.tree, [], 0
        lower = gaps(tree.low, tree.high, point)
        leaves = np.argsort(lower, kind="stable")
        rows, far, at, wanted = np.zeros(0, int), np.zeros(0), 0, batch
        while True:
            limit = stop * kth * kth * (1 + 1e-9) + 1e-9
            bound = lower[leaves[at]] if at < len(leaves) else math.inf
            ready = far <= bound  # no row of a leaf not yet opened is nearer
            if at < len(leaves) and bound <= limit and np.count_nonzero(ready) < wanted:
                more = np.concatenate([tree.order[slice(*tree.bounds[i])] for i in leaves[at : at + 8]])
                at += 8
                gap = self.points[more] - point
                rows, far = np.concatenate([rows, more]), np.concatenate([far, np.einsum("ij,ij->i", gap, gap)])
                continue
            take = np.flatnonzero(ready)
            take = take[np.argsort(far[take], kind="stable")]
            for a in range(0, len(take), batch):
                part = take[a : a + batch]
                part = part[far[part] <= stop * kth * kth * (1 + 1e-9) + 1e-9]
                if not len(part):
                    return best, verified
                verified += len(part)
                now = rows[part]
                gap = self.vectors[now] - q
                found = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                fit = np.flatnonzero((found <= kth) & (self.ids[now] != own))
                if len(fit):
                    near = {i: d for d, i in best}
                    for d, i in zip(found[fit].tolist(), self.ids[now[fit]].tolist()):
                        near[i] = min(d, near.get(i, math.inf))
                    best = sorted((d, i) for i, d in near.items())[:k]
                    if len(best) >= k:
                        kth = min(kth, best[-1][0])
            if at >= len(leaves) or bound > stop * kth * kth * (1 + 1e-9) + 1e-9:
                if not len(take) or ready.all():
                    return best, verified
            rows, far, wanted = rows[~ready], far[~ready], min(2 * wanted, 1024)


def usable(vector: str | Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


class Built:
    """rows: length, cell, vec_id, v of every row (stored); cells by length; boxes of the cells' projections by length."""

    def __init__(self, rows: DataFrame, fitted: dict[int, Cells], boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], dim: int):
        self.rows, self.fitted, self.boxes, self.dim = rows, fitted, boxes, dim


def build(rows: DataFrame, dim: int = DIM, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> Built:
    """Index all usable rows. Cells are fitted, for each length of vectors, on at most ``sample`` rows, those of least hash."""
    valid = rows.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    valid = valid.withColumn("length", F.size("v"))
    counts = {r["length"]: r["count"] for r in valid.groupBy("length").count().collect()}  # one row for each length
    fitted = {}
    for length, n in counts.items():
        wanted = min(CELLS, -(-n // cell_rows))
        points = np.zeros((0, dim))
        if wanted > 1:

            def projected(batches, length=length):
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([pa.array(list(_matrix(batch.column(0), length) @ projection(length, dim)), pa.list_(pa.float64()))], names=["point"])

            part = valid.where(F.col("length") == length).orderBy(F.xxhash64("vec_id", "v")).limit(sample).select("v").mapInArrow(projected, "point array<double>")
            points = _matrix(part.toArrow().column(0).combine_chunks(), dim)  # at most sample rows of dim numbers
        fitted[length] = Cells(points, wanted)

    def assign(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == length))
                vectors = column.take(at)
                points = _matrix(vectors, length) @ projection(length, dim)
                yield pa.RecordBatch.from_arrays([pa.array([length] * len(at), pa.int32()), pa.array(fitted[length].of(points), pa.int32()), ids.take(at), vectors, pa.array(list(points.reshape(-1, dim)), pa.list_(pa.float64()))], names=["length", "cell", "vec_id", "v", "point"])

    placed = stored(valid.select("vec_id", "v").mapInArrow(assign, "length int, cell int, vec_id long, v array<double>, point array<double>"))
    edges = [f(F.col("point")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(dim)]
    boxes = {}
    told = placed.groupBy("length", "cell").agg(*edges).toPandas()  # at most CELLS rows for each length
    for length, own in told.groupby("length"):
        boxes[int(length)] = own["cell"].to_numpy(), own[[f"min{i}" for i in range(dim)]].to_numpy(), own[[f"max{i}" for i in range(dim)]].to_numpy()
    return Built(placed.drop("point"), fitted, boxes, dim)


FOUND = "query_id long, vec_id long, score double, verified long"


def _visit(index: Built, routed: DataFrame, k: int, stop: float) -> DataFrame:
    """query_id, vec_id, score of each routed(length, cell, block, query_id, v, kth) query's nearest rows in the cell; a last row without vec_id tells how many were verified."""
    dim = index.dim

    def meet(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            cell = Index(rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()), dim)
            vectors = np.stack(asked["v"].to_numpy())
            points = vectors @ projection(vectors.shape[1], dim)
            for own, q, point, kth in zip(asked["query_id"].tolist(), vectors, points, asked["kth"].tolist()):
                best, verified = cell.search(own, q, point, k, kth, stop)
                out += [(own, i, d, 0) for d, i in best]
                out.append((own, None, None, verified))
        got = pd.DataFrame(out, columns=["query_id", "vec_id", "score", "verified"])
        return got.astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "verified": "int64"})

    blocks = routed.select("length", "cell", F.col("block").alias("part")).distinct()
    sent = index.rows.join(F.broadcast(blocks), ["length", "cell"])  # at most CELLS rows a length and block of QUERIES
    return sent.groupBy("length", "cell", "part").cogroup(routed.groupBy("length", "cell", "block")).applyInPandas(meet, FOUND)


def ask(index: Built, queries: DataFrame, k: int = 10, confidence: float = CONFIDENCE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERIES, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """query_id, rank, vec_id, score, verified (rows compared on their vectors) of each query's k nearest rows found."""
    asked = queries.where(F.col(id_col).isNotNull() & usable(vector_col)).groupBy(F.col(id_col).cast("long").alias("query_id")).agg(F.min(F.col(vector_col).cast("array<double>")).alias("v"))
    n = asked.count()
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // block)))).cast("int")))
    stop, boxes, dim = chi_square_quantile(confidence, index.dim), index.boxes, index.dim
    found, best, done = None, asked.select("query_id", F.lit(float("inf")).alias("kth")), 0
    for most in (*rounds, None):

        def route(batches, first=done, most=most):
            for batch in batches:
                out = [[], [], []]
                for at, (v, kth) in enumerate(zip(batch.column("v").to_pylist(), batch.column("kth").to_pylist())):
                    if len(v) not in boxes:
                        continue
                    cells, low, high = boxes[len(v)]
                    lower = gaps(low, high, np.array(v) @ projection(len(v), dim))
                    order = np.argsort(lower, kind="stable")[first : None if most is None else first + most]
                    for c in order[lower[order] <= stop * kth * kth * (1 + 1e-9) + 1e-9].tolist():
                        out[0].append(at)
                        out[1].append(int(cells[c]))
                        out[2].append(len(v))
                own = batch.take(pa.array(out[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(out[2], pa.int32()), pa.array(out[1], pa.int32()), own.column("block"), own.column("query_id"), own.column("v"), own.column("kth")], names=["length", "cell", "block", "query_id", "v", "kth"])

        routed = asked.join(best, "query_id").select("block", "query_id", "v", "kth").mapInArrow(route, "length int, cell int, block int, query_id long, v array<double>, kth double")
        got = _visit(index, stored(routed), k, stop)
        found = stored(got if found is None else found.union(got))
        done += most or 0
        near = found.where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
        kth = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("k"))
        best = asked.select("query_id").join(kth, "query_id", "left").select("query_id", F.coalesce("k", F.lit(float("inf"))).alias("kth"))
        if most is None or all(done >= len(c) for c, _, _ in boxes.values()):
            break
    effort = found.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    return ranked.join(effort, "query_id").select("query_id", "rank", "vec_id", "score", "verified")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, dim: int = DIM, confidence: float = CONFIDENCE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERIES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score, verified: each query's k nearest of rows, by an index of all rows."""
    return ask(build(rows, dim, id_col, vector_col, cell_rows), queries, k, confidence, id_col, vector_col, block)
