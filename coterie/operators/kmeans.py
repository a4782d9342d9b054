"""Seeded and constrained k-means over vectors held by several parties.

Vectors pass through tasks in Arrow batches as matrices: a batch is scored against all centres by one
product, and what leaves a task are sums by cluster. Centres (clusters times dimensions numbers) are all that
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .select import hash_order


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that are not null as rows of doubles, and which rows those are."""
    held = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    own = column.drop_null()
    values = np.asarray(own.flatten().to_numpy(zero_copy_only=False), float)
    return values.reshape(len(own), -1) if len(own) else np.empty((0, 0)), held


def _scores(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the rows' own squares, which do not change what is nearest."""
    return (centres * centres).sum(1) - 2 * x @ centres.T


def _d2(x: np.ndarray, centres: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    gap = x - centres[cluster]
    return np.einsum("ij,ij->i", gap, gap)


def _with(df: DataFrame, vec: str, added: dict, make) -> DataFrame:
    """df with columns that make(matrix of vectors) gives; null where the vector is null."""
    df = df.drop(*added)
    names, at = [*df.columns, *added], df.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, held = _matrix(b.column(at))
            place = np.full(b.num_rows, -1)
            place[held] = np.arange(len(held))
            take = pa.array(place, mask=place < 0)
            yield pa.RecordBatch.from_arrays([*b.columns, *[c.take(take) for c in make(x)]], names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *[StructField(n, t) for n, t in added.items()]]))


def assign(df: DataFrame, vec: str, centres: list[list[float]]) -> DataFrame:
    """Adds cluster (the nearest centre, the lowest of equal ones) and d2, its squared distance."""
    c = np.array(centres, float)

    def make(x: np.ndarray) -> list[pa.Array]:
        near = _scores(x, c).argmin(1) if len(x) else np.empty(0, int)
        return [pa.array(near, pa.int32()), pa.array(_d2(x, c, near) if len(x) else [], pa.float64())]

    return _with(df, vec, {"cluster": IntegerType(), "d2": DoubleType()}, make)


def centroids(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """(cluster, dim, mean): sums are made inside each task first, a row per (cluster, dimension)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            x, held = _matrix(b.column(1))
            own = np.array(b.column(0).to_pylist(), object)[held]
            for k in set(own) - {None}:
                rows = x[own == k]
                n, s = total.get(k, (0, 0.0))
                total[k] = n + len(rows), s + rows.sum(0)
        for k, (n, s) in total.items():
            d = len(s)
            yield pa.RecordBatch.from_arrays([pa.array([k] * d, kind), pa.array(np.arange(d), pa.int32()), pa.array(s, pa.float64()), pa.array([n] * d, pa.int64())], ["cluster", "dim", "s", "n"])

    rows = df.select(F.col(cluster).alias("cluster"), vec)
    kind = pa.int64() if dict(rows.dtypes)["cluster"] == "bigint" else pa.int32()
    part = rows.mapInArrow(sums, f"cluster {dict(rows.dtypes)['cluster']}, dim int, s double, n long")
    return part.groupBy("cluster", "dim").agg((F.sum("s") / F.sum("n")).alias("mean"))


def to_lists(means: DataFrame, k: int, missing: list[list[float]] | None = None) -> list[list[float]]:
    """k centres (k x dimensions numbers) as lists."""
    out: dict[int, dict[int, float]] = {}
    for r in means.collect():
        out.setdefault(r["cluster"], {})[r["dim"]] = r["mean"]
    return [[v for _, v in sorted(out[c].items())] if c in out else missing[c] for c in range(k)]


def transform(df: DataFrame, vec: str, centres: list[list[float]]) -> DataFrame:
    """Adds distances: to each centre."""
    c = np.array(centres, float)

    def make(x: np.ndarray) -> list[pa.Array]:
        far = np.stack([np.sqrt(((x - own) ** 2).sum(1)) for own in c], 1) if len(x) else np.empty((0, len(c)))
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, len(c), dtype=np.int32)), pa.array(far.ravel()))]

    return _with(df, vec, {"distances": ArrayType(DoubleType())}, make)


def inertia_by_parts(df: DataFrame, vec: str, cut: int, centres: list[list[float]]) -> DataFrame:
    """(sse, inertia_parts): the joint squared error, and the sum of each party's own distances, the
    vector being cut into two parties' parts."""
    c = np.array(centres, float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2)
        for b in batches:
            x, _ = _matrix(b.column(0))
            if len(x):
                near = _scores(x, c).argmin(1)
                parts = _d2(x[:, :cut], c[:, :cut], near), _d2(x[:, cut:], c[:, cut:], near)
                total += sum(p.sum() for p in parts), sum(np.sqrt(p).sum() for p in parts)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], ["sse", "parts"])

    return df.select(vec).mapInArrow(sums, "sse double, parts double").agg(F.sum("sse").alias("sse"), F.sum("parts").alias("inertia_parts"))


def restart_sums(df: DataFrame, vec: str, centres: np.ndarray, label: str | None = None, invalid: int = -1) -> dict[tuple[int, int], tuple[int, float, np.ndarray]]:
    """For each (restart, cluster): rows, squared error and sum of vectors, over centres of shape (restarts,
    clusters, dimensions). All restarts are scored in one product; with a label, rows that have one stay in
    its cluster. A task sends a row per (restart, cluster), and so does the sum of tasks."""
    r, k, d = centres.shape
    flat = centres.reshape(-1, d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sse, total = np.zeros((r, k), np.int64), np.zeros((r, k)), np.zeros((r, k, d))
        for b in batches:
            x, held = _matrix(b.column(0))
            if not len(x):
                continue
            near = _scores(x, flat).reshape(len(x), r, k).argmin(2)
            if label:
                own = np.asarray(b.column(1).fill_null(invalid).to_numpy(zero_copy_only=False))[held]
                near = np.where((own != invalid)[:, None], own[:, None], near)
            for i in range(r):
                d2 = _d2(x, centres[i], near[:, i])
                n[i] += np.bincount(near[:, i], minlength=k)
                sse[i] += np.bincount(near[:, i], d2, minlength=k)
                np.add.at(total[i], near[:, i], x)
        at = np.arange(r * k)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, r * k * d + 1, d, dtype=np.int32)), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at // k, pa.int32()), pa.array(at % k, pa.int32()), pa.array(n.ravel()), pa.array(sse.ravel()), lists], ["restart", "cluster", "n", "sse", "total"])

    part = df.select(vec, *([F.col(label).cast("int")] if label else [])).mapInArrow(sums, "restart int, cluster int, n long, sse double, total array<double>")
    whole = part.groupBy("restart", "cluster").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.array(*[F.sum(F.col("total")[j]) for j in range(d)]).alias("total"))
    return {(x["restart"], x["cluster"]): (x["n"], x["sse"], np.array(x["total"])) for x in whole.where("n > 0").collect()}


@dataclass
class SeededKMeans:
    """Labels in [0, k) seed their cluster; with constrained, labelled rows stay in it. Rows labelled
    `invalid` are free. Clusters without labels begin at rows in a hash order, which differs from restart to
    restart; the restart of least inertia is kept. An empty cluster takes the next row of that order. All
    restarts that still move share one job per iteration. If every cluster has labels, one restart is made."""

    k: int
    id_col: str
    vec: str
    label: str | None = None
    invalid: int = -1
    constrained: bool = False
    max_iter: int = 30
    tol: float = 1e-4
    seed: int = 0
    centres: list[list[float]] | None = None
    n_init: int = 1
    inertias: list[float] | None = None

    def _random(self, df: DataFrame, n: int, restart: int) -> list[list[float]]:
        rows = df.orderBy(hash_order(self.id_col, seed=self.seed + restart), self.id_col).limit(n)  # k or 2k rows
        return [list(map(float, r[self.vec])) for r in rows.collect()]

    def _spare(self, df: DataFrame, restart: int) -> list[list[float]]:
        """2k rows: for the beginning, and for clusters that become empty."""
        own = self._random(df if self.label is None else df.where(F.col(self.label) == self.invalid), 2 * self.k, restart)
        own = own + self._random(df, 2 * self.k - len(own), restart) if len(own) < 2 * self.k else own
        return [own[i % len(own)] for i in range(2 * self.k)]  # fewer rows than that are taken again

    def fit(self, df: DataFrame) -> SeededKMeans:
        df = df.where(F.col(self.vec).isNotNull())
        told = to_lists(centroids(df.where(F.col(self.label) != self.invalid), self.vec, self.label), self.k, [None] * self.k) if self.label else [None] * self.k
        restarts = self.n_init if None in told else 1
        spare = [self._spare(df, i) for i in range(restarts)]
        centres = np.array([[told[c] or spare[i][c] for c in range(self.k)] for i in range(restarts)], float)
        moving, taken = list(range(restarts)), [self.k] * restarts
        fixed = self.label if self.constrained else None
        for _ in range(self.max_iter):
            if not moving:
                break
            sums = restart_sums(df, self.vec, centres[moving], fixed, self.invalid)
            still = []
            for at, i in enumerate(moving):
                new = np.empty_like(centres[i])
                for c in range(self.k):
                    if (at, c) in sums:
                        n, _, total = sums[at, c]
                        new[c] = total / n
                    else:
                        new[c] = spare[i][taken[i] % len(spare[i])]
                        taken[i] += 1
                if np.linalg.norm(new - centres[i]) >= self.tol:
                    still.append(i)
                centres[i] = new
            moving = still
        last = restart_sums(df, self.vec, centres, fixed, self.invalid)
        self.inertias = [sum(sse for (i, _), (_, sse, _) in last.items() if i == own) for own in range(restarts)]
        self.centres = centres[int(np.argmin(self.inertias))].tolist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return assign(df, self.vec, self.centres)

    def transform(self, df: DataFrame) -> DataFrame:
        return transform(df, self.vec, self.centres)

    def score(self, df: DataFrame) -> float:
        """Minus the sum of squared distances."""
        return -self.predict(df).agg(F.sum("d2")).first()[0]
