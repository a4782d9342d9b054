"""Means and scatter matrices of long vectors: a task adds up one matrix, and executors merge them in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that one product takes.
BLOCK = 4096


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _sum(rows: DataFrame, vec: str, one: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over blocks of rows of one(block), a flat array of a length that depends on the dimensions alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = one(_rows(b.column(0).slice(at, BLOCK)))
                total = part if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([b"" if total is None else total.tobytes()], pa.binary())], ["m"])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b if len(a) and len(b) else (a if len(a) else b)

    parts = rows.select(vec).mapInArrow(run, "m binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
    n = parts.getNumPartitions()
    return parts.treeReduce(merge, depth=2 if n <= 10_000 else 3) if n else np.empty(0)


def moments(rows: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, scatter) of a column of vectors without nulls: scatter is the matrix of sums of products of
    centred values. Two passes, so that large means cost no digits; dimensions squared numbers reach the driver."""
    first = _sum(rows, vec, lambda x: np.r_[float(len(x)), x.sum(0)])
    if not len(first):
        return 0, np.empty(0), np.empty((0, 0))
    mean = first[1:] / first[0]

    def product(x: np.ndarray) -> np.ndarray:
        x = x - mean
        return (x.T @ x).ravel()

    d = len(mean)
    return int(first[0]), mean, _sum(rows, vec, product).reshape(d, d)
