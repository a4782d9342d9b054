"""Shapley values of the library's own trees.

A leaf of a tree pays its weight if all conditions on its path hold. For a set of known features, a known
feature's conditions hold or not, and an unknown one's hold with the share of training rows that passed them.
The Shapley value of a feature for one leaf then comes from the coefficients of a polynomial: the product,
over the other features of the path, of (share + t if the conditions hold). Leaves of a path of m features
need at most 2 ** m of these, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import comb, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import BoostedTrees, Node, leaf_weight


@dataclass(frozen=True)
class LeafPath:
    """What leads to a leaf: for each feature on the path, in (low, high], and the share of rows that passed
    its conditions; weight: the leaf's, one number for each class."""

    weight: np.ndarray
    features: tuple[int, ...]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaf_paths(tree: Node, features: Sequence[str], lam: float, rate: float) -> list[LeafPath]:
    place, out = {c: i for i, c in enumerate(features)}, []

    def walk(x: Node, held: dict[int, tuple[float, float, float]]) -> None:
        if x.feature is None:
            w = rate * np.atleast_1d(np.array(leaf_weight(x.g, x.h, lam), float))
            out.append(LeafPath(w, tuple(held), *np.array(list(held.values()), float).reshape(-1, 3).T))
            return
        low, high, share = held.get(i := place[x.feature], (-inf, inf, 1.0))
        passed = lambda child: share * child.n / x.n if x.n else 0.0
        walk(x.left, {**held, i: (low, min(high, x.threshold), passed(x.left))})
        walk(x.right, {**held, i: (max(low, x.threshold), high, passed(x.right))})

    walk(tree, {})
    return out


def leaf_shares(holds: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values, for each row of holds (which conditions hold), of a leaf of weight 1."""
    m = len(share)
    ordering = np.array([1 / (m * comb(m - 1, k)) for k in range(m)])  # of sets of k known features
    out = np.empty(holds.shape)
    for i in range(m):
        terms = np.zeros((len(holds), m))
        terms[:, 0] = 1
        for j in range(m):
            if j != i:
                known = terms[:, :-1] * holds[:, [j]]
                terms *= share[j]
                terms[:, 1:] += known
        out[:, i] = (holds[:, i] - share[i]) * (terms @ ordering)
    return out


def row_values(paths: Sequence[LeafPath], x: np.ndarray, classes: int) -> np.ndarray:
    """(rows, features, classes): the sums over all leaves. A missing value passes no lower bound."""
    out = np.zeros((*x.shape, classes))
    for p in paths:
        if not p.features:
            continue
        own = x[:, p.features]
        with np.errstate(invalid="ignore"):
            holds = ((own > p.low) | np.isneginf(p.low)) & ~(own > p.high)
        kinds, which = np.unique(np.packbits(holds, axis=1), axis=0, return_inverse=True)
        kinds = np.unpackbits(kinds, axis=1, count=len(p.features)).astype(float)
        values = leaf_shares(kinds, p.share)[which.ravel()]
        out[:, p.features, :] += values[:, :, None] * p.weight
    return out


def contributions(model: BoostedTrees, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep, base and, under each feature's name, what it adds to the row's raw score: base and the features
    sum to raw(). With several classes all of them are arrays. One pass over the rows, in Arrow batches."""
    features, classes, several = list(model.features), max(1, model.classes), bool(model.classes)
    paths = [p for t in model.trees for p in leaf_paths(t, features, model.params.reg_lambda, model.params.rate)]
    base = sum((p.weight * p.share.prod() for p in paths), np.zeros(classes))
    kind = pa.list_(pa.float64()) if several else pa.float64()

    def column(v: np.ndarray) -> pa.Array:
        if not several:
            return pa.array(np.ascontiguousarray(v[:, 0]))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, classes, dtype=np.int32)), pa.array(np.ascontiguousarray(v).ravel())).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.asarray(b.column(len(keep) + i).to_numpy(zero_copy_only=False), float) for i in range(len(features))])
            values = row_values(paths, x, classes)
            own = [column(np.tile(base, (b.num_rows, 1))), *[column(values[:, i]) for i in range(len(features))]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *own], [*keep, "base", *features])

    told = df.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    number = "array<double>" if several else "double"
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema.fields[: len(keep)]]
    return told.mapInArrow(run, ", ".join([*kept, f"base {number}", *[f"`{c}` {number}" for c in features]]))


def shap_importance(model: BoostedTrees, df: DataFrame) -> DataFrame:
    """(feature, importance): the mean absolute contribution, over rows and classes."""
    rows = contributions(model, df, [])
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + F.abs(v)) / model.classes if model.classes else F.abs(c)
    means = rows.agg(*[F.avg(size(F.col(f"`{c}`"))).alias(c) for c in model.features])
    return means.unpivot([], list(model.features), "feature", "importance")
