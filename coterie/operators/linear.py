"""Linear and logistic regression and score cards over the joined columns of all parties.

Weights are literals; a step is one aggregate over the table (a sum per feature), so lineage never grows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.losses import sigmoid
from ..functions.ordered import row_numbers
from ..shared import discard, stash
from .select import hash_order


def dot(features: Sequence[str], weights: Sequence[float]) -> Column:
    return reduce(add, [F.col(c) * F.lit(float(w)) for c, w in zip(features, weights, strict=True)])


def gradient(df: DataFrame, features: Sequence[str], label: str, weights: Sequence[float], logistic: bool = False, penalty: str = "none", reg_lambda: float = 0.0) -> list[float]:
    """-mean(residue * x) plus the penalty's slope."""
    score = dot(features, weights)
    rest = F.col(label) - (sigmoid(score) if logistic else score)
    row = df.withColumn("_r", rest).agg(*[F.avg(F.col("_r") * F.col(c)).alias(c) for c in features]).first()
    slope = {"none": lambda w: 0.0, "l1": lambda w: reg_lambda * float(np.sign(w)), "l2": lambda w: reg_lambda * w}[penalty]
    return [-row[c] + slope(w) for c, w in zip(features, weights, strict=True)]


def with_batch(df: DataFrame, id_col: str, batch_size: int, epoch: int) -> DataFrame:
    """Adds _batch: batches of batch_size rows in an order that a hash of id and epoch gives."""
    ranked = row_numbers(df.withColumn("_h", hash_order(id_col, seed=epoch)), "_h", [id_col], "_rn").drop("_h")
    return ranked.withColumn("_batch", F.expr(f"(_rn - 1) div {batch_size}")).drop("_rn")


@dataclass
class LinearModel:
    """Gradient descent; batch_size -1 takes the whole table at each step. With a validating table, history has
    its measures after each epoch, and the weights kept are the last ones that were better than all before
    them in any of best_by: loss, and acc, auc and ks of a logistic model or r2 of a plain one."""

    features: Sequence[str]
    label: str
    id_col: str = "id"
    logistic: bool = False
    epochs: int = 10
    learning_rate: float = 0.1
    batch_size: int = -1
    penalty: str = "none"
    reg_lambda: float = 0.0
    weights: list[float] | None = None
    history: list[dict] = field(default_factory=list)
    best_by: Sequence[str] = ("loss",)

    def fit(self, df: DataFrame, validate: DataFrame | None = None) -> LinearModel:
        w = list(self.weights or [0.0] * len(self.features))
        kept, best = None, {}
        for epoch in range(self.epochs):
            if self.batch_size < 0:
                parts = [df]
            else:
                # written once an epoch, a folder per batch, so that a batch reads its own rows only
                batched = stash(with_batch(df, self.id_col, self.batch_size, epoch), "batches", by="_batch")
                parts = [batched.where(F.col("_batch") == b) for b in range(math.ceil(df.count() / self.batch_size))]
            for part in parts:
                g = gradient(part, self.features, self.label, w, self.logistic, self.penalty, self.reg_lambda)
                w = [a - self.learning_rate * b for a, b in zip(w, g, strict=True)]
            if self.batch_size >= 0:
                discard(batched)
            if validate is not None:
                told = self.measures(validate, w)
                self.history.append({"epoch": epoch, **told})
                for name in self.best_by:
                    value = -told[name] if name == "loss" else told[name]
                    if value is not None and (name not in best or value > best[name]):
                        best[name], kept = value, w
        self.weights = kept or w
        return self

    def measures(self, df: DataFrame, weights: Sequence[float] | None = None) -> dict[str, float]:
        """The mean loss, and what best_by asks for besides."""
        from . import metrics

        w = self.weights if weights is None else weights
        out = {"loss": self.loss(df, w)}
        wanted = set(self.best_by) - {"loss"}
        if unknown := wanted - ({"acc", "auc", "ks"} if self.logistic else {"r2"}):
            raise ValueError(f"no measures {sorted(unknown)} of this model")
        score = dot(self.features, w)
        rows = df.select(F.col(self.label).alias("y"), (sigmoid(score) if self.logistic else score).alias("p"))
        if "acc" in wanted:
            out["acc"] = rows.agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
        if "auc" in wanted:
            out["auc"] = metrics.auc(rows).first()["auc"]
        if "ks" in wanted:
            out["ks"] = metrics.ks_value(rows).first()["ks"]
        if "r2" in wanted:
            out["r2"] = metrics.regression_metrics(rows, "y", "p").first()["r2"]
        return out

    def loss(self, df: DataFrame, weights: Sequence[float] | None = None) -> float:
        """Mean loss and the penalty."""
        w = self.weights if weights is None else weights
        score, y = dot(self.features, w), F.col(self.label)
        each = F.log1p(F.exp(-F.abs(score))) + F.greatest(score, F.lit(0.0)) - y * score if self.logistic else (y - score) * (y - score)
        extra = {"none": 0.0, "l1": self.reg_lambda * sum(map(abs, w)), "l2": self.reg_lambda / 2 * sum(x * x for x in w)}[self.penalty]
        return df.agg(F.avg(each)).first()[0] + extra

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        score = dot(self.features, self.weights)
        if not self.logistic:
            return df.withColumn("prediction", score)
        out = df.withColumn("probability", sigmoid(score))
        return out.withColumn("prediction", (F.col("probability") > threshold).cast("int"))


def score_card(df: DataFrame, features: Sequence[str], weights: Sequence[float], intercept: float, p: float = 20 / math.log(2), q: float = 600 - 20 * math.log(50) / math.log(2)) -> DataFrame:
    """Adds points: a base of round(q + p * intercept) and, per feature, round(w * x * p), all half-even."""
    base = float(round(q + p * intercept))
    points = reduce(add, [F.bround(F.col(c) * F.lit(float(w)) * F.lit(p)) for c, w in zip(features, weights, strict=True)])
    return df.withColumn("points", F.lit(base) + points)
