"""Horizontal federated learning as grouped dataflow: parameters are rows, clients are groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def fedavg(params: DataFrame, weighted: bool = True) -> DataFrame:
    """params: (client_id, n, name, idx, value). (name, idx, value): the mean over clients, by sample
    count or plain."""
    value = F.sum(F.col("value") * F.col("n")) / F.sum("n") if weighted else F.avg("value")
    return params.groupBy("name", "idx").agg(value.alias("value"))


def personalize(params: DataFrame, shared: DataFrame, keep: float) -> DataFrame:
    """Each client's own values for the last `keep` share of layers, the shared ones elsewhere. Layers are
    ranked by name."""
    layers = params.select("name").distinct()  # a row per layer
    rank = layers.select("name", F.row_number().over(W.orderBy("name")).alias("_rn"), F.count("*").over(W.partitionBy(F.lit(0))).alias("_n"))
    joined = params.join(F.broadcast(rank), "name").join(shared.withColumnRenamed("value", "_shared"), ["name", "idx"])
    local = F.col("_rn") > F.col("_n") - F.floor(F.col("_n") * keep)
    return joined.select("client_id", "n", "name", "idx", F.when(local, F.col("value")).otherwise(F.col("_shared")).alias("value"))


def clip(values: Sequence[Column], bound: float, norm: str = "l2") -> list[Column]:
    """values / max(1, norm / bound)."""
    size = F.sqrt(reduce(add, [v * v for v in values])) if norm == "l2" else reduce(add, [F.abs(v) for v in values])
    return [v / F.greatest(F.lit(1.0), size / bound) for v in values]


def gaussian_noise(epsilon: float, delta: float, rate: float, bound: float, seed: int) -> Column:
    sensitivity = 2 * rate * bound
    return F.randn(seed) * float(np.sqrt(2 * np.log(1.25 / delta)) * sensitivity / epsilon)


def laplace_noise(epsilon: float, rate: float, bound: float, seed: int) -> Column:
    u = F.rand(seed) - 0.5
    return -F.signum(u) * F.log(1 - 2 * F.abs(u)) * (2 * rate * bound / epsilon)


def local_gradients(df: DataFrame, features: Sequence[str], label: str, weights: DataFrame, logistic: bool = False) -> DataFrame:
    """(client_id, n, idx, g): each client's mean gradient at its own weights (client_id, w array). The sum
    runs in Spark, client by client, with partial sums; no client's rows are gathered."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select("client_id", F.col(label).cast("double").alias("y"), x.alias("x")).join(F.broadcast(weights), "client_id")
    score = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rest = F.col("y") - ((1 / (1 + F.exp(-score))) if logistic else score)
    rows = rows.withColumn("r", rest)
    return rows.select("client_id", "r", F.posexplode("x").alias("idx", "v")).groupBy("client_id", "idx").agg(F.count("*").alias("n"), (-F.avg(F.col("r") * F.col("v"))).alias("g"))


def train(df: DataFrame, features: Sequence[str], label: str, rounds: int, local_steps: int = 1, rate: float = 0.1, method: str = "fedavg", mu: float = 0.0, logistic: bool = False, squared_prox: bool = False, bound: float | None = None, noise: tuple[str, float, float] | None = None, seed: int = 0) -> list[float]:
    """Federated training of a linear model with full local batches: fedavg, fedavg_mean, fedprox or
    scaffold. What reaches the driver is one weight vector per client and step. bound clips each client's
    gradient to that l2 norm; noise = (gaussian or laplace, epsilon, delta) is then added to what it sends."""
    rng = np.random.default_rng(seed)
    spark, m = df.sparkSession, len(features)
    clients = sorted(r["client_id"] for r in df.select("client_id").distinct().collect())
    id_type = dict(df.dtypes)["client_id"]
    shared = np.zeros(m)
    control, own_control = np.zeros(m), {c: np.zeros(m) for c in clients}
    for _ in range(rounds):
        w = {c: shared.copy() for c in clients}
        n: dict = {}
        for _ in range(local_steps):
            table = spark.createDataFrame([(c, w[c].tolist()) for c in clients], f"client_id {id_type}, w array<double>")
            g = {c: np.zeros(m) for c in clients}
            for r in local_gradients(df, features, label, table, logistic).collect():
                g[r["client_id"]][r["idx"]], n[r["client_id"]] = r["g"], r["n"]
            for c in clients:
                step = g[c]
                if bound is not None:
                    step = step / max(1.0, np.linalg.norm(step) / bound)
                if method == "fedprox":
                    away = w[c] - shared
                    size = np.linalg.norm(away)
                    step = step + mu * (away if squared_prox else away / (2 * size) if size else 0 * away)
                elif method == "scaffold":
                    step = step + control - own_control[c]
                w[c] = w[c] - rate * step
        if noise is not None:
            kind, epsilon, delta = noise
            reach = 2 * rate * (bound if bound is not None else 1.0)
            for c in clients:
                w[c] = w[c] + (rng.normal(0, np.sqrt(2 * np.log(1.25 / delta)) * reach / epsilon, m) if kind == "gaussian" else rng.laplace(0, reach / epsilon, m))
        if method == "scaffold":
            new = {c: own_control[c] - control + (shared - w[c]) / (local_steps * rate) for c in clients}
            control = control + sum(new[c] - own_control[c] for c in clients) / len(clients)
            own_control = new
        share = {c: (1 / len(clients) if method == "fedavg_mean" else n[c] / sum(n.values())) for c in clients}
        shared = sum(share[c] * w[c] for c in clients)
    return shared.tolist()


def inference(df: DataFrame, features: Sequence[str], weights: Sequence[Sequence[float]]) -> DataFrame:
    """df with prediction (the class of greatest linear score, the first of equal ones) and loss (softmax
    cross entropy against `label`)."""
    from ..functions.losses import multi_cross_entropy

    scores = [reduce(add, [F.col(c) * F.lit(float(w)) for c, w in zip(features, own, strict=True)]) for own in weights]
    loss, _, _ = multi_cross_entropy(F.col("label"), scores)
    best = F.array_position(F.array(*scores), F.greatest(*scores)) - 1
    return df.withColumn("prediction", best.cast("int")).withColumn("loss", loss)


def score(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, accuracy, loss) of what inference gives."""
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return predicted.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg("loss").alias("loss"))


def validate(df: DataFrame, features: Sequence[str], weights: Sequence[Sequence[float]]) -> DataFrame:
    """(n, loss, accuracy, weighted_f1, auc) of a linear model of several classes against `label`, one row; auc is
    that of class 1's probability if there are two classes, else null."""
    from . import metrics

    told = inference(df, features, weights)
    sums = told.agg(F.count("*").alias("n"), F.avg("loss").alias("loss"))
    classes = metrics.multiclass_metrics(told, "label", "prediction").select(F.col("acc").alias("accuracy"), "weighted_f1")
    if len(weights) == 2:
        gap = reduce(add, [F.col(c) * F.lit(float(b) - float(a)) for c, a, b in zip(features, *weights, strict=True)])
        area = metrics.auc(told.select(F.col("label").alias("y"), F.round(1 / (1 + F.exp(-gap)), 12).alias("p"))).select("auc")
    else:
        area = df.sparkSession.createDataFrame([(None,)], "auc double")
    one = lambda d: d.withColumn("_one", F.lit(1))  # noqa: E731  (a row each)
    return one(sums).join(one(classes), "_one").join(one(area), "_one").drop("_one")


def iid_clients(df: DataFrame, id_col: str, clients: int, seed: int = 0) -> DataFrame:
    """Adds client_id: rows in the order of a hash, dealt out in turn."""
    from ..functions.ordered import row_numbers
    from .select import hash_order

    ranked = row_numbers(df.withColumn("_h", hash_order(id_col, seed=seed)), "_h", [id_col], "_rn")
    return ranked.withColumn("client_id", ((F.col("_rn") - 1) % clients).cast("int")).drop("_h", "_rn")
