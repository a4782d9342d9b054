"""Split networks between parties, their checks and their defences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


@dataclass
class SplitNetwork:
    """One hidden layer per party (bottom), joined by `concat` or `add`, and a logistic top at the active
    party. A step is a full batch: partitions compute partial gradients with numpy, Spark sums them, the
    driver holds the weights alone."""

    parties: Sequence[Sequence[str]]
    label: str
    hidden: int = 8
    merge: str = "concat"
    rate: float = 0.5
    epochs: int = 20
    seed: int = 0
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def _init(self) -> None:
        rng = np.random.default_rng(self.seed)
        width = self.hidden * (len(self.parties) if self.merge == "concat" else 1)
        self.weights = {f"b{k}": rng.standard_normal((len(p) + 1, self.hidden)) / np.sqrt(len(p) + 1) for k, p in enumerate(self.parties)}
        self.weights["top"] = rng.standard_normal(width + 1) / np.sqrt(width + 1)

    @staticmethod
    def _forward(w: dict, xs: list[np.ndarray], merge: str) -> tuple:
        ones = [np.c_[x, np.ones(len(x))] for x in xs]
        hs = [np.tanh(x @ w[f"b{k}"]) for k, x in enumerate(ones)]
        h = np.concatenate(hs, 1) if merge == "concat" else sum(hs)
        h = np.c_[h, np.ones(len(h))]
        return ones, hs, h, 1 / (1 + np.exp(-(h @ w["top"])))

    def fit(self, df: DataFrame) -> SplitNetwork:
        self._init()
        columns, parties, merge, hidden, label = [c for p in self.parties for c in p], self.parties, self.merge, self.hidden, self.label
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias(label))
        for _ in range(self.epochs):
            w = self.weights

            def partial(batches):
                total: dict = {}
                n = 0
                for b in batches:
                    if not len(b):
                        continue
                    ones, hs, h, p = SplitNetwork._forward(w, [b[list(c)].to_numpy() for c in parties], merge)
                    d = p - b[label].to_numpy()
                    n += len(b)
                    total["top"] = total.get("top", 0) + h.T @ d
                    back = np.outer(d, w["top"][:-1])
                    for k, hk in enumerate(hs):
                        own = back[:, k * hidden : (k + 1) * hidden] if merge == "concat" else back
                        total[f"b{k}"] = total.get(f"b{k}", 0) + ones[k].T @ (own * (1 - hk * hk))
                out = [(name, i, float(v)) for name, g in total.items() for i, v in enumerate(np.ravel(g))] + ([("n", 0, float(n))] if n else [])
                yield pd.DataFrame(out, columns=["name", "i", "v"])

            sums = rows.mapInPandas(partial, "name string, i int, v double").groupBy("name", "i").agg(F.sum("v").alias("v")).toPandas()
            n = float(sums.loc[sums.name == "n", "v"].iloc[0])
            self.weights = {name: v - self.rate * sums[sums.name == name].sort_values("i").v.to_numpy().reshape(v.shape) / n for name, v in w.items()}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        w, parties, merge = self.weights, self.parties, self.merge
        schema = df.withColumn("probability", F.lit(0.0)).schema

        def run(batches):
            for b in batches:
                yield b.assign(probability=SplitNetwork._forward(w, [b[list(c)].to_numpy(float) for c in parties], merge)[3] if len(b) else pd.Series(dtype=float))

        return df.mapInPandas(run, schema)


def top_k_accuracy(df: DataFrame, scores: str, label: str, k: int) -> DataFrame:
    """(label, n, hits): per class, rows whose class is among the k greatest scores (the lower class
    number first among equal scores)."""
    own = F.get(F.col(scores), F.col(label))
    above = F.size(F.filter(F.transform(F.col(scores), lambda s, i: (s > own) | ((s == own) & (i < F.col(label)))), lambda x: x))
    hits = df.select(F.col(label).alias("label"), (above < k).cast("int").alias("hit"))
    return hits.groupBy("label").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


def validate(df: DataFrame, scores: str, label: str, classes: int, top: int = 5) -> DataFrame:
    """(acc, auc, topk_acc) of an array of class scores, one row: the share of rows whose class has the greatest
    score (the first of equal ones), the area under the curve of class 1's sigmoid if there are two classes,
    else 0, and the share of rows whose class is among the `top` greatest."""
    from . import metrics

    hits = [top_k_accuracy(df, scores, label, k).agg((F.sum("hits") / F.sum("n")).alias(name)) for k, name in ((1, "acc"), (top, "topk_acc"))]
    if classes == 2:
        area = metrics.auc(df.select(F.col(label).alias("y"), (1 / (1 + F.exp(-F.col(scores)[1]))).alias("p"))).select("auc")
    else:
        area = df.sparkSession.createDataFrame([(0.0,)], "auc double")
    one = lambda d: d.withColumn("_one", F.lit(1))  # noqa: E731  (a row each)
    return one(hits[0]).join(one(area), "_one").join(one(hits[1]), "_one").drop("_one")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): 1 / n of the class, scaled to sum to the number of classes."""
    w = W.partitionBy(F.lit(0))  # a row per class
    counts = df.groupBy(F.col(label).alias("label")).count()
    return counts.select("label", (1 / F.col("count") / F.sum(1 / F.col("count")).over(w) * F.count("*").over(w)).alias("weight"))


def norms_by_label(df: DataFrame, vec: str, label: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(F.transform(F.col(vec), lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.avg(norm).alias("mean_norm"))


def prune(vec: Column, share: float) -> Column:
    """All but the greatest share of entries (by absolute value) set to 0."""
    keep = F.ceil(F.size(vec) * F.lit(1 - share)).cast("int")
    least = F.element_at(F.reverse(F.array_sort(F.transform(vec, lambda x: F.abs(x)))), F.greatest(keep, F.lit(1)))
    return F.transform(vec, lambda x: F.when(F.abs(x) >= least, x).otherwise(F.lit(0.0)))


def quantize(x: Column, bins: int, bound: float) -> Column:
    """Clipped to [-bound, bound] and rounded, half to even, to multiples of 2 bound / bins."""
    step = 2 * bound / bins
    return F.bround(F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)) / step) * step


def distance_correlation(df: DataFrame, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """(dcor) of two parties' columns on squared Euclidean distances. Double centring turns those into minus
    twice the Gram matrix of centred rows, so the sums over all pairs of rows equal sums of squared
    covariances: linear in the rows."""
    rows = df.select(F.array(*[F.col(c).cast("double") for c in (*a, *b)]).alias("_v"))
    return distance_correlation_vectors(rows, "_v", len(a))


def distance_correlation_vectors(df: DataFrame, vec: str, cut: int) -> DataFrame:
    """(dcor) as above for two parties' parts of a vector of doubles, cut at `cut`. Each task adds up one
    matrix of centred products, so many dimensions need no aggregate per pair of them."""
    means = df.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m")).orderBy("dim").collect()
    mean = np.array([r["m"] for r in means])
    d = len(mean)

    def products(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], ["k", "s"])

    own = F.col("k") % d < cut
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("s") * F.col("s"))), F.lit(0.0))
    sums = df.select(vec).mapInArrow(products, "k long, s double").groupBy("k").agg(F.sum("s").alias("s"))
    left = F.floor(F.col("k") / d) < cut
    return sums.agg(part(left & ~own).alias("ab"), part(left & own).alias("aa"), part(~left & ~own).alias("bb")).select(F.sqrt(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("dcor"))


def label_dp(label: Column, n_classes: int, epsilon: float, seed: int) -> Column:
    """Randomised response: keeps the label with the odds that epsilon allows, else one of the others."""
    stay = float(np.exp(epsilon) / (np.exp(epsilon) + n_classes - 1))
    other = F.floor(F.rand(seed + 1) * (n_classes - 1)).cast("int")
    return F.when(F.rand(seed) < stay, label).otherwise(F.when(other >= label, other + 1).otherwise(other)).cast("int")


def u_shaped(df: DataFrame, inputs: Sequence[str], bottom: Sequence[Sequence[float]], middle: Sequence[Sequence[float]], head: Sequence[float], label: str) -> DataFrame:
    """A forward pass of a network cut twice: the client keeps bottom and head layers and the label, the
    server sees hidden values only. Adds probability and loss; layers are weights without bias, tanh between."""
    rows = lambda xs, layer: [F.tanh(sum((x * F.lit(float(w)) for x, w in zip(xs[1:], own[1:], strict=True)), xs[0] * F.lit(float(own[0])))) for own in layer]
    client = df.withColumn("_sent", F.array(*rows([F.col(c) for c in inputs], bottom)))
    hidden = [F.col("_sent")[k] for k in range(len(bottom))]
    server = client.withColumn("_back", F.array(*rows(hidden, middle)))
    top = [F.col("_back")[k] for k in range(len(middle))]
    score = sum((x * F.lit(float(w)) for x, w in zip(top[1:], head[1:], strict=True)), top[0] * F.lit(float(head[0])))
    p = 1 / (1 + F.exp(-score))
    y = F.col(label)
    return server.withColumn("probability", p).withColumn("loss", -(y * F.log(F.col("probability")) + (1 - y) * F.log(1 - F.col("probability")))).drop("_sent", "_back")


def encrypted_layer(df: DataFrame, vec: str, weights: Sequence[float], key, noise: float = 0.0) -> DataFrame:
    """Adds output: the dot product of vec with weights that its owner sent encrypted. The computing party adds
    its own noise under encryption, so that decryption shows only the noisy sum, and takes it off again."""
    from ..functions import crypto

    sent = [key.encrypt(float(w)) for w in weights]
    cipher = crypto.dot_encrypted(F.concat(F.col(vec), F.array(F.lit(float(noise)))), [*sent, key.encrypt(1.0)], key)
    return df.withColumn("output", crypto.decrypt_column(cipher, key, products=1) - F.lit(float(noise)))
