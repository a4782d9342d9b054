"""Training of a network that is cut between parties.

A network is a chain of dense layers, each held by one party; its first layers may be several, one for each
party with features, whose outputs are joined. Rows are named by an id. In a step, a party applies its layer to
its rows and sends (id, output); the next one joins that to what it holds. The holder of the labels turns
the last output into a loss and sends back (id, gradient of the output); each party in turn sums its weights'
gradients inside its tasks, moves its weights and sends the gradient of its input on. So what crosses a cut is
a table of activations or of their gradients, and nobody's task sees weights, features or labels of another.

A chain of a client's layer, a server's, and a client's again is the U shape, in which labels stay with the
client; a client's layer and a server's top is the plain cut, in which the server has them.

Exchanged tables are written, since both passes read them; the driver holds weights alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import discard, stash

Slope = Callable[[np.ndarray], np.ndarray]

#: Activations with their slopes in terms of the output.
ACTIVATIONS: dict[str, tuple[Slope, Slope]] = {"tanh": (np.tanh, lambda o: 1 - o * o), "identity": (lambda z: z, np.ones_like), "relu": (lambda z: np.maximum(z, 0), lambda o: (o > 0).astype(float))}


@dataclass
class Layer:
    """weights: (inputs + 1) x outputs, the last row the bias."""

    party: str
    weights: np.ndarray
    activation: str = "tanh"

    @classmethod
    def random(cls, party: str, inputs: int, outputs: int, seed: int, activation: str = "tanh") -> Layer:
        rng = np.random.default_rng(seed)
        return cls(party, rng.standard_normal((inputs + 1, outputs)) / np.sqrt(inputs + 1), activation)


def _rows(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]) if x.ndim == 2 else 1, dtype=np.int32)), pa.array(x.ravel(), pa.float64())) if x.size else pa.array([], pa.list_(pa.float64()))


def _with_bias(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.ones(len(x))]


def forward(rows: DataFrame, layer: Layer) -> DataFrame:
    """rows: (id, x). Adds out, what the layer's party sends on."""
    w, act = layer.weights, ACTIVATIONS[layer.activation][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column(1))
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(act(_with_bias(x) @ w) if len(x) else x)], ["id", "x", "out"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, x array<double>, out array<double>")


def backward(held: DataFrame, layer: Layer) -> DataFrame:
    """held: (id, x, out, d), d the gradient of out. (id, d): the gradient of x, what is sent back."""
    w, slope = layer.weights, ACTIVATIONS[layer.activation][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, d = _rows(b.column(2)), _rows(b.column(3))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists((d * slope(out)) @ w[:-1].T if len(out) else out)], ["id", "d"])

    return held.mapInArrow(run, f"id {dict(held.dtypes)['id']}, d array<double>")


def weight_gradient(held: DataFrame, layer: Layer) -> np.ndarray:
    """The sum over rows of the gradient of the weights; a task sends one matrix."""
    shape, slope = layer.weights.shape, ACTIVATIONS[layer.activation][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += _with_bias(_rows(b.column(1))).T @ (_rows(b.column(3)) * slope(_rows(b.column(2))))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    out = np.zeros(shape)
    for r in held.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # a row per weight
        out.ravel()[r["k"]] = r["v"]
    return out


def _layer_back(layer: Layer) -> Callable[[pa.RecordBatch], tuple]:
    """Of batches (id, x, d), d the gradient of the layer's output: the gradients of weights and of x."""
    w, (act, slope) = layer.weights, ACTIVATIONS[layer.activation]

    def one(b: pa.RecordBatch) -> tuple:
        x = _with_bias(_rows(b.column(1)))
        d = _rows(b.column(2)) * slope(act(x @ w))
        return x.T @ d, d @ w[:-1].T, 0.0

    return one


def _bottom_gradient(met: DataFrame, layer: Layer) -> np.ndarray:
    """The summed gradient of the weights of (id, x, d); nothing is sent on."""
    one, shape = _layer_back(layer), layer.weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += one(b)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    out = np.zeros(shape)
    for r in met.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # a row per weight
        out.ravel()[r["k"]] = r["v"]
    return out


def _passed_back(met: DataFrame, name: str, shape: tuple[int, int], one: Callable[[pa.RecordBatch], tuple]) -> tuple[DataFrame, np.ndarray, float, int]:
    """One pass over met, which begins with an id: one(batch) gives the gradient of the weights, that of the input
    by row, and the loss. (id, d) as a written table, the summed gradient, loss and rows; a task sends its sums
    as a row without d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(shape), 0.0, 0
        for b in batches:
            if b.num_rows:
                g, d, own = one(b)
                total, loss, n = total + g, loss + own, n + b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(d), pa.nulls(b.num_rows, pa.list_(pa.float64()))], ["id", "d", "sums"])
        sums = pa.array([[*total.ravel(), loss, float(n)]], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.list_(pa.float64())), sums], ["id", "d", "sums"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(met.schema["id"].dataType)
    told = stash(met.mapInArrow(run, f"id {dict(met.dtypes)['id']}, d array<double>, sums array<double>"), name)
    out = np.zeros(shape[0] * shape[1] + 2)
    for r in told.where("sums is not null").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():  # a row per weight
        out[r["k"]] = r["v"]
    d = told.where("sums is null").select("id", "d")
    d._stashed = told._stashed
    return d, out[:-2].reshape(shape), float(out[-2]), int(out[-1])


@dataclass
class SplitTraining:
    """bottoms: the layers that read features, by party; chain: what follows, the last one with one output
    and activation identity, whose sigmoid is the probability of label 1. merge: the bottoms' outputs are
    concatenated or added. Batches are dealt by a hash of the id, alike at all parties."""

    bottoms: dict[str, Layer]
    chain: list[Layer]
    merge: str = "concat"
    rate: float = 0.1
    batches: int = 1
    epochs: int = 1
    batch_of: Callable[[Column], Column] | None = None
    losses: list[float] = field(default_factory=list)

    def _batch(self, df: DataFrame, k: int) -> DataFrame:
        if self.batches == 1:
            return df
        own = self.batch_of(F.col("id")) if self.batch_of else F.pmod(F.xxhash64("id"), F.lit(self.batches))
        return df.where(own == k)

    def _first(self, inputs: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
        """What each bottom's party holds, and the joined outputs (id, x)."""
        held, x = {}, None
        for name, layer in self.bottoms.items():
            held[name] = stash(forward(inputs[name], layer), "held")
            sent = held[name].select("id", F.col("out").alias("x" if x is None else "_out"))
            if x is None:
                x = sent
                continue
            both = F.concat("x", "_out") if self.merge == "concat" else F.zip_with("x", "_out", lambda a, b: a + b)
            x = x.join(sent, "id").select("id", both.alias("x"))
        return held, x

    def step(self, inputs: dict[str, DataFrame], labels: DataFrame) -> float:
        """One step over (id, x) of each party and (id, y); gives the mean loss before it. A party keeps what it
        received, and works its output out again when the gradient comes."""
        x = None
        for name, layer in self.bottoms.items():
            sent = forward(inputs[name], layer).select("id", F.col("out").alias("x" if x is None else "_out"))
            if x is None:
                x = sent
                continue
            both = F.concat("x", "_out") if self.merge == "concat" else F.zip_with("x", "_out", lambda a, b: a + b)
            x = x.join(sent, "id").select("id", both.alias("x"))
        kept = []
        for layer in self.chain[:-1]:
            kept.append(stash(x, "received"))
            x = forward(kept[-1], layer).select("id", F.col("out").alias("x"))
        head, top = self.chain[-1], ACTIVATIONS[self.chain[-1].activation]

        def at_labels(b: pa.RecordBatch) -> tuple:
            x, y = _with_bias(_rows(b.column(1))), np.asarray(b.column(2).to_numpy(zero_copy_only=False), float)
            out = top[0](x @ head.weights)
            s = out[:, 0]
            d = (1 / (1 + np.exp(-np.clip(s, -700, 700))) - y)[:, None] * top[1](out)
            # ln(1 + e^s) - y s, in a form that does not overflow
            return x.T @ d, d @ head.weights[:-1].T, (np.maximum(s, 0) - y * s + np.log1p(np.exp(-np.abs(s)))).sum()

        d, g, loss, n = _passed_back(x.join(labels.select("id", F.col("y").cast("double").alias("y")), "id"), "gradient", head.weights.shape, at_labels)
        moves, used = [(head, g)], [d, *kept]
        if n:
            for layer, own in zip(reversed(self.chain[:-1]), reversed(kept), strict=True):
                d, g, _, _ = _passed_back(own.join(d, "id"), "gradient", layer.weights.shape, _layer_back(layer))
                moves.append((layer, g))
                used.append(d)
            at = 0
            for name, layer in self.bottoms.items():
                width = layer.weights.shape[1]
                own = d if self.merge == "add" else d.select("id", F.slice("d", at + 1, width).alias("d"))
                at += width
                moves.append((layer, _bottom_gradient(inputs[name].join(own, "id"), layer)))
            for layer, g in moves:
                layer.weights = layer.weights - self.rate * g / n
        discard(*used)
        return loss / n if n else 0.0

    def fit(self, inputs: dict[str, DataFrame], labels: DataFrame) -> SplitTraining:
        """inputs: (id, x) by party, x an array of doubles; labels: (id, y). Rows that a party lacks take no
        part."""
        named = {x: stash(df, "inputs") for x, df in inputs.items()}  # what they come from runs once
        own = stash(labels, "labels")
        for _ in range(self.epochs):
            for k in range(self.batches):
                self.losses.append(self.step({x: self._batch(df, k) for x, df in named.items()}, self._batch(own, k)))
        discard(own, *named.values())
        return self

    def predict(self, inputs: dict[str, DataFrame]) -> DataFrame:
        """(id, probability)."""
        _, x = self._first(inputs)
        for layer in self.chain:
            x = forward(x, layer).select("id", F.col("out").alias("x"))
        return x.select("id", (1 / (1 + F.exp(-F.col("x")[0]))).alias("probability"))


def vectors(df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """(id, x) of columns."""
    return df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
