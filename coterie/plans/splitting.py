"""Queries on networks that are trained across a cut, with their steps unrolled in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import split
from . import fixtures as fx
from .tabular import query

RATE = 0.5
_DATA = f"{fx.JOINED}, d AS (SELECT id, y, n_lines / 7 AS x0, sum_qty / 300 AS x1 FROM joined)"


def _names(name: str, inputs: int, outputs: int) -> list[str]:
    return [f"{name}{i}{j}" for i in range(inputs + 1) for j in range(outputs)]


def _weights(name: str, inputs: int, outputs: int) -> np.ndarray:
    """Small fixed numbers to begin with, all different."""
    at = sum(map(ord, name))
    return np.array([[round(((at + 3 * i + 5 * j) % 11 - 5) / 8, 3) for j in range(outputs)] for i in range(inputs + 1)])


def _start(shapes: dict[str, tuple[int, int]]) -> str:
    values = [f"{v}::DOUBLE AS {c}" for name, (a, b) in shapes.items() for c, v in zip(_names(name, a, b), _weights(name, a, b).ravel())]
    return f"w0 AS (SELECT {', '.join(values)})"


def _unpivoted(shapes: dict[str, tuple[int, int]], last: int) -> str:
    own = [c for name, (a, b) in shapes.items() for c in _names(name, a, b)]
    return f"SELECT name, round(value, 6) AS value FROM (UNPIVOT w{last} ON {', '.join(own)} INTO NAME name VALUE value)"


def _dense(name: str, inputs: list[str], j: int) -> str:
    return " + ".join([*[f"{x} * {name}{i}{j}" for i, x in enumerate(inputs)], f"{name}{len(inputs)}{j}"])


def _moved(t: int, grads: dict[str, str]) -> str:
    return f"w{t + 1} AS (SELECT " + ", ".join(f"any_value({c}) - {RATE} * avg({g}) AS {c}" for c, g in grads.items()) + f" FROM b{t})"


_U = {"a": (2, 2), "m": (2, 2), "c": (2, 1)}


def _u_steps(steps: int) -> str:
    """A client's layer a, a server's m and the client's head c."""
    out = [_DATA, _start(_U)]
    for t in range(steps):
        out.append(f"f{t} AS (SELECT *, tanh({_dense('a', ['x0', 'x1'], 0)}) AS h0, tanh({_dense('a', ['x0', 'x1'], 1)}) AS h1 FROM d, w{t} WHERE id % 2 = {t % 2})")
        out.append(f"g{t} AS (SELECT *, tanh({_dense('m', ['h0', 'h1'], 0)}) AS k0, tanh({_dense('m', ['h0', 'h1'], 1)}) AS k1 FROM f{t})")
        out.append(f"e{t} AS (SELECT *, 1 / (1 + exp(-({_dense('c', ['k0', 'k1'], 0)}))) - y AS e FROM g{t})")
        out.append(f"q{t} AS (SELECT *, e * c00 * (1 - k0 * k0) AS q0, e * c10 * (1 - k1 * k1) AS q1 FROM e{t})")
        out.append(f"b{t} AS (SELECT *, (q0 * m00 + q1 * m01) * (1 - h0 * h0) AS r0, (q0 * m10 + q1 * m11) * (1 - h1 * h1) AS r1 FROM q{t})")
        grads = {f"c{i}0": f"e * {v}" for i, v in enumerate(("k0", "k1", "1"))}
        grads |= {f"m{i}{j}": f"q{j} * {v}" for i, v in enumerate(("h0", "h1", "1")) for j in range(2)}
        grads |= {f"a{i}{j}": f"r{j} * {v}" for i, v in enumerate(("x0", "x1", "1")) for j in range(2)}
        out.append(_moved(t, grads))
    return f"WITH {', '.join(out)} {_unpivoted(_U, steps)}"


def _two_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.joined(spark, sf).select("id", "y", (F.col("n_lines") / 7).alias("x0"), (F.col("sum_qty") / 300).alias("x1"))


def _told(spark: SparkSession, layers: dict[str, split.Layer]) -> DataFrame:
    rows = [(f"{name}{i}{j}", round(float(x.weights[i, j]), 6)) for name, x in layers.items() for i in range(len(x.weights)) for j in range(x.weights.shape[1])]
    return spark.createDataFrame(rows, "name string, value double")


@query(_u_steps(4))
def split_u_shape_training(spark: SparkSession, sf: str) -> DataFrame:
    """Weights after two epochs of two batches; the client keeps inputs, labels and head, the server sees
    activations and gradients alone."""
    d = _two_inputs(spark, sf)
    layers = {name: split.Layer(party, _weights(name, *_U[name]), act) for name, party, act in (("a", "client", "tanh"), ("m", "server", "tanh"), ("c", "client", "identity"))}
    model = split.SplitTraining({"client": layers["a"]}, [layers["m"], layers["c"]], rate=RATE, batches=2, epochs=2, batch_of=lambda i: i % 2)
    model.fit({"client": split.vectors(d, "id", ["x0", "x1"])}, d.select("id", "y"))
    return _told(spark, layers)


_TWO = {"p": (1, 1), "q": (1, 1), "t": (2, 1)}


def _two_steps(steps: int) -> str:
    """Bottoms p and q of two parties, concatenated, under the top t of the one with labels."""
    out = [_DATA, _start(_TWO)]
    for t in range(steps):
        out.append(f"f{t} AS (SELECT *, tanh({_dense('p', ['x0'], 0)}) AS h0, tanh({_dense('q', ['x1'], 0)}) AS h1 FROM d, w{t})")
        out.append(f"e{t} AS (SELECT *, 1 / (1 + exp(-({_dense('t', ['h0', 'h1'], 0)}))) - y AS e FROM f{t})")
        out.append(f"b{t} AS (SELECT *, e * t00 * (1 - h0 * h0) AS r0, e * t10 * (1 - h1 * h1) AS r1 FROM e{t})")
        grads = {"t00": "e * h0", "t10": "e * h1", "t20": "e", "p00": "r0 * x0", "p10": "r0", "q00": "r1 * x1", "q10": "r1"}
        out.append(_moved(t, grads))
    return f"WITH {', '.join(out)} {_unpivoted(_TWO, steps)}"


@query(_two_steps(2))
def split_two_party_training(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of a network over the features of two tables after two steps."""
    active, lines = fx.active(spark, sf), fx.passive(spark, sf)
    layers = {name: split.Layer(name, _weights(name, *_TWO[name]), "identity" if name == "t" else "tanh") for name in _TWO}
    model = split.SplitTraining({"p": layers["p"], "q": layers["q"]}, [layers["t"]], rate=RATE, epochs=2)
    inputs = {"p": lines.select("id", (F.col("n_lines") / 7).alias("x0")), "q": lines.select("id", (F.col("sum_qty") / 300).alias("x1"))}
    model.fit({name: split.vectors(df, "id", [df.columns[1]]) for name, df in inputs.items()}, active.select("id", "y"))
    return _told(spark, layers)


@query()
def split_u_shape_losses(spark: SparkSession, sf: str) -> DataFrame:
    """(step, loss): the mean loss of each step over five features."""
    scales = {"n_lines": 7, "sum_qty": 300, "avg_disc": 0.1, "avg_tax": 0.1, "sum_price": 400_000}
    d = fx.joined(spark, sf).select("id", "y", *[(F.col(c) / s).alias(c) for c, s in scales.items()])
    bottom, middle, head = split.Layer.random("client", 5, 4, 1), split.Layer.random("server", 4, 3, 2, "relu"), split.Layer.random("client", 3, 1, 3, "identity")
    model = split.SplitTraining({"client": bottom}, [middle, head], rate=0.3, batches=2, epochs=3)
    model.fit({"client": split.vectors(d, "id", list(scales))}, d.select("id", "y"))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate(model.losses)], "step int, loss double")
