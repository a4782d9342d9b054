"""Tables, models and metrics to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """parquet, csv (with a header) or json."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "csv": lambda p: writer.option("header", True).csv(p), "json": writer.json}[kind](path)


def save_weights(spark: SparkSession, weights: dict[str, float], path: str) -> None:
    spark.createDataFrame(sorted(weights.items()), "name string, value double").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, float]:
    return {r["name"]: r["value"] for r in spark.read.parquet(path).collect()}


def save_layers(spark: SparkSession, layers: dict, epoch: int, path: str) -> None:
    """Named arrays of any shape (a network's weights, an optimizer's state) and the epoch."""
    import numpy as np

    rows = [(epoch, name, list(np.shape(x)), np.asarray(x, float).ravel().tolist()) for name, x in sorted(layers.items())]
    spark.createDataFrame(rows, "epoch int, name string, shape array<int>, data array<double>").write.mode("overwrite").parquet(path)


def load_layers(spark: SparkSession, path: str) -> tuple[dict, int]:
    import numpy as np

    rows = spark.read.parquet(path).collect()  # a row per layer
    return {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in rows}, rows[0]["epoch"]


def save_trees(model, spark: SparkSession, path: str) -> None:
    model.table(spark).write.mode("overwrite").parquet(path)


def load_trees(spark: SparkSession, path: str, reg_lambda: float = 0.1) -> list:
    """Trees for prediction, from their rows."""
    from ..operators.trees import Node

    rows: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(path).collect():
        rows.setdefault(r["tree"], {})[r["node"]] = r

    def make(own: dict, k: int) -> Node:
        r = own[k]
        if "weights" in r:
            both = [-w * (c + reg_lambda) for w, c in zip(r["weights"], r["covers"], strict=True)], list(r["covers"])
        else:
            both = -r["weight"] * (r["cover"] + reg_lambda), r["cover"]
        x = Node(k, *both, r["n"], r["depth"], r["feature"], r["threshold"], r["gain"])
        if x.feature is not None:
            x.left, x.right = make(own, 2 * k + 1), make(own, 2 * k + 2)
        return x

    return [make(own, 0) for _, own in sorted(rows.items())]


def append_metrics(spark: SparkSession, path: str, run: str, step: int, values: dict[str, float]) -> None:
    """One row per metric: the log behind curves over epochs."""
    spark.createDataFrame([(run, step, k, float(v)) for k, v in values.items()], "run string, step int, metric string, value double").write.mode("append").parquet(path)
