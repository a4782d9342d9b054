"""Feature transforms. Each takes a table and feature names and returns a table; fitted numbers are a few
scalars per feature, read with one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale(df: DataFrame, features: Sequence[str], stats_of: DataFrame | None = None) -> DataFrame:
    """z-scores with the population deviation; a constant column becomes 0. stats_of: the table whose
    means and deviations are used (a training table), df itself by default."""
    s = (stats_of or df).agg(*[x for c in features for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in features})


def normalize(df: DataFrame, features: Sequence[str], norm: str = "l2") -> DataFrame:
    """Rows scaled to norm one (l1, l2 or max); a row of zeros stays."""
    size = {
        "l1": lambda: reduce(add, [F.abs(F.col(c)) for c in features]),
        "l2": lambda: F.sqrt(reduce(add, [F.col(c) * F.col(c) for c in features])),
        "max": lambda: F.greatest(*[F.abs(F.col(c)) for c in features]) if len(features) > 1 else F.abs(F.col(features[0])),
    }[norm]()
    return df.withColumn("_n", size).withColumns({c: F.when(F.col("_n") == 0, F.col(c)).otherwise(F.col(c) / F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_n"))) for c in features}).drop("_n")


def parse_label(df: DataFrame, label: str, negative: int = 0) -> DataFrame:
    return df.withColumn(label, F.when(F.col(label) == -1, F.lit(negative)).otherwise(F.col(label)))


def add_intercept(df: DataFrame, name: str = "intercept") -> DataFrame:
    return df.withColumn(name, F.lit(1.0))


def one_hot(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """Replaces the column by one 0/1 column per value, in sorted order, appended last."""
    values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect()) if values is None else values
    return df.select(*[c for c in df.columns if c != column], *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values])


def width_edges(df: DataFrame, features: Sequence[str], n: int) -> dict[str, list[float]]:
    """Inner edges of n bins of equal width."""
    r = df.agg(*[x for c in features for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))]).first()
    edge = lambda a, b, k: float(a) + k * ((float(b) - float(a)) / n)
    return {c: [edge(r[f"a_{c}"], r[f"b_{c}"], k) for k in range(1, n)] for c in features}


def quantile_edges(df: DataFrame, features: Sequence[str], n: int) -> dict[str, list[float]]:
    """Inner edges of n bins of equal frequency (linear quantiles); equal edges are an error."""
    from ..functions.ordered import quantiles

    r = {x["column"]: x["q"] for x in quantiles(df, features, [k / n for k in range(1, n)]).collect()}
    for c in features:
        if len(set(r.get(c, []))) < n - 1:
            raise ValueError(f"bin edges of {c} are not distinct")
    return {c: list(r[c]) for c in features}


def all_tree_edges(df: DataFrame, features: Sequence[str], max_bin: int) -> dict[str, list[float]]:
    """For each feature, the distinct values at the places floor((k + 1) * n / max_bin) of its sorted column of n
    values, nulls left out; all features in one pass."""
    from ..functions.ordered import value_places

    if not features:
        return {}
    upto = value_places(df, features)
    places = [F.greatest(F.lit(1), F.floor(F.col("rows") * (k + 1) / max_bin)) for k in range(max_bin)]
    ends = upto.groupBy("column").agg(F.array(*[F.min(F.when(F.col("upto") >= p, F.col("v"))) for p in places]).alias("v"))
    found = {r["column"]: sorted(set(r["v"])) for r in ends.collect()}  # a row per feature
    return {c: found.get(c, []) for c in features}


def tree_edges(df: DataFrame, feature: str, max_bin: int) -> list[float]:
    return all_tree_edges(df, [feature], max_bin)[feature]


def bin_code(column: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins: the number of edges below the value."""
    return reduce(add, [(column > F.lit(e)).cast("int") for e in edges], F.lit(0)) if edges else F.when(column.isNotNull(), 0)


def apply_bins(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    return df.withColumns({c: bin_code(F.col(c), e) for c, e in edges.items()})


def covariance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, cov): population covariances of all pairs of features, one aggregate."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    row = df.agg(*[F.covar_pop(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("cov")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(entries))


def pca_fit(df: DataFrame, vec: str, k: int) -> dict:
    """The k leading principal components of a column of vectors: components (k x dimensions, signs fixed so
    that the largest loading is positive), explained_variance and its ratio, singular_values, mean and
    noise_variance (the mean variance of the dimensions left out). Vectors that are null or hold one take no
    part."""
    import numpy as np

    from ..functions.moments import moments

    n, mean, scatter = moments(df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda v: v.isNull())), vec)
    d = len(mean)
    values, vectors = np.linalg.eigh(scatter / max(n - 1, 1))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    top = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(0), range(min(k, d))]) if d else vectors
    return {"components": top.T, "explained_variance": values[:k], "explained_variance_ratio": values[:k] / max(values.sum(), 1e-300), "singular_values": np.sqrt(values[:k] * max(n - 1, 1)), "mean": mean, "noise_variance": float(values[k:].mean()) if k < d else 0.0, "n_samples": n}


def pca_transform(df: DataFrame, keep: Sequence[str], vec: str, fitted: dict, whiten: bool = False) -> DataFrame:
    """keep and pc0, pc1, ...: a batch of vectors is projected by one product."""
    import numpy as np
    import pyarrow as pa

    top, mean = fitted["components"].T, fitted["mean"]
    if whiten:
        top = top / np.sqrt(fitted["explained_variance"])
    names = [f"pc{j}" for j in range(top.shape[1])]

    def run(batches):
        for b in batches:
            own = b.column(len(keep))
            x = np.asarray(own.flatten().to_numpy(zero_copy_only=False), float).reshape(len(own), -1) if len(own) else np.empty((0, len(mean)))
            scores = (x - mean) @ top
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(np.ascontiguousarray(scores[:, j])) for j in range(len(names))]], [*keep, *names])

    told = df.where(F.col(vec).isNotNull()).select(*keep, vec)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema.fields[: len(keep)]]
    return told.mapInArrow(run, ", ".join([*kept, *[f"{c} double" for c in names]]))


def pca(df: DataFrame, id_col: str, features: Sequence[str], k: int, whiten: bool = False) -> tuple[DataFrame, dict]:
    """Scores on the k leading components of columns and the fitted numbers."""
    rows = df.select(id_col, F.array(*[F.col(c).cast("double") for c in features]).alias("_v"))
    fitted = pca_fit(rows, "_v", k)
    return pca_transform(rows, [id_col], "_v", fitted, whiten), fitted


def compose(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda out, step: out.transform(step), steps, df)


def embedding_sizes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, size, dim): distinct values of each column and min(50, (size + 1) / 2)."""
    row = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", "size").select("column", "size", F.least(F.lit(50), F.expr("(size + 1) div 2")).cast("long").alias("dim"))


def flatten_image(pixels: Column, mean: float, deviation: float, top: float = 1.0) -> Column:
    """An image of rows of pixels (0 to top) as one array, centred and scaled."""
    return F.transform(F.flatten(pixels), lambda x: (x.cast("double") / F.lit(top) - F.lit(mean)) / F.lit(deviation))
