"""Row and column selection, splits and first-k samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ordered import row_numbers


def hash_order(*cols: str, seed: int = 0) -> Column:
    """A reproducible random order: the first 15 hex digits of an md5 as a number."""
    text = F.concat_ws("-", *[F.col(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("double")


def train_test_split(df: DataFrame, id_col: str, test_size: float, random: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first floor(n * (1 - test_size)) rows in order of id (or of a hash of it) and the rest."""
    n = df.count()
    k = math.floor(n * (1 - test_size) + 1e-9)
    by = hash_order(id_col, seed=seed) if random else F.col(id_col).cast("double")
    ranked = row_numbers(df.withColumn("_by", by), "_by", [id_col], "_rn")
    part = lambda keep: ranked.where(keep).select(*df.columns)
    return part(F.col("_rn") <= k), part(F.col("_rn") > k)


def first_per_class(df: DataFrame, label: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each class."""
    rank = F.row_number().over(W.partitionBy(label).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= k).drop("_rn")


def shards(df: DataFrame, order: list[str], by: str, n_shards: int, clients: int) -> DataFrame:
    """Deals rows to clients for federated training: in order of `by` the rows fall into n_shards runs of
    equal length, and run s goes to client s mod clients. Ordered by the label the split is non-iid."""
    n = df.count()
    size = max(1, math.ceil(n / n_shards))
    shard = F.expr(f"(rn - 1) div {size}").cast("int")
    out = row_numbers(df, by, order).withColumn("shard", shard)
    return out.withColumn("client_id", (F.col("shard") % clients).cast("int")).drop("rn")
