"""The cleaning chain that follows every tabular source: dates, sparse rows and columns, outliers, fill,
categories. Each step is one aggregate at most and a projection."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.ordered import numbered

_STATS_LIMIT = 10_000


def parse_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Named columns as timestamps; what can't be read becomes null."""
    return df.select(*[F.try_to_timestamp(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def drop_sparse(df: DataFrame, row_threshold: float = 0.3, column_threshold: float = 0.3) -> DataFrame:
    """Keeps rows with fewer than row_threshold of their values null and columns with fewer than
    column_threshold null, both judged on the whole table."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns]).first()
    keep = [c for c in df.columns if row[c] < row["_n"] * column_threshold]
    nulls = reduce(add, [F.col(c).isNull().cast("int") for c in df.columns])
    return df.where(nulls < len(df.columns) * row_threshold).select(*keep)


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def outliers_to_null(df: DataFrame, columns: list[str], k: float = 1.0) -> DataFrame:
    """Values further than k population deviations from the mean become null."""
    if not columns:
        return df
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    far = lambda c: F.abs(F.col(c) - F.lit(stats[f"m_{c}"])) > F.lit(k) * F.lit(stats[f"s_{c}"])
    return df.select(*[F.when(far(c), None).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls become the column's most frequent value, the least of equally frequent ones. Counts are made
    per value before the pick, so a column of very many values is summed in many tasks."""
    filled = {}
    for c in columns or df.columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).count()
        mode = counts.agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("mode")).first()["mode"]
        filled[c] = F.coalesce(F.col(c), F.lit(mode).cast(df.schema[c].dataType))
    return df.withColumns(filled)


def category_codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): codes from 0 by first appearance in the given order."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("_first"))
    return numbered(first, [F.col("_first"), F.col("value")], "_rn").select("value", (F.col("_rn") - 1).cast("int").alias("code"))


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Replaces values by their codes; values that the mapping lacks become null."""
    small = codes.count() <= _STATS_LIMIT
    mapping = codes.select(F.col("value").alias(column), F.col("code").alias("_code"))
    out = df.join(F.broadcast(mapping) if small else mapping, column, "left")
    return out.select(*[F.col("_code").alias(c) if c == column else F.col(c) for c in df.columns])


def clean(df: DataFrame, id_col: str, dates: tuple[str, ...] = (), skip: int = 2, row_threshold: float = 0.3, column_threshold: float = 0.3, k: float = 1.0) -> DataFrame:
    """The whole chain. skip: leading columns that keep their outliers."""
    out = drop_sparse(parse_dates(df, list(dates)), row_threshold, column_threshold)
    out = outliers_to_null(out, [c for c in numeric(out) if c in out.columns[skip:]], k)
    out = fill_mode(out)
    for c in [c for c in out.columns if c not in numeric(out)]:
        out = encode(out, c, category_codes(out, c, id_col))
    return out
