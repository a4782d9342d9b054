"""Ranks and running sums over a whole table without gathering it in one task.

The order column is cut into ranges at approximate quantiles (a few numbers reach the driver); each range
is a window of its own, and the sums of the ranges before it are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window as W

RANGES = 64


def _below(column: Column, cuts: list) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= column)) if cuts else F.lit(0)


def with_range(df: DataFrame, by: str, tie: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """Adds _range and _sub, which in this order cut the rows into ranges in rising order of (the numeric
    column `by`, tie[0]), nulls first. A value that holds a range's share of the rows or more has a range of
    its own, cut further at quantiles of the first tie column if that is numeric."""
    shares = [k / ranges for k in range(1, ranges)]
    marks = df.approxQuantile(by, shares, 0.5 / ranges)
    cuts = sorted(set(marks))
    heavy = sorted({c for c in cuts if marks.count(c) > 1})
    own = F.col(by).isin(heavy) if heavy else F.lit(False)
    # even numbers hold just the cut itself, odd ones what lies between it and the next
    number = 2 * _below(F.col(by), cuts) + F.when(own, 0).otherwise(1)
    out = df.withColumn("_range", F.coalesce(F.when(F.col(by).isNull(), -1).otherwise(number), F.lit(0)).cast("int"))
    sub = F.lit(0)
    if heavy and tie and isinstance(df.schema[tie[0]].dataType, NumericType):
        sub = F.when(own, _below(F.col(tie[0]), sorted(set(df.approxQuantile(tie[0], shares, 0.5 / ranges))))).otherwise(0)
    return out.withColumn("_sub", F.coalesce(sub, F.lit(0)).cast("int"))


def running(df: DataFrame, by: str, tie: list[str], sums: dict[str, Column], descending: bool = False, peers: bool = False) -> DataFrame:
    """Adds, for each name in sums, the running sum of its column in the order of (by, *tie). With peers,
    rows of equal order get the sum up to the last of them."""
    ranged = with_range(df, by, None if peers else tie)
    way = (lambda c: F.col(c).desc()) if descending else F.col
    totals = ranged.groupBy("_range", "_sub").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    across = W.orderBy(way("_range"), "_sub").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    before = totals.select("_range", "_sub", *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = W.partitionBy("_range", "_sub").orderBy(way(by), *([] if peers else tie))
    inside = inside.rangeBetween(W.unboundedPreceding, W.currentRow) if peers else inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = ranged.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()]).join(F.broadcast(before), ["_range", "_sub"])
    return out.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def row_numbers(df: DataFrame, by: str, tie: list[str], name: str = "rn", descending: bool = False) -> DataFrame:
    """Adds name: 1, 2, ... in the order of (by, *tie)."""
    return running(df, by, tie, {name: F.lit(1)}, descending)


def value_places(df: DataFrame, columns: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """(column, v, upto, rows): the distinct values of all columns, nulls left out, with the number of rows up to
    each and of all. Rows are counted by value first, and values are numbered inside ranges, so no task holds
    the values of a whole column; all columns go through one table."""
    plain = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    marks = plain.approxQuantile(list(columns), [k / ranges for k in range(1, ranges)], 0.5 / ranges)
    number = F.lit(0)
    for c, m in zip(columns, marks, strict=True):
        number = F.when(F.col("column") == c, _below(F.col("v"), sorted(set(m)))).otherwise(number)
    long = plain.unpivot([], list(columns), "column", "v").where("v is not null")
    counts = long.groupBy("column", "v").agg(F.count("*").alias("n")).withColumn("_range", number)
    own = W.partitionBy("column")  # a row per range
    sums = counts.groupBy("column", "_range").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    before = sums.select("column", "_range", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("n").over(own).alias("rows"))
    inside = F.sum("n").over(W.partitionBy("column", "_range").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    upto = counts.withColumn("upto", inside).join(F.broadcast(before), ["column", "_range"])
    return upto.select("column", "v", (F.col("upto") + F.col("before")).alias("upto"), "rows")


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], ranges: int = RANGES) -> DataFrame:
    """(column, q): the exact linear quantiles of each column at the shares, nulls left out; a column without
    values has no row."""
    upto = value_places(df, columns, ranges)
    at = [(F.col("rows") - 1) * F.lit(float(x)) for x in shares]
    ends = [F.min(F.when(F.col("upto") > side(p), F.col("v"))).alias(f"{name}{k}") for k, p in enumerate(at) for name, side in (("low", F.floor), ("high", F.ceil))]
    found = upto.groupBy("column", "rows").agg(*ends)
    linear = lambda k, p: F.when(F.col(f"low{k}") == F.col(f"high{k}"), F.col(f"low{k}")).otherwise((F.ceil(p) - p) * F.col(f"low{k}") + (p - F.floor(p)) * F.col(f"high{k}"))
    return found.select("column", F.array(*[linear(k, p) for k, p in enumerate(at)]).alias("q"))


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Adds name: 1, 2, ... in an order of any columns. The rows are dealt into ranges of it and written with
    their places there; a table of the ranges' sizes gives what is before each."""
    from ..shared import stash

    place = F.monotonically_increasing_id()  # the partition above bit 33, the row below
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stash(dealt.select("*", F.shiftright(place, 33).alias("_part"), (place % (1 << 33)).alias("_place")), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(name))
