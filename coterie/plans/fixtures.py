"""Party tables that the queries share, as DataFrames and as SQL common table expressions.

Sums and averages of doubles are rounded, so that they do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The active party's features; FEATURES are the passive party's.
ACTIVE_FEATURES = ("o_totalprice", "priority")
FEATURES = ("n_lines", "sum_qty", "avg_disc", "avg_tax", "sum_price")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(x: Column, digits: int) -> Column:
    """As SQL engines on binary numbers round: the scaled double goes to a whole number. F.round takes the shortest
    decimal instead, and differs where a value is next to a tie."""
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def active(spark: SparkSession, sf: str) -> DataFrame:
    """Orders: a binary label and two features."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice", F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"))


def passive(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines summed by order: five features, fewer ids."""
    return (
        table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.count("*").cast("double").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.round(F.avg("l_tax"), 6).alias("avg_tax"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"))
    )


def joined(spark: SparkSession, sf: str) -> DataFrame:
    return active(spark, sf).join(passive(spark, sf), "id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(id, y, p): a fixed score between 0 and 1 on orders, with ties."""
    p = F.floor(F.col("o_totalprice") % 1000) / 1000
    return active(spark, sf).select("id", "y", p.alias("p"))


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with nulls at fixed places."""
    null = lambda c, k: F.when(F.col("p_partkey") % k == 0, None).otherwise(F.col(c))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), null("p_size", 7).alias("size"), null("p_retailprice", 11).alias("price"), null("p_brand", 5).alias("brand"), F.when(F.col("p_partkey") % 2 == 0, None).otherwise(F.col("p_type")).alias("type"))


def clients(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", (F.col("user_id") % 4).cast("int").alias("client_id"), F.col("value"), F.dayofmonth("ts").alias("day"), "ts")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


ACTIVE = "active AS (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority FROM orders)"
PASSIVE = "passive AS (SELECT l_orderkey AS id, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, round(avg(l_tax), 6) AS avg_tax, round(sum(l_extendedprice), 2) AS sum_price FROM lineitem GROUP BY 1)"
JOINED = f"{ACTIVE}, {PASSIVE}, joined AS (SELECT a.id, y, o_totalprice, priority, n_lines, sum_qty, avg_disc, avg_tax, sum_price FROM active a JOIN passive p ON a.id = p.id)"
LONG = "long AS (SELECT id, y, feature, value FROM (UNPIVOT (SELECT id, y, n_lines, sum_qty, avg_disc, avg_tax, sum_price FROM joined) ON n_lines, sum_qty, avg_disc, avg_tax, sum_price INTO NAME feature VALUE value))"
SCORED = f"{ACTIVE}, scored AS (SELECT id, y, floor(o_totalprice % 1000) / 1000 AS p FROM active)"
DIRTY = "dirty AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS size, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_type END AS type FROM part)"
CLIENTS = "clients AS (SELECT event_id, CAST(user_id % 4 AS INTEGER) AS client_id, value, day(ts) AS day, ts FROM events)"
VECTORS = "vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings)"
