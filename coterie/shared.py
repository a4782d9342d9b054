"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this process in a local session, and an error on
    a cluster, whose executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="coterie-"))
    return _own[0]


def stash(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder, in folders by a column if named, and read it back, which
    ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/coterie-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of stashed tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = vars(df).get("_stashed")
        if path is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            df._stashed = None
