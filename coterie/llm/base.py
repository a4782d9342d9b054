"""Shared pieces: table reading, written intermediate tables, byte-level text helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Maps the bytes A-Z to a-z and leaves every other byte, so that UTF-8 stays UTF-8.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: White space of the word contracts; ``bytes.split()`` splits at exactly these.
SPACES = " \t\n\x0b\f\r"

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, a folder of this
    process in a local session, and an error on a cluster, whose executors would each write to a disk of
    their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="coterie-"))
    return "file://" + _own[0]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends here, and the
    table outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/coterie-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a stashed table that nothing reads any more."""
    path = vars(df).pop("_stashed", None)
    if path is not None:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def raw(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values in a sorted array."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return start, np.diff(np.r_[start, len(keys)])
