"""Intersection of ids between parties: in the clear, on hashes, and with blind signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions.ordered import numbered
from ..shared import stash
from .select import hash_order


def intersect(*parties: DataFrame) -> DataFrame:
    """Distinct ids (the first column of each table) that all parties have: one semi-join each, largest
    reductions first being Spark's choice at run time."""
    ids = [p.select(F.col(p.columns[0]).alias("id")) for p in parties]
    return reduce(lambda a, b: a.join(b, "id", "left_semi"), ids[1:], ids[0]).distinct()


def obfuscate(column: Column, option: str = "md5") -> Column:
    """Hex digest of the id's decimal string."""
    text = column.cast("string")
    return {"md5": lambda: F.md5(text), "sha256": lambda: F.sha2(text, 256), "sm3": lambda: crypto.sm3_hex(text)}[option]()


def hashed_intersect(a: DataFrame, b: DataFrame, option: str = "sha256", salt: str = "") -> DataFrame:
    """Like intersect, but only (salted) digests of the second party's ids are compared."""
    digest = lambda c: obfuscate(F.concat(F.lit(salt), c.cast("string")) if salt else c, option)
    theirs = b.select(digest(F.col(b.columns[0])).alias("h")).distinct()
    own = a.select(F.col(a.columns[0]).alias("id")).distinct().withColumn("h", digest(F.col("id")))
    return own.join(theirs, "h", "left_semi").select("id")


def with_decoys(reply: DataFrame, others: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """The intersection with int(share * its size) ids of others that it lacks, by hash order."""
    k = int(share * reply.count())
    rest = others.select(F.col(others.columns[0]).alias("id")).distinct().join(reply, "id", "left_anti")
    ranked = numbered(rest.withColumn("_h", hash_order("id", seed=seed)), [F.col("_h"), F.col("id")], "_rn")
    return reply.select("id").union(ranked.where(F.col("_rn") <= k).select("id"))


def sign_ids(ids: DataFrame, key: crypto.RSA) -> DataFrame:
    """Offline phase of the signing party: (id, token), written for later online runs."""
    signed = crypto.powmod(crypto.id_number(F.col(ids.columns[0])), key.d, key.n)
    return stash(ids.select(F.col(ids.columns[0]).alias("id"), F.sha2(signed, 256).alias("token")), "signed")


def blind_intersect(active: DataFrame, passive: DataFrame, key: crypto.RSA, seed: int = 1, signed: DataFrame | None = None) -> DataFrame:
    """Ids of both parties. The passive party blinds, the active one signs without seeing an id, and only
    hashes of signatures are joined. signed: the active party's offline table."""
    tokens = sign_ids(active, key) if signed is None else signed
    number = crypto.id_number(F.col("id"))
    theirs = passive.select(F.col(passive.columns[0]).alias("id")).distinct().withColumn("number", number)
    sent = theirs.withColumn("blinded", crypto.blind(F.col("number"), key.public, seed))
    back = sent.withColumn("signed", crypto.powmod(F.col("blinded"), key.d, key.n))
    own = back.withColumn("token", F.sha2(crypto.unblind(F.col("number"), F.col("signed"), key.public, seed), 256))
    return own.join(tokens.select("token").distinct(), "token", "left_semi").select("id")


def align(parties: list[DataFrame], id_col: str = "id") -> DataFrame:
    """The parties' columns side by side on their common ids."""
    return reduce(lambda a, b: a.join(b, id_col), parties)
