"""Mixing sources to target weights by a splitting tree (operator 7), in DataFrame functions only.

Every document has a place in its source's permutation: (hash of its block, hash of its sub-block, own
hash). Targets come from the source sizes; a source is taken whole as often as its target holds it, and
for the rest the permutation is read up to a cut. The cut is found down a tree: words by block give the
block where the quota ends, words by sub-block inside it give the sub-block, and only the documents of
that sub-block are ordered one by one. No step orders a source as a whole, so a source with a third of
all rows costs each task no more than any other.

Equal rows share their place. If the cut falls among them, as many of them are taken as fit: they are
counted, one of each is kept, and the others are made again by number, in bounded chunks. It makes no
difference which of equal rows are taken, so that a rerun agrees whatever the partitions were.

The drawn blocks are dealt to output shards by a binary tree: a node's block draws are halved exactly,
at random and without replacement, over all sources together, which makes each child's source quotas
multivariate hypergeometric. Every shard thus gets disjoint permuted blocks; its rows are shuffled
inside the shard by sorting on a hash. Ranks of sources and of draws are counts of the ranges before plus
a row number inside a range, so no window holds all of them.

Cases: a null text has size 0; a null source is a source of its own, last in order; sources without
words get target 0; a source misses its target by half of one document at most; an empty table gives an
empty result; rows repeated any number of times are taken one by one; a very long text is one document
and taken whole or not; other columns pass through untouched, whatever their names and types (rows
that differ in nothing but the order of a map's entries count as equal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType
from pyspark.sql.window import Window as W

from .base import SPACES, stash, table

SEED = 20240607
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
BLOCKS = 256
SHARD_LEVELS = 4
#: Up to so many sources, their table (six numbers and a name each) is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 20_000
#: The same for the shards of the drawn blocks: some 40 bytes a row.
BROADCAST_BLOCKS = 500_000
#: Ranges over which ranks are counted.
RANGES = 64
#: Equal rows that one step makes again.
CHUNK = 10_000


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null: 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def _placed(docs: DataFrame) -> DataFrame:
    """docs (with mix_h) with the place in the permutation, and the size."""
    out = docs.withColumn("mix_b1", F.pmod("mix_h", F.lit(BLOCKS)).cast("int"))
    out = out.withColumn("mix_b2", F.pmod(F.shiftright("mix_h", 16), F.lit(BLOCKS)).cast("int"))
    return out.withColumn("mix_size", n_words(F.col("text")))


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, MapType) or isinstance(kind, StructType) and any(_has_map(f.dataType) for f in kind.fields)


def _p(*parts: str) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with no: from 0, by code point of the source, null last."""
    order = [F.col("source").asc_nulls_last()]
    ranged = stash(sizes.repartitionByRange(RANGES, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    own = ranged.withColumn("own", F.row_number().over(W.partitionBy("range").orderBy(*order)) - 1)
    return own.join(F.broadcast(counts), "range").withColumn("no", F.col("own") + F.col("before")).select(*sizes.columns, "no")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes: (source, source_size). Adds no (from 0, by code point, null last), weight and target: the
    total is shared by weight; who would exceed `repeats` times the own size stops there and the excess
    is shared again. The level per weight rises from round to round and stops when it stops nobody new;
    a round is one aggregate over the sources."""
    out = _numbered(sizes).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")))
    out = stash(out.withColumn("cap", F.lit(repeats) * F.col("source_size")), "weights")
    level, stopped = 0.0, -1
    while True:
        held = F.col("cap") <= F.lit(level) * F.col("weight")
        total, caps, free, n = out.agg(F.sum("source_size"), F.sum(F.when(held, F.col("cap"))), F.sum(F.when(~held, F.col("weight"))), F.sum(held.cast("long"))).first()
        if not free or n == stopped:
            break
        level, stopped = (total - (caps or 0)) / free, n
    target = F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double")) if free else F.col("cap").cast("double")
    return out.select("source", "source_size", "no", "weight", target.alias("target"))


def _cut(cells: DataFrame, quota: DataFrame, key: str) -> DataFrame:
    """cells: (no, key, words); quota: (no, rest). The first cell, in the order of key, whose running sum
    passes the rest, with what is left for the inside of it."""
    upto = F.sum("words").over(W.partitionBy("no").orderBy(key))
    passed = cells.join(quota, "no").withColumn("upto", upto).where("upto > rest")
    first = passed.groupBy("no").agg(F.min(F.struct(key, (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))).alias("c"))
    return first.select("no", f"c.{key}", "c.rest")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """docs and, prefixed mix_: size, source_size, target, copies (how often the mix takes the document)
    and shards (the output shard of each copy)."""
    return _mixed(docs, weights, repeats).select("mix_row.*", "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_shards")


def _dealt(draws: DataFrame) -> DataFrame:
    """(no, mix_b1, mix_dealt): the shard of each copy of a drawn block. All draws stand in one random order;
    a node of the tree holds a stretch of it and hands each child one half, the odd one to the left."""
    turn = F.xxhash64(F.lit(SEED), "no", "mix_b1", "copy")
    draws = stash(draws.withColumn("turn", turn).withColumn("range", F.shiftrightunsigned("turn", 58)), "draws")
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = draws.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"), F.sum("n").over(W.partitionBy()).alias("n"))
    own = F.row_number().over(W.partitionBy("range").orderBy("turn", "no", "mix_b1", "copy"))
    out = draws.withColumn("own", own).join(F.broadcast(sums), "range")  # RANGES rows
    out = out.select("no", "mix_b1", "copy", (F.col("own") + F.col("before")).alias("rank"), "n", F.lit(0).alias("node"))
    for _ in range(SHARD_LEVELS):
        left = F.expr("(n + 1) div 2")
        right = F.col("rank") > left
        child = F.when(right, F.col("n") - left).otherwise(left)
        out = out.select("no", "mix_b1", "copy", F.when(right, F.col("rank") - left).otherwise(F.col("rank")).alias("rank"), child.alias("n"), (F.col("node") * 2 + right.cast("int")).alias("node"))
    by_copy = F.sort_array(F.collect_list(F.struct("copy", "node")))  # at most `repeats` a block
    return out.groupBy("no", "mix_b1").agg(by_copy.getField("node").alias("mix_dealt"))


def _mixed(docs: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    # docs' row travels as one struct, so that no column of it can clash with the working columns
    # maps have no hash; as text they tell rows apart too
    told = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    h = F.xxhash64(F.lit(SEED), *told)
    docs = docs.select(F.struct("*").alias("mix_row"), h.alias("mix_h"), "text", "source")
    placed = _placed(docs)
    small = stash(placed.select("source", "mix_h", "mix_b1", "mix_b2", "mix_size"), "places")
    cells = stash(small.groupBy("source", "mix_b1", "mix_b2").agg(F.sum("mix_size").alias("words")), "cells")
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = stash(sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    few = sources.count() <= BROADCAST_SOURCES

    def known(other: DataFrame, small: bool = few) -> DataFrame:
        return F.broadcast(other) if small else other

    def with_source(df: DataFrame, *columns: str) -> DataFrame:
        own = sources.select(F.col("source").alias("mix_source"), *columns)
        return df.join(known(own), df["source"].eqNullSafe(F.col("mix_source"))).drop("mix_source")

    # down the tree: block, sub-block, document
    level = with_source(cells, "no").withColumn("p1", _p("no", "mix_b1")).withColumn("p2", _p("no", "mix_b1", "mix_b2"))
    by_block = stash(level.groupBy("no", "mix_b1", "p1").agg(F.sum("words").alias("words")), "blocks")
    one = stash(_cut(by_block, sources.select("no", "rest"), "p1"), "cut")
    inside = level.join(known(one.select("no", "p1")), ["no", "p1"])
    two = stash(_cut(inside.groupBy("no", "p2").agg(F.sum("words").alias("words")), one.select("no", "rest"), "p2").join(one.select("no", "p1"), "no"), "cut")
    last = with_source(small, "no").withColumn("p2", _p("no", "mix_b1", "mix_b2")).join(known(two.select("no", "p2")), ["no", "p2"])
    own = last.groupBy("no", F.col("mix_h").alias("h")).agg(F.sum("mix_size").alias("words"), F.count("*").alias("n"))
    # where the quota ends among equal rows, the nearest number of them is taken
    upto = own.join(two.select("no", "rest"), "no").withColumn("upto", F.sum("words").over(W.partitionBy("no").orderBy("h")))
    first = upto.where("upto > rest").groupBy("no").agg(F.min(F.struct("h", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"), "words", "n")).alias("c"))
    fit = F.greatest(F.lit(0), F.least(F.col("c.n"), F.ceil(F.col("c.left") * F.col("c.n") / F.col("c.words") - 0.5)))
    three = first.select("no", F.col("c.h").alias("c3"), fit.cast("long").alias("fit"), F.col("c.n").alias("n"))
    cut = stash(two.select("no", F.col("p1").alias("c1"), F.col("p2").alias("c2")).join(three, "no", "left"), "cut")

    # block draws, dealt to shards by exact halving
    drawn = by_block.join(sources.select("no", "whole", "rest"), "no").join(cut, "no", "left")
    copies = F.col("whole") + F.when((F.col("rest") > 0) & (F.col("c1").isNull() | (F.col("p1") <= F.col("c1"))), 1).otherwise(0)
    dealt = stash(_dealt(drawn.where(copies > 0).select("no", "mix_b1", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))), "shards")

    out = with_source(placed, "no", "source_size", "target", "whole", "rest")
    renamed = {"no": "mix_no", "source_size": "mix_source_size", "target": "mix_target", "whole": "mix_whole", "rest": "mix_rest"}
    out = out.toDF(*placed.columns, *renamed.values())
    out = out.join(known(cut.toDF("mix_no", "mix_c1", "mix_c2", "mix_c3", "mix_fit", "mix_n")), "mix_no", "left")
    p1, p2, h = _p("mix_no", "mix_b1"), _p("mix_no", "mix_b1", "mix_b2"), F.col("mix_h")
    at_cut = (p1 == F.col("mix_c1")) & (p2 == F.col("mix_c2"))
    ahead = (p1 < F.col("mix_c1")) | ((p1 == F.col("mix_c1")) & ((p2 < F.col("mix_c2")) | ((p2 == F.col("mix_c2")) & F.coalesce((h < F.col("mix_c3")) | ((h == F.col("mix_c3")) & (F.col("mix_fit") == F.col("mix_n"))), F.lit(True)))))
    extra = F.when((F.col("mix_rest") > 0) & (F.col("mix_c1").isNull() | ahead), 1).otherwise(0)
    part = F.coalesce(at_cut & (h == F.col("mix_c3")) & (F.col("mix_fit") > 0) & (F.col("mix_fit") < F.col("mix_n")), F.lit(False))
    out = out.withColumn("mix_part", part).withColumn("mix_copies", (F.col("mix_whole") + extra).cast("int"))
    kept = ["mix_no", "mix_b1", "mix_row", "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    rows = out.where(~F.col("mix_part")).select(*kept)
    split = cut.where("fit > 0 and fit < n").limit(1).count()
    if split:  # equal rows of which some are taken: one of each source, made again by number
        again = out.where("mix_part").groupBy("mix_no").agg(F.first(F.struct(*kept, "mix_fit", "mix_n")).alias("r")).select("r.*")
        again = again.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(mix_n - 1) div {CHUNK}"))).alias("mix_chunk")).repartition("mix_no", "mix_chunk")
        number = F.sequence(F.col("mix_chunk") * CHUNK, F.least(F.col("mix_n"), (F.col("mix_chunk") + 1) * CHUNK) - 1)
        again = again.select("*", F.explode(number).alias("mix_i")).withColumn("mix_copies", (F.col("mix_copies") + (F.col("mix_i") < F.col("mix_fit")).cast("int")).cast("int"))
        rows = rows.unionByName(again.select(*kept))
    rows = rows.join(known(dealt.toDF("mix_no", "mix_b1", "mix_dealt"), dealt.count() <= BROADCAST_BLOCKS), ["mix_no", "mix_b1"], "left")
    shards = F.slice(F.coalesce("mix_dealt", F.array().cast("array<int>")), F.lit(1), F.col("mix_copies"))
    return rows.select("mix_row", "mix_size", "mix_source_size", "mix_target", "mix_copies", shards.alias("mix_shards"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: docs' columns, one row per taken copy, by shard and shuffled inside each."""
    rows = _mixed(docs, weights, repeats).select("mix_row", F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    rows = rows.withColumn("mix_turn", F.xxhash64(F.lit(SEED + 1), "mix_row.doc_id", "mix_row.text", "mix_copy"))
    rows = rows.repartition("mix_shard", F.pmod("mix_turn", F.lit(BLOCKS))).sortWithinPartitions("mix_shard", "mix_turn")
    return rows.select("mix_row.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = (F.col("mix_size") * F.col("mix_copies")).alias("taken")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken, F.col("mix_shards").alias("shards"))
