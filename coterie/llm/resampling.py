"""Importance resampling towards a target distribution (operator 13), over hashed word n-grams.

Two passes over Arrow batches. The first counts buckets: each partition sums its batches by bincount into one
vector of BUCKETS numbers, and treeReduce merges the vectors on the executors. The second gathers the gain of
every feature's bucket from a broadcast vector of that length and sums them by document with bincount. The
draw is a Gumbel top-k: one random term per document, derived from its id, is added to its weight, and ranks
come from a range partition of the scores, so no task or driver holds the ranked documents.

Words are found and hashed on the bytes of a batch at once, in pieces of CHUNK bytes that end between words:
CRC-32 runs over the k-th byte of all words together, and a pair's goes on from its first word's.

Cases: a null or empty text has no words, no features, weight 0 and is not drawn; very long texts are read
piece by piece; equal scores go to the smaller doc_id, and rows equal in both are ranked in any order; a
repeated row is a document of its own; a null doc_id hashes as an empty one and comes after others of equal
score; without documents there is no result row, and without a target every bucket has t = 0; other columns
are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .base import LOWER, stash, table

#: Fixed values of the contract.
BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 7, 20, 25

#: Bytes that are hashed together, and the longest word that is.
CHUNK, LONG_WORD = 1 << 21, 255

_LOWER = np.frombuffer(LOWER, np.uint8)
_IN_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, by the reflected polynomial of zlib."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()
_ONES, _BYTE, _EIGHT = np.uint32(0xFFFFFFFF), np.uint32(255), np.uint32(8)


def _crc_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The register of CRC-32 after each word, going on from a state (all ones at the beginning)."""
    short = np.minimum(size, LONG_WORD + 1)
    order = np.argsort(-short, kind="stable")
    start, size, run, falling = start[order], size[order], state[order], -short[order]
    long = int(np.searchsorted(falling, -LONG_WORD))
    for k in range(LONG_WORD):
        n = int(np.searchsorted(falling, -k))  # words of more than k bytes come first
        if n <= long:
            break
        part = run[long:n]
        run[long:n] = _CRC[(part ^ data[start[long:n] + k]) & _BYTE] ^ (part >> _EIGHT)
    for i in range(long):
        run[i] = zlib.crc32(data[start[i] : start[i] + size[i]], int(run[i] ^ _ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(run)
    out[order] = run
    return out


def _between_words(data: np.ndarray, offsets: np.ndarray, stop: int) -> int:
    """The first place from stop on that is not inside a word."""
    limit = int(offsets[np.searchsorted(offsets, stop)])  # texts end words
    while stop < limit and _IN_WORD[data[stop - 1]]:
        breaks = np.flatnonzero(~_IN_WORD[data[stop : min(limit, stop + CHUNK)]])
        if len(breaks):
            return stop + int(breaks[0])
        stop = min(limit, stop + CHUNK)
    return stop


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a batch: the text of each word, and the text and the bucket of each feature."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, end = int(offsets[0]), int(offsets[-1])
    last_text, last_state = -1, _ONES
    while at < end:
        stop = _between_words(data, offsets, min(at + CHUNK, end))
        piece = _LOWER[data[at:stop]]
        inside = _IN_WORD[piece]
        edge = np.zeros(len(piece) + 1, bool)  # a text begins here
        edge[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, side="right")] - at] = True
        before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        size = np.flatnonzero(inside & (~after | edge[1:])) + 1 - start
        text = np.searchsorted(offsets, start + at, side="right") - 1
        at = stop
        if not len(start):
            continue
        state = _crc_words(piece, start, size, np.full(len(start), _ONES))
        pair = np.r_[last_text, text[:-1]] == text
        led = np.r_[last_state, state[:-1]][pair]
        led = _CRC[(led ^ np.uint32(32)) & _BYTE] ^ (led >> _EIGHT)
        both = np.r_[state, _crc_words(piece, start[pair], size[pair], led)]
        last_text, last_state = text[-1], state[-1]
        yield text, np.r_[text, text[pair]], ((both ^ _ONES) % np.uint32(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts (a table of one string column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, bucket in features(b.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64))
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(BUCKETS, np.int64)
    return vectors.treeReduce(np.add, depth=2 if parts <= 10_000 else 3)


def bucket_gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: the floored thousandfold logarithm of its smoothed share in the target over that in
    the documents."""
    s_all, t_all = float(counts.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(map(float, counts), map(float, target), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.astype(float)
        for b in batches:
            n = b.num_rows
            words, count, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for text, of, bucket in features(b.column(1)):
                words += np.bincount(text, minlength=n)
                count += np.bincount(of, minlength=n)
                total += np.bincount(of, weights=own[bucket], minlength=n)  # whole numbers, exact below 2 ** 53
            mean = total.astype(np.int64) // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, count, mean))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def with_noise(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: the weight and a Gumbel term that the doc_id determines."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank: 1, 2, 3, ... by falling score, then doc_id. The rows are dealt into ranges of that order and
    written, with their place in the range; a table of the ranges' sizes, one row each, gives what is before."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    dealt = stash(dealt.select("*", F.shiftright(place, 33).alias("_range"), (place % (1 << 33)).alias("_place")), "ranked")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_range").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with its weight, score and, if drawn, rank. target: a table with a text column."""
    gains = bucket_gains(bucket_counts(docs.select("text")), bucket_counts(target.select("text")))
    scored = stash(with_noise(weights(docs, gains), seed), "scored")
    long = F.col("n_words") >= min_words
    draw = percent * scored.where(long).count() // 100
    drawn = ranked(scored.where(long)).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(scored.where(~long).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
