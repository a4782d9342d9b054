"""Best-fit packing with large-item matching (operator 8).

Documents become token ids and are cut into pieces of at most `capacity` tokens. Pieces of more than a
third of the capacity (large) can share a sequence with one other large piece at most: greedy matching
gives the largest the largest partner that still fits, which leaves as few unmatched as any matching.
Smaller pieces, largest first, go to the sequence with the least gap that holds them.

Only lengths matter to that choice, so it is made on the histogram of lengths: at most `capacity` rows,
whatever the corpus. It yields groups of sequences that hold the same lengths; each group takes a range
of ranks of each length. Ranks within a length come from counts by (length, salt) and a row number inside
each salt, so that a length which a third of all pieces share is still dealt over many tasks.

Cases: null and empty texts have only the closing id and make one piece of length 1; repeated rows are
packed each for itself; a null doc_id stays null; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .base import stash, table
from .vocab import memo, vocab_path

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SALT_ROWS = 200_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids]): the documents' tokens in pieces."""
    path = vocabulary or vocab_path(VOCABULARY)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo(path)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                ids = b"".join(map(known.__getitem__, words)) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, k * capacity, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if keep_ids else [])))
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(5 + keep_ids)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of sequences: ([(length, times in each)], number of sequences). counts: pieces by length."""
    left = {n: c for n, c in counts.items() if c > 0}
    done: list[tuple[list[tuple[int, int]], int]] = []
    by_gap: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(pattern: list[tuple[int, int]], number: int) -> None:
        if number:
            gap = capacity - sum(n * t for n, t in pattern)
            (by_gap.setdefault(gap, []) if gap else done).append((pattern, number))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in large:
            if b > a or not left[a]:
                continue
            if b > capacity - a or not left[b]:
                continue
            k = left[a] // 2 if a == b else min(left[a], left[b])
            put([(a, 2)] if a == b else [(a, 1), (b, 1)], k)
            left[a] -= k + k * (a == b)
            left[b] -= k * (a != b)
        put([(a, 1)], left[a])
        left[a] = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        for gap in range(n, capacity):
            groups = by_gap.pop(gap, []) if c else []
            for pattern, number in groups:
                t = gap // n
                full = min(number, c // t)
                put([*pattern, (n, t)], full)
                c -= full * t
                rest = number - full
                if rest and c and c < t:
                    put([*pattern, (n, c)], 1)
                    c, rest = 0, rest - 1
                put(pattern, rest)
            if not c:
                break
        t = capacity // n
        put([(n, t)], c // t)
        if c % t:
            put([(n, c % t)], 1)
    return done + [g for groups in by_gap.values() for g in groups]


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces that outlives this call (it is read twice)."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    entries, base, rank = [], 0, dict.fromkeys(counts, 0)
    for pattern, number in plan(counts, capacity):
        offset = 0
        for n, t in pattern:
            entries.append((n, rank[n], t, base, offset))
            rank[n] += t * number
            offset += n * t
        base += number
    schema = "length long, from_rank long, times long, base long, first_offset long"
    per_length = spark.createDataFrame(entries, schema).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("from_rank", "times", "base", "first_offset"))).alias("slots"))

    salts = max(64, sum(counts.values()) // SALT_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(sums, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).join(F.broadcast(per_length), "length")
    slot = F.expr("element_at(slots, size(filter(slots, s -> s.from_rank <= rank)))")
    placed = ranked.withColumn("slot", slot).withColumn("nth", F.col("rank") - F.col("slot.from_rank"))
    return placed.select(
        *cut.columns,
        (F.col("slot.base") + F.expr("nth div slot.times")).alias("sequence_id"),
        (F.col("slot.first_offset") + F.expr("nth % slot.times") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """All pieces of docs with their sequence and place in it."""
    return place(stash(pieces(docs, capacity, vocabulary, keep_ids), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
