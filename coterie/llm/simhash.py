"""SimHash near-duplicates through an inverted index on byte positions (operator 2).

Two 64-bit fingerprints with at most four differing bits agree in at least four of their eight bytes,
wherever the bits fall. The index therefore posts each distinct fingerprint under its positional bytes, as
many positions to a posting key as keep an ordinary list near LIST fingerprints: one for some thousand
fingerprints, two for a million, three for some hundred million, four beyond. A pair that shares the
guaranteed minimum of four positional bytes meets under every such key. Inside a list the shared bytes of
each pair are tallied; pairs below the minimum, which met by their key alone, fall out, and the rest are
verified bit by bit. With four positions to a key the minimum is met by meeting.

Lists hand on a spanning forest of their links and never all pairs. A long list is indexed again on
smaller chunks of its free bits (half-bytes, then bit pairs), by the same counting argument, so a dense
group doesn't become quadratic.

Cases: null text or text without words has fingerprint zero, linked like any other; text of fewer than
four words is one shingle; a bit set in exactly half of the shingles is 0; very long texts are hashed in
bounded steps; repeated rows keep their rows; a null doc_id keeps its row and takes the component of its
fingerprint, null if no row there has an id; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import raw, runs, stash, table
from .components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: How one_of_each() finds near copies: texts are near if, under either seed, the fingerprints over shingles of
#: so many words differ in no more than so many bits. Two words and five bits stand for five-word similarities
#: of 0.8 and more far better than five words and four bits do, whose fingerprints are much farther apart.
STAGE_WORDS, STAGE_BITS, STAGE_SEEDS = 2, 5, (42, 43)
#: A list longer than this is indexed again on smaller chunks.
LONG_LIST = 1024
#: Other fingerprints that an ordinary one meets in a list.
LIST = 24


def positions(n: int, bits: int = MAX_BITS) -> int:
    """Byte positions to a posting key for n distinct fingerprints."""
    return next((r for r in range(1, 8 - bits) if n <= LIST * 256**r), 8 - bits)


def _masks(r: int) -> list[int]:
    return [sum(0xFF << 8 * i for i in place) for place in combinations(range(8), r)]


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the text's word shingles, repeats included."""
    words = raw(text).split()
    if not words:
        return 0
    n = len(words)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(words_each, n)
    digest = xxhash.xxh64_digest
    total = np.zeros(64, np.int64)
    first, last = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    for at in range(0, len(first), 65536):
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(first[at : at + 65536], last[at : at + 65536], strict=True)])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(first)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, words_each) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fps: np.ndarray, width: int, free: int, bits: int = MAX_BITS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span the components of distinct fps which agree outside the bits of `free`.
    width: bits of a chunk at the next indexing, should the list be long."""
    if len(fps) > LONG_LIST and width:
        chunks = [((1 << width) - 1) << s for s in range(0, 64, width) if free >> s & ((1 << width) - 1)]
        us, vs = [], []
        # at most `bits` chunks differ, so all the others agree
        for quad in combinations(chunks, max(0, len(chunks) - bits)):
            mask = sum(quad)
            key = fps & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            start, length = runs(key[order])
            for s, n in zip(start[length > 1].tolist(), length[length > 1].tolist(), strict=True):
                u, v = _forest(fps[order[s : s + n]], width // 2 if width > 1 else 0, free & ~mask, bits)
                us += u
                vs += v
        return us, vs
    label = np.arange(len(fps))
    step = max(1, 4_000_000 // len(fps))
    while True:
        new = label.copy()
        for at in range(0, len(fps), step):
            differ = fps[at : at + step, None] ^ fps[None, :]
            tally = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(-1)
            linked = (tally >= 8 - bits) & (_popcount(differ) <= bits)
            new[at : at + step] = np.where(linked, label[None, :], len(fps)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(fps))
    return [fps[own]], [fps[label[own]]]


def _lists(batches: Iterator[pa.RecordBatch], r: int = 8 - MAX_BITS, bits: int = MAX_BITS) -> Iterator[pa.RecordBatch]:
    """Links inside the posting lists of one partition."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    c = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in got]).astype(np.int64)
    fp = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in got]).view(np.uint64)
    masks = np.array(_masks(r), np.uint64)
    us, vs = [], []
    order = np.argsort(c, kind="stable")
    at, n = runs(c[order])
    for s, k in zip(at.tolist(), n.tolist(), strict=True):
        own = np.sort(fp[order[s : s + k]])
        mask = masks[c[order[s]]]
        key = own & mask
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        start, length = runs(key)
        two = start[length == 2]
        near = _popcount(own[two] ^ own[two + 1]) <= bits
        us.append(own[two[near]])
        vs.append(own[two[near] + 1])
        for i, m in zip(start[length > 2].tolist(), length[length > 2].tolist(), strict=True):
            u, v = _forest(own[i : i + m], 4 if r == 8 - bits else 8, int(~mask), bits)
            us += u
            vs += v
    u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(u, v): a table of links that spans the components of the distinct fingerprints in fps.fp."""
    own = stash(fps.select("fp").distinct(), "distinct")
    r = positions(own.count(), bits)
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in _masks(r)])
    posted = own.select(F.posexplode(masks).alias("c", "mask"), "fp")
    posted = posted.select(F.col("c").cast("short").alias("c"), "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    dealt = posted.repartition(F.xxhash64("c", "key")).select("c", "fp")
    found = dealt.mapInArrow(partial(_lists, r=r, bits=bits), "u long, v long")
    # a fingerprint has a link from each list; it keeps the least, which the others are linked to in its place,
    # so that a large group, whose lists begin with few fingerprints, hands on little more than a link per member
    met = found.groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("vs"))
    return met.select(F.explode(F.expr("transform(vs, (v, i) -> struct(if(i = 0, u, v) AS u, vs[0] AS v))")).alias("e")).select("e.u", "e.v").distinct()


def near_duplicates(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    fps = stash(fingerprints(docs, words_each), "fingerprints")
    root = components(links(fps))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    member = least.join(root, least.fp == root.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    of_root = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = member.join(of_root, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _text_links(fps: DataFrame, bits: int) -> DataFrame:
    """(u, v) from (text_hash, fp): links between texts that span those of equal and of near fingerprints. The
    text of least hash stands for its fingerprint."""
    first = stash(fps.groupBy("fp").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")), "firsts")
    same = fps.join(first.where("first != last"), "fp").select(F.col("text_hash").alias("u"), F.col("first").alias("v"))
    side = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_text"))
    near = links(first, bits).where("u != v").join(side("u"), "u").join(side("v"), "v")
    return same.union(near.select("u_text", "v_text"))


def one_of_each(docs: DataFrame, words_each: int = STAGE_WORDS, bits: int = STAGE_BITS, seeds: tuple[int, ...] = STAGE_SEEDS) -> DataFrame:
    """One row of docs for each group of near-duplicates, near under the fingerprints of any seed: that of the
    least doc_id (rows without an id come last, rows of one id go by the hash of their text). Of several rows
    with that id and text the one with the least digest of all its columns stays, whatever order or
    partitions they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            each = [pa.array([fingerprint(t, words_each, seed) for t in texts], pa.int64()) for seed in seeds]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *each], ["doc_id", "text_hash", *[f"fp{k}" for k in range(len(seeds))]])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    fps = stash(own.mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"fp{k} long" for k in range(len(seeds)))), "fingerprints")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    texts = stash(fps.groupBy("text_hash", *[f"fp{k}" for k in range(len(seeds))]).agg(order.alias("k")), "texts")
    each = [_text_links(texts.select("text_hash", F.col(f"fp{k}").alias("fp")), bits) for k in range(len(seeds))]
    edges = each[0]
    for more in each[1:]:
        edges = edges.union(more)
    root = components(edges)
    grouped = texts.join(root, texts.text_hash == root.node, "left").select(F.coalesce("root", "text_hash").alias("root"), "text_hash", "k")
    first = grouped.groupBy("root").agg(F.min(F.struct("k.no_id", "k.doc_id", "text_hash")).alias("k"))
    again = fps.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("a_id"), F.col("text_hash").alias("a_hash"), "n")
    keep = first.select(F.col("k.doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash"))
    keep = keep.join(again, F.col("keep_id").eqNullSafe(F.col("a_id")) & (F.col("keep_hash") == F.col("a_hash")), "left")
    keep = stash(keep.select("keep_id", "keep_hash", F.coalesce("n", F.lit(1)).alias("n")), "keep")
    named = docs["doc_id"].cast("long").eqNullSafe(keep["keep_id"]) & (F.xxhash64(docs["text"]) == keep["keep_hash"])
    once = docs.join(keep.where(keep["n"] == 1), named, "left_semi")
    # a row as text names all its columns' values; rows of equal text are equal
    again = docs.join(keep.where(keep["n"] > 1), named, "left_semi").withColumn("_row", F.struct("*"))
    told = F.sha2(F.to_json(F.struct("_row"), {"ignoreNullFields": "false"}), 256)
    one = again.groupBy("doc_id", F.xxhash64("text").alias("_text")).agg(F.min_by("_row", told).alias("_row"))
    return once.union(one.select("_row.*"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
