"""Language-model scoring with Elias-Fano n-gram tries (operator 1).

The model is a bigram model over lower-cased words and an end token, learnt from the documents that are
not held out:  P(w | v) = (c(v w) + m(v) P(w)) / (c(v) + m(v)),  m(v) = 4 c(v)^0.8,  P(w) the add-half
unigram of the base score. Per context it is a proper distribution; the mass m(v) grows with the context
as the number of its followers does. The trie keeps the quantised c(v w) / (c(v) + m(v)), rounded
down, on a scale that reaches from 1 to one occurrence in that context, so that no code raises it; the
back-off weight m(v) / (c(v) + m(v)) follows from c(v).

The model grows with the corpus, so it is never in one place: it is sharded by context, and the queries
travel to the shards. Documents are first encoded in batches of about BATCH_TOKENS tokens, written once.
Two exchanges follow. In the first, a batch asks for its distinct words and learns their counts and
dense ids; in the second, it asks for its distinct bigrams, with its own training counts. A shard sums
what all batches send, builds the trie of its contexts in memory-mapped files, and answers each batch
with codes. Batches combine before they send, so the load of a very frequent word is one entry per
batch; contexts with more than 1/(8 S) of all tokens, S the number of shards, are split by follower.

Cases: a null text is empty and has the end token only; a null doc_id is not held out; repeated rows are
learnt and scored each; a held-out word or context that training lacks falls back to the unigram; an
empty table gives an empty result; without training documents every token has the add-half chance of an
unseen one; a very long text is one document of a batch of its own size; words of equal count take their ids
in the order of their hashes, which no score depends on; more distinct words than 32-bit ids can tell apart
raise an OverflowError; other columns are not read.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import raw, stash, table
from .eliasfano import Trie, probability, quantise, span_of

FOLDS = 5
HELD_FOLD = 1
MASS, MASS_POWER = 4.0, 0.8
BATCH_TOKENS = 1_000_000
#: Tokens per shard; the number of shards is the next power of two, at least MIN_SHARDS.
SHARD_TOKENS = 2_000_000
MIN_SHARDS = 16
END_HASH = 0
NONE = 0xFFFFFFFF

_MAIL = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("data", pa.binary())])
_MAIL_DDL = "to long, kind int, part long, data binary"
_BATCH, _WORDS, _PAIRS, _STATS = range(4)


def _press(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.array([len(a) for a in arrays], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _open(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data[: 8 * len(kinds)], "<i8")
    body, at, out = zstandard.ZstdDecompressor().decompress(data[8 * len(kinds) :]), 0, []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        step = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(body[at : at + step], kind))
        at += step
    return out


#: Of a batch: doc ids, whether an id is null, whether the document trains, its tokens; word hashes in
#: order; the tokens as places in them. Every document ends with the end token.
_BATCH_KINDS = ("<i8", "u1", "u1", "<i4", "<u8", "<u4")


def _encoded(docs: DataFrame) -> DataFrame:
    def pack(ids: list, trains: list, texts: list[list[int]], code: dict[bytes, int]) -> dict:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) or 1 for w in code), np.uint64, len(code))
        hashes[0] = END_HASH
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        tokens = place[np.fromiter((t for x in texts for t in x), np.uint32, sum(map(len, texts)))]
        data = _press(np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], "u1"), np.array(trains, "u1"), np.array([len(x) for x in texts], "<i4"), hashes[order], tokens)
        return {"to": uuid.uuid4().int >> 65, "kind": _BATCH, "part": len(tokens), "data": data}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, trains, texts, code, n = [], [], [], {b"\n": 0}, 0
        for b in batches:
            for doc_id, held, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = [code.setdefault(w, len(code)) for w in raw(text).split()]
                own.append(0)
                ids.append(doc_id)
                trains.append(not held)
                texts.append(own)
                n += len(own)
                if n >= BATCH_TOKENS:
                    yield pa.RecordBatch.from_pylist([pack(ids, trains, texts, code)], _MAIL)
                    ids, trains, texts, code, n = [], [], [], {b"\n": 0}, 0
        if ids:
            yield pa.RecordBatch.from_pylist([pack(ids, trains, texts, code)], _MAIL)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held"), "text").mapInArrow(run, _MAIL_DDL)


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _MAIL)


def _slices(shard: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, start, stop) of the runs of a sorted array of shard numbers."""
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        yield s, int(edges[s]), int(edges[s + 1])


def _ask_words(bits: int):
    """From each batch: its words and training counts, by the top bits of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, _, trains, lengths, hashes, tokens = _open(row["data"], *_BATCH_KINDS)
                count = np.bincount(tokens[np.repeat(trains, lengths) > 0], minlength=len(hashes)).astype("<u4")
                shard = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                out = [{"to": s, "kind": _WORDS, "part": row["to"], "data": _press(hashes[i:j], count[i:j])} for s, i, j in _slices(shard, 1 << bits)]
                yield pa.RecordBatch.from_pylist(out, _MAIL)

    return run


def _answer_words(bits: int):
    """In a shard: total counts, dense ids by falling count, answers, and the shard's sums."""

    def run(mail: pa.Table) -> pa.Table:
        rows = mail.to_pylist()
        asked = [_open(r["data"], "<u8", "<u4") for r in rows]
        words, inverse = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([c for _, c in asked]), len(words)).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        ids = np.full(len(words), NONE, np.int64)
        seen = order[: int((total > 0).sum())]
        if len(seen) << bits >= NONE:
            raise OverflowError(f"{len(seen)} distinct words in one of {1 << bits} shards: word ids are 32 bits wide")
        ids[seen] = (np.arange(len(seen)) << bits) | rows[0]["to"]
        out, at = [{"to": -1, "kind": _STATS, "part": rows[0]["to"], "data": np.array([total.sum(), len(seen)], "<i8").tobytes()}], 0
        for r, (h, _) in zip(rows, asked, strict=True):
            own = inverse[at : at + len(h)]
            at += len(h)
            out.append({"to": r["part"], "kind": _WORDS, "part": r["to"], "data": _press(ids[own].astype("<u4"), total[own].astype("<i8"))})
        return _table(out)

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Batch:
    """A batch with the answers of the first exchange, and its distinct bigrams in the order of asking."""

    def __init__(self, rows: list[dict], shards: int, n_tokens: int):
        body = next(r["data"] for r in rows if r["kind"] == _BATCH)
        self.ids, self.null, self.trains, self.lengths, hashes, self.tokens = _open(body, *_BATCH_KINDS)
        words = [_open(r["data"], "<u4", "<i8") for r in sorted((r for r in rows if r["kind"] == _WORDS), key=lambda r: r["part"])]
        self.word = np.concatenate([w for w, _ in words]).astype(np.uint64)
        self.count = np.concatenate([c for _, c in words])
        end = int(np.flatnonzero(hashes == END_HASH)[0])
        # an end comes before every document, so it is the context of the first word
        before = np.r_[np.uint32(end), self.tokens[:-1]]
        self.context = self.count[before]
        a, b = self.word[before], self.word[self.tokens]
        self.known = np.flatnonzero((a != NONE) & (b != NONE))
        pairs, self.inverse = np.unique((a[self.known] << np.uint64(32)) | b[self.known], return_inverse=True)
        train = np.repeat(self.trains, self.lengths)[self.known] > 0
        self.n = np.bincount(self.inverse[train], minlength=len(pairs)).astype("<u4")
        self.total = np.zeros(len(pairs), np.int64)
        self.total[self.inverse] = self.context[self.known]
        a = pairs >> np.uint64(32)
        split = self.total * 8 * shards > n_tokens
        shard = (np.where(split, _mix(_mix(a) ^ pairs), _mix(a)) % np.uint64(shards)).astype(np.int64)
        self.order = np.argsort(shard, kind="stable")
        self.shard, self.pairs = shard[self.order], pairs[self.order]

    def ask(self, to: int, shards: int) -> list[dict]:
        out = []
        for s, i, j in _slices(self.shard, shards):
            own = self.pairs[i:j]
            a, k = np.unique(own >> np.uint64(32), return_counts=True)
            first = np.r_[0, np.cumsum(k)[:-1]]
            data = _press(np.diff(a, prepend=np.uint64(0)).astype("<u4"), k.astype("<u4"), self.total[self.order[i:j]][first].astype("<i8"), own.astype("<u4"), self.n[self.order[i:j]])
            out.append({"to": s, "kind": _PAIRS, "part": to, "data": data})
        return out

    def score(self, rows: list[dict], n: int, v: int) -> list:
        code = np.zeros(len(self.pairs), np.uint8)
        answers = [_open(r["data"], "u1")[0] for r in sorted((r for r in rows if r["kind"] == _PAIRS), key=lambda r: r["part"])]
        if answers:
            code[self.order] = np.concatenate(answers)
        base = (self.count[self.tokens] + 0.5) / (n + 0.5 * (v + 1))
        own = np.zeros(len(self.tokens))
        own[self.known] = probability(code, span_of(self.total + MASS * self.total**MASS_POWER))[self.inverse]
        mass = MASS * self.context**MASS_POWER
        rest = np.where(self.context > 0, mass / np.maximum(self.context + mass, 1), 1.0)
        start = np.r_[0, np.cumsum(self.lengths.astype(np.int64))[:-1]]
        sums = [np.add.reduceat(x, start) for x in (np.log10(base), np.log10(own + rest * base), (self.count[self.tokens] > 0).astype(np.int64))]
        return [pa.array(self.ids, mask=self.null > 0), pa.array(self.trains == 0), pa.array(self.lengths.astype(np.int64)), pa.array(sums[2]), pa.array(np.full(len(start), n, np.int64)), pa.array(sums[0]), pa.array(sums[1])]


def _ask_pairs(shards: int, n: int):
    def run(mail: pa.Table) -> pa.Table:
        rows = mail.to_pylist()
        return _table(_Batch(rows, shards, n).ask(rows[0]["to"], shards))

    return run


def _answer_pairs(mail: pa.Table) -> pa.Table:
    """In a shard: sums of the bigram counts, the trie over them, and its answers."""
    rows = mail.to_pylist()
    parts = []
    for r in rows:
        step, k, total, follower, n = _open(r["data"], "<u4", "<u4", "<i8", "<u4", "<u4")
        a = np.repeat(np.cumsum(step.astype(np.uint64)), k)
        parts.append(((a << np.uint64(32)) | follower.astype(np.uint64), np.repeat(total, k), n))
    pairs, first, inverse = np.unique(np.concatenate([p for p, _, _ in parts]), return_index=True, return_inverse=True)
    total = np.concatenate([t for _, t, _ in parts])[first].astype(np.float64)
    n = np.bincount(inverse, np.concatenate([c for _, _, c in parts]), len(pairs))
    context, follower = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(NONE)).astype(np.int64)
    weight = total + MASS * total**MASS_POWER
    codes = quantise(n / weight, span_of(weight))
    has = n > 0
    folder = tempfile.mkdtemp(prefix="trie-")
    try:
        Trie.write(folder, context[has], follower[has], codes[has])
        found = Trie.open(folder).lookup(context, follower)[inverse]
    finally:
        shutil.rmtree(folder)
    out, at = [], 0
    for r, (p, _, _) in zip(rows, parts, strict=True):
        out.append({"to": r["part"], "kind": _PAIRS, "part": r["to"], "data": _press(found[at : at + len(p)])})
        at += len(p)
    return _table(out)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(shards: int, n: int, v: int):
    def run(mail: pa.Table) -> pa.Table:
        rows = mail.to_pylist()
        return pa.Table.from_arrays(_Batch(rows, shards, n).score(rows, n, v), [x.split()[0] for x in _SCORES.split(", ")])

    return run


def score(docs: DataFrame) -> DataFrame:
    """The scores of every row of docs (doc_id, text)."""
    batches = stash(_encoded(docs), "batches")
    tokens = batches.agg(F.sum("part")).first()[0] or 0
    shards = max(MIN_SHARDS, 1 << max(0, (tokens // SHARD_TOKENS - 1)).bit_length())
    bits = shards.bit_length() - 1
    words = stash(batches.mapInArrow(_ask_words(bits), _MAIL_DDL).groupBy("to").applyInArrow(_answer_words(bits), _MAIL_DDL), "words")
    n, v = _sums(words.where(F.col("kind") == _STATS).select("data"))
    mail = batches.union(words.where(F.col("kind") == _WORDS))
    asked = mail.groupBy("to").applyInArrow(_ask_pairs(shards, n), _MAIL_DDL)
    pairs = stash(asked.groupBy("to").applyInArrow(_answer_pairs, _MAIL_DDL), "bigrams")
    return mail.union(pairs).groupBy("to").applyInArrow(_scores(shards, n, v), _SCORES)


def _sums(stats: DataFrame) -> tuple[int, int]:
    """Training tokens and distinct ones: two numbers a shard, summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [np.frombuffer(x, "<i8") for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in both], pa.int64()), pa.array([int(x[1]) for x in both], pa.int64())], ["n", "v"])

    row = stats.mapInArrow(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return row[0] or 0, row[1] or 0


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
