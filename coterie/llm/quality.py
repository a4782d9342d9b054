"""Tokeniser-fertility quality rules (operator 5).

Two public vocabularies read every whole text. The piece vocabulary (BPE with byte fallback) gives
characters per token, the share of byte-fallback tokens and the entropy of the text's token
distribution; a byte-level vocabulary for many languages gives a second characters-per-token figure.
Ordinary prose of a language sits in a narrow band of each; symbol noise, shouting, tables, wrong
encodings and repetition leave it. The bands are medians and quartile spreads over the distinct texts of
the language (the script where the language is null) that pass the base rules, so neither copies nor
junk shape them. They are exact over values rounded to GRID, from counts by language and value, and depend
on nothing but the data. A measure spreads more in short texts, so a band opens with one over the square
root of the token count; every text that passes the base rules is judged by it. Texts that fail them are
rejected already and are not read by the tokenisers: their measures are null.

Cases: a null text is an empty text and, having under ten words, fails the base rules; a null language
is judged by script (ties of scripts go to the last by name); a group of identical figures has a band of
the least width; a figure on the edge of its band stays; a very long text is read whole; an empty table
gives an empty result; repeated rows are judged each alike; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .base import stash, table
from .vocab import byte_pieces, memo, vocab_path

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_multi_50k.tiktoken"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
#: Half-widths of the bands, in quartile spreads, and the least spread of each measure.
WIDTH = 3.5
LEAST_SPREAD = {"chars_per_token": 0.04, "chars_per_token_bytes": 0.04, "fallback_share": 0.005, "entropy": 0.02}
#: Widening for short texts: this many spreads at SHORT_TOKENS tokens, falling with the square root.
SHORT_WIDTH = 4.0
SHORT_TOKENS = 60
#: Values of a measure that its quartiles tell apart.
GRID = 1e-4
#: Up to so many languages and scripts, the bands (a row each) are broadcast; beyond, they are joined.
BROADCAST_BANDS = 10_000

_MEASURES = "doc_id long, text_hash long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, chars_per_token_bytes double, fallback_share double, entropy double"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    if len(code) == len(words):
        return 0
    # windows become numbers pair by pair; each step renumbers densely, so equal numbers mean equal windows
    key = ids[:n]
    for k in range(1, window):
        _, key = np.unique(key * np.int64(len(words) + 1) + ids[k : k + n], return_inverse=True)
    again = np.bincount(key)[key] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[window:] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def failed(n_words: int | Column, n_repeat_words: int | Column) -> bool | Column:
    """The base rules."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def script_of(text: str) -> str:
    """The most frequent script among the letters of the text, by the first word of their Unicode names."""
    seen = Counter({c: n for c, n in Counter(text).items() if c.isalpha()})
    names: Counter = Counter()
    for c, n in seen.items():
        names[unicodedata.name(c, "OTHER").split(" ")[0]] += n
    return max(names, key=lambda k: (names[k], k)) if names else "NONE"


def measures(docs: DataFrame) -> DataFrame:
    """The base counts and fertility measures of every row of docs (doc_id, text, lang)."""
    pieces, multi = vocab_path(PIECES), vocab_path(BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, multi_of, fallback = memo(pieces), memo(multi), byte_pieces(pieces)
        for b in batches:
            rows = []
            for doc_id, text_hash, text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                data = text.encode()
                words = data.split()
                lines = [x for x in data.split(b"\n") if x.strip()]
                chars = len(text) - len(data) + sum(map(len, words))
                again = repeated_words(words)
                judged = not failed(len(words), again)
                ids = np.frombuffer(b"".join(ids_of.of(words)) if judged else b"", "<u4")
                n_multi = sum(map(multi_of.__getitem__, words)) if judged else 0
                n = len(ids)
                count = np.bincount(ids)
                count = count[count > 0]
                rows.append((
                    doc_id, text_hash, lang, script_of(text) if lang is None else None, len(words), chars, len(data) - len(data.translate(None, SYMBOLS)),
                    len(lines) - len(set(lines)), again, n if judged else None, chars / n if n else None, chars / n_multi if n else None,
                    float(fallback[ids].mean()) if n else None, float(np.log2(n) - (count * np.log2(count)).sum() / n) if n else None,
                ))
            columns = list(zip(*rows, strict=True)) or [[]] * 14
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _MEASURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text", F.col("lang").cast("string")).mapInArrow(run, _MEASURES)


def _band(c: str) -> Column:
    """Whether the measure leaves its band (null: it doesn't)."""
    spread = F.greatest(F.col(f"{c}_q")[2] - F.col(f"{c}_q")[0], F.lit(LEAST_SPREAD[c]))
    wide = F.lit(WIDTH) + F.lit(SHORT_WIDTH) * F.sqrt(F.lit(float(SHORT_TOKENS)) / F.greatest(F.col("n_tokens"), F.lit(1)))
    off = F.col(c) - F.col(f"{c}_q")[1]
    # a text of few tokens can't have much entropy, and prose can't have too much: entropy has a floor only
    return F.coalesce((off < -wide * spread) if c == "entropy" else (F.abs(off) > wide * spread), F.lit(False))


def _bands(m: DataFrame) -> DataFrame:
    """(grp, and quartiles of each measure as <measure>_q) over the distinct texts of m."""
    once = m.groupBy("grp", "text_hash").agg(*[F.max(c).alias(c) for c in LEAST_SPREAD])
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(F.col(c) / GRID).cast("long").alias("value")) for c in LEAST_SPREAD]))
    counts = once.select("grp", values.alias("x")).groupBy("grp", "x.measure", "x.value").agg(F.count("*").alias("n"))
    # at most as many rows as the grid has values
    own = W.partitionBy("grp", "measure")
    counts = counts.withColumn("upto", F.sum("n").over(own.orderBy("value"))).withColumn("all", F.sum("n").over(own))
    at = F.array(*[F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("value"))) * GRID for share in (0.25, 0.5, 0.75)])
    return counts.groupBy("grp").pivot("measure", list(LEAST_SPREAD)).agg(at).toDF("grp", *[f"{c}_q" for c in LEAST_SPREAD])


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, fertility measures, base_failed, kept) for every row of docs."""
    m = stash(measures(docs), "measures").withColumn("grp", F.coalesce("lang", F.concat(F.lit("script:"), "script")))
    bad = failed(F.col("n_words"), F.col("n_repeat_words"))
    bands = stash(_bands(m.where(~bad)), "bands")
    out = m.join(F.broadcast(bands) if bands.count() <= BROADCAST_BANDS else bands, "grp", "left")
    leaves = [_band(c) for c in LEAST_SPREAD]
    unusual = leaves[0] | leaves[1] | leaves[2] | leaves[3]
    out = out.withColumn("base_failed", bad).withColumn("kept", ~bad & ~unusual)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*names, "n_tokens", "chars_per_token", "chars_per_token_bytes", "fallback_share", "entropy", "text_hash", "lang")


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns. The verdict follows from text and language,
    so rows are named by these and doc_id."""
    gone = judge(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), "text_hash", F.col("lang").alias("gone_lang")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & docs["lang"].cast("string").eqNullSafe(gone["gone_lang"])
    return docs.join(gone, same & (F.xxhash64(docs["text"]) == gone["text_hash"]), "left_anti")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("text_hash", "lang")
