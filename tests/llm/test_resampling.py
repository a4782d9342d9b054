import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coterie.llm import resampling

LONG = "word " * 300_000 + "x" * 3_000_000 + " é" * 1000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog " * 3), (2, None), (3, ""), (4, " \t--\n"), (5, "ÉTÉ été Ete A-Z a_z 0x0F   naïve word"), (6, "one two three four five six seven eight nine ten " * 4), (6, "one two three four five six seven eight nine ten " * 4), (7, LONG),
    (8, "x" * 255 + " " + "y" * 256 + " " + "z" * 5000 + " end"), (9, "The lazy dog " * 10), (10, "a"), (None, "the quick brown fox " * 6), (12, "w" * 70_000 + "-b"), (2**40, "end of all " * 9), (-3, "the the the " * 9),
]
TARGET = [(1, "the quick brown fox"), (2, "the lazy dog jumps"), (3, None)]


def grams(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [zlib.crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(docs, target):
    s, t, told = Counter(), Counter(), [(i, *grams(x)) for i, x in docs]
    for _, _, g in told:
        s.update(g)
    for _, x in target:
        t.update(grams(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000) / ((s[b] + 1.0) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for i, n, g in told:
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted([(r[0], *r[2:], drawn.get(id(r))) for r in rows], key=str)


@pytest.mark.parametrize("chunk", [64, 1000, resampling.CHUNK])
def test_features_of_pieces(monkeypatch, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    texts = pa.array(["", *[x if chunk > 64 else (x or "")[:6000] for _, x in DOCS], "", None])
    for batch in (texts, texts.slice(3, 5), texts.slice(2, 1), texts.slice(0, 0)):
        words, found = Counter(), [Counter() for _ in range(len(batch))]
        for text, of, bucket in resampling.features(batch):
            words.update(text.tolist())
            for k, b in zip(of.tolist(), bucket.tolist(), strict=True):
                found[k][b] += 1
        for k, x in enumerate(batch.to_pylist()):
            n, g = grams(x)
            assert (words[k], found[k]) == (n, Counter(g))


def test_against_brute_force(spark):
    frame = spark.createDataFrame([(i, x, "") for i, x in DOCS], "doc_id long, text string, score string")
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    for parts in (1, 5):
        assert sorted(map(tuple, resampling.resample(frame.repartition(parts), target).collect()), key=str) == brute(DOCS, TARGET)
    assert resampling.resample(frame.limit(0), target).count() == 0
    assert resampling.resample(frame, target.limit(0)).count() == len(DOCS)
    assert sorted(map(tuple, resampling.resample(frame.where("doc_id = 3"), target).collect())) == brute([(3, "")], TARGET)


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, resampling.op13_importance_resampling(spark, sf).collect()), key=str) == brute(docs, target)


def test_ranks_of_many_ties(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000).alias("score")).repartition(7)
    got = {r.doc_id: r["rank"] for r in resampling.ranked(rows).collect()}
    ids = np.arange(20_000)
    order = np.lexsort((ids, -np.where(ids % 3 == 0, 5, ids % 1000)))
    assert [got[i] for i in order.tolist()] == list(range(1, 20_001))
