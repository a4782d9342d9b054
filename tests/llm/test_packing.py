import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coterie.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40)), st.just(60))
def test_plan_holds_every_piece_once(counts, capacity):
    groups = packing.plan(counts, capacity)
    seen = defaultdict(int)
    for pattern, number in groups:
        assert number > 0 and sum(n * t for n, t in pattern) <= capacity
        for n, t in pattern:
            seen[n] += t * number
    assert dict(seen) == {n: c for n, c in counts.items() if c}
    sizes = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    bins = []  # best fit, one piece after another
    for n in sizes:
        fit = min((g for g in bins if g >= n), default=None)
        if fit is None:
            bins.append(capacity - n)
        else:
            bins.remove(fit)
            bins.append(fit - n)
    used, bound = sum(k for _, k in groups), -(-sum(sizes) // capacity)
    assert bound <= used <= max(len(bins) + 1, bound + 1)


def test_ids_and_places(spark):
    rng = random.Random(1)
    words = ["Éa", "don't", "x1y22", "<|endoftext|>", "ﬁ", "A b", "é", "naïve", "***", "漢字かな", "\u0001"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 700, 3000]))) for _ in range(60)]
    texts += [None, "", "  ", "word " * 9000, texts[0], texts[0], "é\n\té", "z" * 5000]
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)] + [(3, texts[3], 7, "x"), (None, "null id", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, rank string")
    got = packing.pack(docs).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(map(tuple, packing.pack(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert packing.pack(docs.limit(0)).count() == 0
    assert all(sum(len(r.ids) for r in [r]) == r.length for r in packing.pack(docs, keep_ids=True).collect())
