import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coterie.llm import lm
from coterie.llm.eliasfano import EliasFano, Trie, probability, quantise


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2000) | st.integers(0, 1 << 45), max_size=200), st.lists(st.integers(0, 1 << 46), max_size=20))
def test_elias_fano_access_and_successor(values, others):
    v = np.sort(np.array(values, np.uint64))
    ef = EliasFano.build(v)
    assert ef.access(np.arange(len(v))).tolist() == v.tolist()
    q = np.array(values + others + [x + 1 for x in values], np.uint64)
    at, equal = ef.successor(q)
    assert at.tolist() == np.searchsorted(v, q).tolist()
    assert equal.tolist() == np.isin(q, v).tolist()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 30), st.integers(0, 50) | st.integers(0, 1 << 31)), st.integers(1, 255), max_size=80))
def test_trie_round_trip(tmp_path_factory, pairs):
    folder = str(tmp_path_factory.mktemp("trie"))
    keys = sorted(pairs)
    c, f = np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)
    Trie.write(folder, c, f, np.array([pairs[k] for k in keys], np.uint8))
    trie = Trie.open(folder)
    asked = keys + [(a, b) for a in range(32) for b in (0, 3, 49, 1 << 30)]
    got = trie.lookup(np.array([a for a, _ in asked], np.int64), np.array([b for _, b in asked], np.int64))
    assert got.tolist() == [pairs.get(k, 0) for k in asked]


def test_quantised_probabilities_round_down():
    p = np.r_[0.0, 10.0 ** np.linspace(-6.9, 0, 1000)]
    q = probability(quantise(p))
    assert (q <= p * (1 + 1e-6)).all() and (q[1:] >= p[1:] * 10**-lm.quantise.__globals__["STEP"] * 0.999).all()


def model(rows):
    tokens = [["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [None] for _, t in rows]][0]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    uni, bi = Counter(), Counter()
    for x, h in zip(tokens, held):
        if not h:
            uni.update(x)
            bi.update(zip([None, *x], x))
    n, v = sum(uni.values()), len(uni)
    out = []
    for (i, _), x, h in zip(rows, tokens, held):
        base = score = 0.0
        for a, b in zip([None, *x], x):
            p = (uni[b] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            c = uni[a]
            m = 4 * c**0.8
            score += math.log10((bi[a, b] + m * p) / (c + m) if c else p)
        out.append((i, h, len(x), sum(uni[b] > 0 for b in x), n, base, score))
    return out


@pytest.mark.parametrize("batch", [1_000_000, 200])
def test_against_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(lm, "BATCH_TOKENS", batch)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    rng = random.Random(6)
    words = [f"W{int(rng.paretovariate(0.9))}é" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 200])))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "\n \t"), (None, rows[2][1]), (3, rows[3][1]), (3, rows[3][1]), (700, "the " * 3000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part long, data string")
    got = sorted(map(tuple, lm.score(df).collect()), key=str)
    want = sorted(model(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert w[6] - 0.03 * w[2] <= g[6] <= w[6] + 1e-6  # quantised downward, by one step a token at most


def test_edges(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    (only,) = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert only.held_out and only.train_tokens == 0 and only.score == pytest.approx(0.0)


def test_codes_never_raise_a_probability():
    """Also in contexts seen more than 1e7 times."""
    import numpy as np

    from coterie.llm.eliasfano import probability, quantise, span_of

    rng = np.random.default_rng(1)
    total = np.floor(10 ** rng.uniform(0, 13, 20_000))
    n = np.maximum(1, np.floor(total * 10 ** -rng.uniform(0, 13, 20_000)))
    weight = total + 4 * total**0.8
    span = span_of(weight)
    assert (span > 7).any()
    codes = quantise(n / weight, span)
    back = probability(codes, span)
    assert (codes > 0).all() and (back <= n / weight * (1 + 1e-6)).all()
    assert (np.log10(n / weight) - np.log10(back) <= span / 254 + 1e-6).all()
    assert quantise(np.array([1e-8, 1e-9, 0.0])).tolist() == [0, 0, 0]
    counts = np.r_[3e7, np.ones(200_000)]
    weight = counts.sum() + 4 * counts.sum() ** 0.8
    assert probability(quantise(counts / weight, span_of(weight)), span_of(weight)).sum() <= 1


def test_too_many_words_raise():
    import numpy as np
    import pytest

    from coterie.llm import lm

    row = {"to": 0, "kind": 1, "part": 0, "data": lm._press(np.arange(4, dtype="<u8"), np.ones(4, "<u4"))}
    import pyarrow as pa

    with pytest.raises(OverflowError):
        lm._answer_words(31)(pa.Table.from_pylist([row], lm._MAIL))
