import random

import numpy as np
import xxhash

from coterie.llm import simhash
from coterie.llm.components import components


def brute_fp(text, each=4, seed=42):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + each]) for i in range(max(1, len(words) - each + 1))]
    h = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(fps, ids):
    """Least id reachable by links of at most four bits, by search over all pairs."""
    out = []
    for i in range(len(fps)):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in range(len(fps)):
                if y not in seen and bin(fps[x] ^ fps[y]).count("1") <= 4:
                    seen.add(y)
                    todo.append(y)
        out.append(min((ids[y] for y in seen if ids[y] is not None), default=None))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}É" for i in range(300)]
    texts = []
    for _ in range(25):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            other = list(words)
            other[rng.randrange(len(other))] = "Changed"
            texts.append("\n".join(other))
    texts += [None, "", " \t\n", "one", "One  two three", "one two three four", "x " * 20000, texts[0], texts[0]]
    rows = [(i, t, "doc_id", i) for i, t in enumerate(texts)] + [(None, texts[0], "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fp(t) for _, t, *_ in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], closed(fps, [r[0] for r in rows])), key=str)
    assert sorted([tuple(r) for r in got], key=str) == want


def test_lists_find_every_link(spark, monkeypatch):
    """Random and dense fingerprints, with list splitting forced."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:6]:
        x = int(b)
        for _ in range(60):
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    want = closed(fps, fps)
    for long_list in (1024, 8):
        monkeypatch.setattr(simhash, "LONG_LIST", long_list)
        import pyarrow as pa

        c = np.repeat(np.arange(70), len(fps)).astype(np.int16)
        fp = np.tile(np.array(fps, np.uint64), 70).view(np.int64)
        out = list(simhash._lists(iter([pa.RecordBatch.from_arrays([pa.array(c), pa.array(fp)], ["c", "fp"])])))[0]
        parent = {f: f for f in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            a, b = sorted((root(u % (1 << 64)), root(v % (1 << 64))))
            parent[b] = a
        assert [root(f) for f in fps] == want


def test_components_of_chain_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(10, 40)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(10, 40)}, 7: 7}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_number_of_positions_gives_the_same_components(spark, monkeypatch):
    """Keys of one, two and three positions meet pairs that share fewer than four bytes; the tally drops them."""
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for i in range(40):
        x = fps[i]
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        fps.append(x)
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    # one byte, two and three in common
    fps += [(fps[1] & 0xFF) | (rng.getrandbits(56) << 8) for _ in range(30)] + [(fps[2] & 0xFFFFFF) | (rng.getrandbits(40) << 24) for _ in range(30)]
    want = closed(fps, list(range(len(fps))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for r in (1, 2, 3, 4):
        for long_list in (1024, 16):
            monkeypatch.setattr(simhash, "positions", lambda n, r=r: r)
            monkeypatch.setattr(simhash, "LONG_LIST", long_list)
            label = {x: x for x in signed}

            def top(x):
                while label[x] != x:
                    x = label[x]
                return x

            for row in simhash.links(df).collect():
                label[top(row["u"])] = top(row["v"])
            groups, wanted = {}, {}
            for i, x in enumerate(signed):
                groups.setdefault(top(x), set()).add(i)
                wanted.setdefault(want[i], set()).add(i)
            assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values())), (r, long_list)
    monkeypatch.undo()
    assert [simhash.positions(n) for n in (0, 5_000, 1_000_000, 100_000_000, 10**10)] == [1, 1, 2, 3, 4]


def test_a_dense_group_hands_on_few_links(spark):
    rng = random.Random(5)
    base, near = rng.getrandbits(63), set()
    while len(near) < 2000:
        x = base
        for b in rng.sample(range(63), rng.randint(1, 2)):
            x ^= 1 << b
        near.add(x)
    found = simhash.links(spark.createDataFrame([(x,) for x in near], "fp long").repartition(3), 5)
    assert found.count() < 2 * len(near)
    assert {(r.node, r.root) for r in components(found).collect()} == {(x, min(near)) for x in near}
