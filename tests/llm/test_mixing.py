import random
from collections import defaultdict

from pyspark.sql import functions as F

from coterie.llm import mixing


def water(sizes):
    """Targets by literal resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over or free == 0:
            return target
        capped |= over
        if len(capped) == len(order):
            return {s: 3 * sizes[s] for s in order}


def test_targets_and_draws(spark):
    rng = random.Random(5)
    rows = []
    sources = ["a", "b", "c", "É", "z1", None, "B", "empty"]
    for i in range(3000):
        s = "a" if rng.random() < 0.4 else rng.choice(sources[:-1])
        if s == "z1" and rng.random() < 0.95:
            s = "b"
        rows.append((i, " ".join(["wörd"] * rng.choice([0, 1, 5, 40, 300])) + rng.choice(["", " ", "\n"]), s, 1, "x"))
    rows += [(5000, None, "empty", 1, "x"), (5001, "  ", "empty", 1, "x"), (None, "no id here", "b", 1, "x"), (7, "again and again", "c", 1, None), (7, "again and again", "c", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, no int, words string")
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, text, s, *_ in rows:
        sizes[s] += len((text or "").encode().split())
    want = water(sizes)
    taken, got = defaultdict(int), {}
    for r in out:
        assert r.mix_size == len((r.text or "").encode().split())
        assert r.mix_source_size == sizes[r.source] and 0 <= r.mix_copies <= 3 and len(r.mix_shards) == r.mix_copies
        assert all(0 <= s < 16 for s in r.mix_shards)
        taken[r.source] += r.mix_size * r.mix_copies
        got[r.source] = r.mix_target
    for s, t in want.items():
        assert abs(got[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 301, (s, taken[s], t)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    copies = mixing.mix(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r.mix_copies for r in out)
    shards = docs.select(F.lit(1)).count() and defaultdict(int)
    for r in out:
        for s in r.mix_shards:
            shards[s] += 1
    assert len(shards) == 16 and max(shards.values()) < 3 * min(shards.values())


def test_no_rows_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.mix_target, r.mix_copies) for r in mixing.mixed(blank).collect()] == [(0.0, 0)] * 2
    one = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    assert [(r.mix_target, r.mix_copies) for r in mixing.mixed(one).collect()] == [(2.0, 1)]


def test_one_row_repeated_for_a_third_of_a_source(spark):
    """Equal rows are taken one by one, so the target is met within one document."""
    rng = random.Random(2)
    rows = [(None, "ten words " * 5, "a", 1)] * 100 + [(i, "w " * rng.randint(1, 30), "a", 1) for i in range(200)]
    rows += [(1000 + i, "some more words here " * rng.randint(1, 9), s, 2) for i, s in enumerate("bcdb" * 120)]
    rows += [(7, "same again " * 4, "d", 3)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    sizes, taken, by_row = defaultdict(int), defaultdict(int), defaultdict(set)
    for _, text, s, _ in rows:
        sizes[s] += len(text.split())
    out = mixing.mixed(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.source, r.n) for r in out))) == sorted(map(str, rows))
    for r in out:
        taken[r.source] += r.mix_size * r.mix_copies
        by_row[r.source, r.text].add(r.mix_copies)
        assert 0 <= r.mix_copies <= 3 and len(r.mix_shards) == r.mix_copies
    for s, t in water(sizes).items():
        assert abs(taken[s] - t) <= 36, (s, taken[s], t)
    alone = spark.createDataFrame([(None, "ten words " * 5, "a")] * 100 + [(i, "x y", "b") for i in range(20)], "doc_id long, text string, source string")
    t = water({"a": 1000, "b": 40})
    got = mixing.mixed(alone).collect()
    assert abs(sum(r.mix_size * r.mix_copies for r in got if r.source == "a") - t["a"]) <= 5
    assert sorted(map(str, mixing.mixed(alone.repartition(5)).collect())) == sorted(map(str, got))
