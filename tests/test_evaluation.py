"""Chi-square merging and rank correlation against plain loops and pandas."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coterie.functions import crypto, merging
from coterie.functions.ordered import numbered
from coterie.operators import evaluate


def loop(values, labels, max_group):
    """The greedy merge as it is told: look at all pairs, merge the first of least chi-square."""
    classes = sorted(set(labels))
    groups = [[u, np.array([np.sum((values == u) & (labels == k)) for k in classes], float)] for u in sorted(set(values))]

    def chi(a, b):
        out = 0.0
        for own in (a, b):
            e = own.sum() * (a + b) / (a + b).sum()
            out += np.where(e > 0, (own - e) ** 2 / np.where(e > 0, e, 1), 0).sum()
        return out

    while len(groups) > max_group:
        k = int(np.argmin([chi(groups[i][1], groups[i + 1][1]) for i in range(len(groups) - 1)]))
        groups[k][1] = groups[k][1] + groups.pop(k + 1)[1]
    return [g[0] for g in groups]


@pytest.mark.parametrize("classes", [1, 2, 3])
def test_heap_equals_the_loop(classes):
    rng = np.random.default_rng(classes)
    for n, distinct in ((40, 10), (300, 60), (300, 300), (5, 5)):
        v = rng.integers(0, distinct, n)
        y = rng.integers(0, classes, n)
        counts = np.array([[np.sum((v == u) & (y == k)) for k in sorted(set(y))] for u in sorted(set(v))])
        for left in (1, 3, 5, 1000):
            assert [sorted(set(v))[k] for k in evaluate.merged_groups(counts, left)] == loop(v, y, left)


def test_many_distinct_values():
    rng = np.random.default_rng(0)
    counts = np.eye(2)[rng.integers(0, 2, 200_000)]
    began = time.process_time()
    assert len(evaluate.merged_groups(counts, 5)) == 5
    assert time.process_time() - began < 20


def shares(kind, n):
    """Counts of n values: by chance, one class after the other, the same shares all over, one merge after another."""
    rng = np.random.default_rng(n)
    if kind == "chance":
        return np.eye(2)[rng.integers(0, 2, n)] * rng.integers(1, 4, n)[:, None]
    if kind == "three":
        return rng.integers(0, 4, (n, 3)) + [[1, 0, 0]]
    if kind == "step":
        return np.eye(2)[(np.arange(n) > n // 3).astype(int)]
    return np.eye(2)[np.arange(n) % 2] if kind == "chain" else np.full((n, 2), 3)


@pytest.mark.parametrize("kind", ["chance", "three", "step", "same", "chain"])
def test_blocks_of_values_equal_one_loop(spark, kind):
    n, block = 900, 40
    counts = shares(kind, n).astype(float)
    table = spark.createDataFrame([("a", float(k), c) for k, c in enumerate(counts.tolist())], "feature string, value double, counts array<double>").repartition(5)
    table = table.unionByName(table.where("value < 30").withColumn("feature", F.lit("b")))
    for left in (5,) if kind != "same" else (1, 5):
        want = [("a", k + 1, float(v)) for k, v in enumerate(merging.greedy(counts, range(n), left)[0])] + [("b", k + 1, float(v)) for k, v in enumerate(merging.greedy(counts[:30], range(30), left)[0])]
        assert sorted(map(tuple, merging.merged(table, left, block).collect())) == want
    sizes = {r["feature"]: r["count"] for r in merging.shrunk(table, 5, block).groupBy("feature").count().collect()}
    assert sizes["b"] == 30 and (sizes["a"] <= 4 * block or kind == "chain")


def test_a_cut_is_dropped_once_it_comes_within_the_level():
    far, near = [(-1.0, 0.0, 9.0, 0.0)], [(-1.0, 0.0, 0.0, 9.0)]
    assert not merging.crossed(far, near, 2.0)
    assert merging.crossed(far, [*near, (1.0, 5.0, 9.0, 9.0), (1.5, 6.0, 40.0, 9.0)], 2.0)


def test_features_of_two_parties(spark):
    rng = np.random.default_rng(4)
    n = 400
    a, b, y = rng.integers(0, 25, n), np.round(rng.standard_normal(n), 1), rng.integers(0, 3, n)
    y = np.where(a > 12, y, 0)
    rows = [(i, int(a[i]), None if i % 50 == 0 else float(b[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a int, b double, y int").repartition(4)
    held = np.arange(n) % 50 != 0
    want = sorted([("a", k + 1, float(v)) for k, v in enumerate(loop(a, y, 4))] + [("b", k + 1, v) for k, v in enumerate(loop(b[held], y[held], 4))])
    plain = evaluate.chi_merge_all(df, ["a", "b"], "y", 4)
    assert sorted(map(tuple, plain.collect())) == want
    key = crypto.Paillier.generate(512, seed=2)
    private = evaluate.private_chi_merge(df.select("id", "a", "b"), df.select("id", "y"), "id", ["a", "b"], "y", key, 4, zeros=6)
    assert sorted(map(tuple, private.collect())) == want
    lows = [v for f, _, v in want if f == "b"]
    for r in evaluate.chi_bin(df, plain).select("id", "b").collect():
        assert r.b == (None if r.id % 50 == 0 else f"group{max(1, sum(b[r.id] >= e for e in lows))}")
    assert evaluate.chi_merge_all(df.limit(0), ["a"], "y").count() == 0


def test_query_merges_the_features_of_both_parties(spark):
    import oracle

    from coterie.plans import fixtures, registry

    sf, want = "/root/testdata/sf0.001", []
    con = oracle.connect(sf)
    features = [c for c in con.execute(f"WITH {fixtures.JOINED} SELECT * FROM joined LIMIT 0").df() if c not in ("id", "y")]
    for c in features:
        rows = con.execute(f"WITH {fixtures.JOINED} SELECT {c}, count(*) FILTER (y = 0), count(*) FILTER (y = 1) FROM joined GROUP BY 1 ORDER BY 1").fetchall()
        kept = merging.greedy([r[1:] for r in rows], range(len(rows)), 5)[0]
        want += [(c, k + 1, float(rows[i][0])) for k, i in enumerate(kept)]
    assert {"o_totalprice", "priority", "sum_price"} <= set(features)
    assert sorted(map(tuple, registry.QUERIES["chi_merge_features"](spark, sf).collect())) == sorted(want)


def test_rank_correlation_with_nulls(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_normal((300, 4)), 1)
    x[:, 1] += 0.5 * x[:, 0]
    x[rng.random((300, 4)) < 0.3] = np.nan
    frame = pd.DataFrame(x, columns=list("abcd")).assign(e=2.0, f=np.nan)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()], ", ".join(f"{c} double" for c in "abcdef")).repartition(3)
    want = frame.corr(method="spearman").fillna(0)
    for ranges in (2, 64):
        got = {(r.a, r.b): r.corr for r in evaluate.rank_correlation(df, list("abcdef"), ranges).collect()}
        assert len(got) == 36
        assert all(got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9) for a, b in got)
    assert {r.corr for r in evaluate.rank_correlation(df.limit(0), ["a", "b"]).collect()} == {0.0}


def test_numbers_of_ordered_rows(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("v"), (F.col("id") % 7).cast("string")).alias("v")).repartition(5)
    got = {r.id: r.rn for r in numbered(df, [F.col("v").desc(), F.col("id")]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(3000), key=lambda i: (-(i % 7), i))
    assert sorted(got.values()) == list(range(1, 3001))


def test_profile_with_importance(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((300, 2)), 1)
    y = (x[:, 0] > 0.3).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(300)], "id long, y int, a double, b double")
    rows = {r.feature: r for r in evaluate.profile(df, ["a", "b"], "y", k=2, importance="shap").collect()}
    assert rows["a"].shap > rows["b"].shap >= 0 and rows["a"].iv_rank == 1
    for k, c in enumerate("ab"):
        values, counts = np.unique(x[:, k], return_counts=True)
        order = np.lexsort((values, -counts))[:2]
        assert [rows[c].top1, rows[c].top2] == values[order].tolist() and rows[c].share1 == pytest.approx(counts[order[0]] / 300)
