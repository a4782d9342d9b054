"""Boosting of several classes, between parties, and Shapley values, against independent computations."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.operators import evaluate, private_trees, shap, trees
from coterie.sources import writers


@pytest.fixture(scope="module")
def three_classes(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.standard_normal((500, 4)), 2)
    y = np.argmax(np.c_[x[:, 0], x[:, 1] + x[:, 2], -x[:, 0]] + 0.3 * rng.standard_normal((500, 3)), 1)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(500)], "id long, y int, a double, b double, c double, d double").repartition(5).cache()
    return df, x, y


def boost(x, y, k, edges, rounds, depth, lam=0.1, gamma=0.0, rate=0.3, square_bins=False):
    """Scores of boosting, one row set at a time; binary with k = 1."""
    n = len(x)
    score = np.zeros((n, k))
    for _ in range(rounds):
        if k > 1:
            e = np.exp(score - score.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            g, h = p - np.eye(k)[y], p * (1 - p)
        else:
            p = 1 / (1 + np.exp(-score))
            g, h = p - y[:, None], p * (1 - p)
        value = np.zeros((n, k))

        def part(rows, f):
            if square_bins:
                code = np.searchsorted(edges[f], x[rows, f], side="left")
                return sum((g[rows][code == b].sum(0) ** 2 for b in set(code)), np.zeros(k)) / (h[rows].sum(0) + lam)
            return 0.5 * g[rows].sum(0) ** 2 / (h[rows].sum(0) + lam)

        def grow(rows, level):
            best = None
            if level < depth and len(rows) >= 3:
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        left = x[rows, f] <= e
                        if left.any() and not left.all():
                            a, b = rows[left], rows[~left]
                            gain = 0.5 * (part(a, f) + part(b, f) - part(rows, f)).sum() - gamma
                            if best is None or gain > best[0] + 1e-12:
                                best = (gain, a, b)
            if best and best[0] > 1e-7:
                grow(best[1], level + 1)
                grow(best[2], level + 1)
            else:
                value[rows] = -g[rows].sum(0) / (h[rows].sum(0) + lam)

        grow(np.arange(n), 0)
        score += rate * value
    return score


def by_id(df, c):
    return np.array([r[c] for r in df.orderBy("id").collect()])


def edges_of(x, bins):
    return [sorted({np.sort(c)[max(1, len(c) * (k + 1) // bins) - 1] for k in range(bins)})[:-1] for c in x.T]


@pytest.mark.parametrize("square_bins", [False, True])
def test_three_rounds_of_three_classes(spark, three_classes, square_bins):
    df, x, y = three_classes
    model = trees.BoostedTrees(list("abcd"), "y", "id", "multi", 3, trees.TreeParams(max_bin=8, max_depth=3, reg_gamma=0.0, square_bins=square_bins)).fit(df)
    want = boost(x, y, 3, edges_of(x, 8), 3, 3, square_bins=square_bins)
    got = by_id(df.select("id", model.raw().alias("s")), "s")
    assert got == pytest.approx(want, abs=1e-9)
    out = model.predict(df)
    assert by_id(out, "prediction").tolist() == want.argmax(1).tolist()
    e = np.exp(want)
    assert by_id(out, "probabilities") == pytest.approx(e / e.sum(1, keepdims=True), abs=1e-9)
    assert model.score(df).first().acc == pytest.approx((want.argmax(1) == y).mean())
    assert {r.feature for r in model.importances(spark, "cover").collect()} <= set("abcd") and "leaf" in model.text()


def test_saved_and_resumed_classes(spark, three_classes, tmp_path):
    df, _, _ = three_classes
    params = trees.TreeParams(max_depth=2, reg_gamma=0.0)
    whole = trees.BoostedTrees(list("abcd"), "y", "id", "multi", 2, params).fit(df)
    writers.save_trees(whole, spark, str(tmp_path / "m"))
    loaded = writers.load_trees(spark, str(tmp_path / "m"))
    again = trees.BoostedTrees(list("abcd"), "y", "id", "multi", 2, params, loaded, whole.edges, 3)
    assert by_id(df.select("id", again.raw().alias("s")), "s") == pytest.approx(by_id(df.select("id", whole.raw().alias("s")), "s"))
    more = trees.BoostedTrees(list("abcd"), "y", "id", "multi", 2, params, loaded[:1], whole.edges, 3).resume(df)
    assert more.text() == whole.text()
    sampled = trees.BoostedTrees(list("abcd"), "y", "id", "multi", 2, trees.TreeParams(leaf_wise=True, max_leaves=4, goss=(0.3, 0.2), colsample=0.5, reg_gamma=0.0)).fit(df)
    assert sampled.score(df).first().acc > 0.5 and all(t.n == 250 for t in sampled.trees)


# --- contributions ---


def expected(tree, row, known, features, lam):
    """A tree's value if only some features are known: the others follow the training rows."""
    if tree.feature is None:
        return np.atleast_1d(trees.leaf_weight(tree.g, tree.h, lam))
    if tree.feature in known:
        v = row[features.index(tree.feature)]
        return expected(tree.right if v is not None and v > tree.threshold else tree.left, row, known, features, lam)
    return sum(expected(t, row, known, features, lam) * t.n / tree.n for t in (tree.left, tree.right))


def shapley(model, row):
    features = list(model.features)
    m, lam = len(features), model.params.reg_lambda
    value = lambda known: model.params.rate * sum(expected(t, row, known, features, lam) for t in model.trees)
    out = []
    for f in features:
        rest = [c for c in features if c != f]
        out.append(sum(factorial(k) * factorial(m - k - 1) / factorial(m) * (value({*s, f}) - value(set(s))) for k in range(m) for s in combinations(rest, k)))
    return value(set()), out


@pytest.mark.parametrize("task", ["binary", "regression", "multi"])
def test_contributions_against_all_subsets(spark, task):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((300, 6)), 1)
    z = x[:, 0] * x[:, 1] + x[:, 2] - (x[:, 3] > 0) * x[:, 4]
    y = {"binary": (z > 0).astype(int), "regression": z, "multi": np.digitize(z, [-0.5, 0.5])}[task]
    features = list("abcdef")
    rows = [(i, float(y[i]), *[None if (i + k) % 17 == 0 else float(v) for k, v in enumerate(x[i])]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y double, " + ", ".join(f"{c} double" for c in features)).repartition(3)
    model = trees.BoostedTrees(features, "y", "id", task, 2, trees.TreeParams(max_depth=5, reg_gamma=0.0)).fit(df)
    out = {r.id: r for r in shap.contributions(model, df, ["id", "y"]).collect()}
    raw = {r.id: np.atleast_1d(r.s) for r in df.select("id", model.raw().alias("s")).collect()}
    assert len(out) == 300
    for i, r in out.items():
        got = np.array([np.atleast_1d(r[c]) for c in features])
        assert np.atleast_1d(r.base) + got.sum(0) == pytest.approx(raw[i], abs=1e-9)
        if i % 40 == 0:
            base, want = shapley(model, rows[i][2:])
            assert np.atleast_1d(r.base) == pytest.approx(base, abs=1e-9) and got == pytest.approx(np.array(want), abs=1e-9)
    means = {r.feature: r.importance for r in shap.shap_importance(model, df).collect()}
    assert means == pytest.approx({c: np.mean([np.mean(np.abs(r[c])) for r in out.values()]) for c in features})


def test_importance_by_way(spark, three_classes):
    df, _, _ = three_classes
    for way in ("split", "cover"):
        found = {r.feature: r.importance for r in evaluate.tree_importance(df, list("abcd"), "y", task="multi", way=way, trees=2).collect()}
        assert sorted(found) == list("abcd") and sum(found.values()) == pytest.approx(1)
    found = {r.feature: r.importance for r in evaluate.tree_importance(df, list("abcd"), "y", task="multi", way="shap", trees=2).collect()}
    assert found["a"] > found["d"]
    lone = trees.BoostedTrees(["a"], "y", "id", "multi", 1, trees.TreeParams(max_depth=0), classes=3).fit(df)
    assert shap.contributions(lone, df, ["id"]).agg(F.max(F.abs(F.col("a")[0]))).first()[0] == 0


# --- between parties ---


def split_between_parties(df):
    return df.select("id", "y", "a"), {"two": df.select("id", "b", "c"), "three": df.where("id >= 0").select("id", "d")}


@pytest.mark.parametrize("task", ["binary", "regression"])
def test_parties_grow_the_plain_trees(spark, three_classes, task):
    df, _, _ = three_classes
    label = F.when(F.col("y") == 1, 1).otherwise(0) if task == "binary" else F.col("b") * F.col("c") + F.col("a")
    # shifted apart, so that a threshold tells whose it is
    df = df.select("id", label.alias("y"), "a", F.when(F.col("id") % 13 != 0, F.col("b") + 10).alias("b"), (F.col("c") + 20).alias("c"), (F.col("d") + 30).alias("d"))
    params, rounds = trees.TreeParams(max_bin=8, max_depth=3, reg_gamma=0.0), 2 if task == "binary" else 1
    plain = trees.BoostedTrees(list("abcd"), "y", "id", task, rounds, params).fit(df)
    active, others = split_between_parties(df)
    others["two"] = others["two"].unionByName(spark.createDataFrame([(9999, 1.0, 1.0)], "id long, b double, c double"))  # an id that others lack
    key = private_trees.crypto.Paillier.generate(256, seed=5)
    parties = [private_trees.PassiveParty("two", ["b", "c"]), private_trees.PassiveParty("three", ["d"])]
    model = private_trees.PrivateBoostedTrees(["a"], "y", "id", parties, key, task, rounds, params, zeros=6).fit(active, others)
    want, got = by_id(plain.predict(df), "prediction"), by_id(model.predict(active, others), "prediction")
    assert got == pytest.approx(want, abs=1e-6)

    def shape(x):
        return None if x.left is None else (x.feature or x.party, shape(x.left), shape(x.right))

    owner = {"a": "a", "b": "two", "c": "two", "d": "three"}

    def plain_shape(x):
        return None if x.left is None else (owner[x.feature], plain_shape(x.left), plain_shape(x.right))

    assert [shape(t) for t in model.trees] == [plain_shape(t) for t in plain.trees]
    own = model.table(spark).collect()
    assert {r.feature for r in own} <= {"a", None} and all((r.threshold is None) == (r.feature is None) for r in own)
    assert {r.party for r in own} >= {"two"}
    kept = [r for x in parties for r in x.table(spark).collect()]
    assert {r.feature for r in kept} <= set("bcd") and len(kept) == sum(r.record is not None for r in own)
    assert all(r.threshold < 5 for r in own if r.threshold is not None) and all(r.threshold > 5 for r in kept)


@pytest.fixture
def joins(spark, monkeypatch):
    """Plan lines of the joins by id in all that is written or collected."""
    lines = []

    def noted(run):
        def call(x, *args, **kwargs):
            lines.extend(line for line in x._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [id#" in line)
            return run(x, *args, **kwargs)

        return call

    frame = type(spark.range(1))
    monkeypatch.setattr(private_trees, "stash", noted(private_trees.stash))
    monkeypatch.setattr(frame, "collect", noted(frame.collect))
    return lines


def test_rows_are_not_broadcast(three_classes, joins):
    """Tables of rows are small here, as their files may be at any number of rows; none is gathered for a join by id."""
    df, _, _ = three_classes
    active, others = split_between_parties(df.withColumn("y", (F.col("y") == 1).cast("int")))
    parties = [private_trees.PassiveParty("two", ["b", "c"]), private_trees.PassiveParty("three", ["d"])]
    key = private_trees.crypto.Paillier.generate(256, seed=5)
    model = private_trees.PrivateBoostedTrees(["a"], "y", "id", parties, key, n_trees=1, params=trees.TreeParams(max_bin=4, max_depth=2, reg_gamma=0.0), zeros=6).fit(active, others)
    assert len(model.predict(active, others).collect()) == 500
    assert len(joins) > 10 and all("SortMergeJoin" in line for line in joins)


def test_query_of_a_private_table_broadcasts_no_rows(spark, joins):
    from coterie.plans import registry

    kinds = {(r.kind, r.n) for r in registry.QUERIES["private_boost_table"](spark, "/root/testdata/sf0.001").collect()}
    assert kinds == {("split", 1), ("leaf", 2)}
    assert len(joins) > 5 and all("SortMergeJoin" in line for line in joins)


def test_packed_bins_and_siblings(spark):
    key = private_trees.crypto.Paillier.generate(512, seed=6)
    crypto = private_trees.crypto
    rng = np.random.default_rng(1)
    rows = [(int(n), int(b), float(g), float(abs(g))) for n, b, g in zip(rng.integers(1, 3, 200), rng.integers(0, 7, 200), rng.standard_normal(200))]
    df = spark.createDataFrame(rows + [(1, 9, 1.5, 0.5)], "node int, f0 int, g double, h double")
    bits = crypto.packed_bits(201, 5.0, key)
    assert crypto.capacity(key, 2 * bits) >= 4
    sent = df.select("node", "f0", crypto.encrypt_packed([F.col("g"), F.col("h")], key, key.zeros(4), bits).alias("c"))
    child = private_trees.bin_sums(sent.where("node = 1"), ["f0"], key.public)
    parent = private_trees.bin_sums(sent.withColumn("node", F.lit(0)), ["f0"], key.public)
    other = private_trees.sibling_sums(parent, child, [(0, 1, 2)], key.public)
    got = {(r.node, r.bin): (r.g, r.h, r.n) for r in private_trees.sent_histogram(child.unionByName(other), key, bits).collect()}
    want = {(r.node, r.bin): (r.g, r.h, r.n) for r in trees.histogram(df, ["f0"]).collect()}
    assert sorted(got) == sorted(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)
    with pytest.raises(ValueError, match="no room"):
        crypto.capacity(crypto.Paillier.generate(64, seed=1), 96)


def test_rows_are_made_once(spark):
    """What the rows come from runs once per fit."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(600, numPartitions=3).select("id", (F.col("id") % 7 > 2).cast("int").alias("y"), (F.col("id") % 50).cast("double").alias("a"), F.sin("id").alias("b"))
    model = trees.BoostedTrees(["a", "b"], "y", "id", n_trees=2, params=trees.TreeParams(max_depth=3, reg_gamma=0.0)).fit(df.mapInArrow(count, df.schema))
    assert made.value == 600 and len(model.trees) == 2
