"""Clusters with restarts and networks across a cut, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.operators import kmeans, select, split


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((60, 3)) + c for c in ((0, 0, 0), (4, 0, 0), (0, 4, 0), (0, 0, 4))])
    rows = [(i, v.tolist(), int(i // 60) if i % 30 == 0 and i < 120 else -1) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, y int").repartition(4), x, np.array([r[2] for r in rows])


@pytest.mark.parametrize("constrained", [False, True])
def test_restarts_against_numpy(spark, clouds, constrained):
    df, x, y = clouds
    model = kmeans.SeededKMeans(5, "id", "v", "y", constrained=constrained, max_iter=6, n_init=3, seed=1).fit(df)
    found = []
    for r in range(3):
        order = [row.id for row in df.where("y = -1").orderBy(select.hash_order("id", seed=1 + r), "id").limit(10).collect()]
        spare, taken = [x[i] for i in order], 5
        c = np.array([x[y == k].mean(0) if k < 2 else spare[k] for k in range(5)])

        def cluster(c):
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            return np.where(y >= 0, y, near) if constrained else near

        for _ in range(6):
            near, old = cluster(c), c.copy()
            for k in range(5):
                if (near == k).any():
                    c[k] = x[near == k].mean(0)
                else:
                    c[k], taken = spare[taken % 10], taken + 1
            if np.linalg.norm(c - old) < 1e-4:
                break
        found.append((((x - c[cluster(c)]) ** 2).sum(), c))
    assert model.inertias == pytest.approx([v for v, _ in found])
    best = min(range(3), key=lambda r: found[r][0])
    assert np.array(model.centres) == pytest.approx(found[best][1])
    assert len(set(np.round(model.inertias, 6))) > 1


def test_empty_clusters_and_missing_vectors(spark):
    rows = [(i, [float(i % 2), 0.0], -1) for i in range(20)] + [(99, None, -1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    model = kmeans.SeededKMeans(4, "id", "v", n_init=2, max_iter=3).fit(df)
    out = {r.id: r for r in model.predict(df).collect()}
    assert out[99].cluster is None and out[99].d2 is None and max(r.d2 for r in out.values() if r.d2 is not None) == pytest.approx(0)
    assert model.transform(df).where("id = 99").first().distances is None
    all_named = kmeans.SeededKMeans(2, "id", "v", "z", n_init=5).fit(df.withColumn("z", (F.col("id") % 2).cast("int")))
    assert len(all_named.inertias) == 1  # every cluster has labels: there is nothing to restart


def test_one_job_for_all_restarts(spark, clouds):
    df, _, _ = clouds
    centres = np.random.default_rng(0).standard_normal((7, 4, 3))
    sums = kmeans.restart_sums(df, "v", centres)
    assert {r for r, _ in sums} == set(range(7)) and all(sum(n for (r, _), (n, _, _) in sums.items() if r == k) == 240 for k in range(7))


# --- networks across a cut ---


def numpy_run(xs, y, ids, layers, merge, rate, batches, epochs):
    """The same network in one place."""
    bottoms, chain = layers
    act = {"tanh": np.tanh, "identity": lambda z: z, "relu": lambda z: np.maximum(z, 0)}
    slope = {"tanh": lambda o: 1 - o * o, "identity": np.ones_like, "relu": lambda o: (o > 0) * 1.0}
    ones, losses = (lambda a: np.c_[a, np.ones(len(a))]), []
    for _ in range(epochs):
        for b in range(batches):
            at = ids % batches == b
            ins = [x[at] for x in xs]
            outs = [act[a](ones(x) @ w) for x, (w, a) in zip(ins, bottoms)]
            h = np.concatenate(outs, 1) if merge == "concat" else sum(outs)
            held = []
            for w, a in chain:
                o = act[a](ones(h) @ w)
                held.append((h, o))
                h = o
            s = h[:, 0]
            losses.append(np.mean(np.log1p(np.exp(s)) - y[at] * s))
            d, n = (1 / (1 + np.exp(-s)) - y[at])[:, None], at.sum()
            moved = []
            for (w, a), (i, o) in zip(reversed(chain), reversed(held)):
                dz = d * slope[a](o)
                moved.insert(0, (w - rate * ones(i).T @ dz / n, a))
                d = dz @ w[:-1].T
            k, below = 0, []
            for x, o, (w, a) in zip(ins, outs, bottoms):
                own = d[:, k : k + w.shape[1]] if merge == "concat" else d
                k += w.shape[1]
                below.append((w - rate * ones(x).T @ (own * slope[a](o)) / n, a))
            bottoms, chain = below, moved
    return bottoms, chain, losses


@pytest.mark.parametrize("merge", ["concat", "add"])
def test_parties_train_the_network_of_one_place(spark, merge):
    rng = np.random.default_rng(9)
    n = 300
    x = rng.standard_normal((n, 5))
    y = (x[:, 0] * x[:, 3] + x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(n)], "id long, y double, " + ", ".join(f"c{k} double" for k in range(5))).repartition(5)
    parts = {"one": ["c0", "c1"], "two": ["c2", "c3", "c4"]}
    bottoms = {name: split.Layer.random(name, len(c), 4, k) for k, (name, c) in enumerate(parts.items())}
    chain = [split.Layer.random("server", 8 if merge == "concat" else 4, 3, 5, "relu"), split.Layer.random("one", 3, 1, 6, "identity")]
    start = [(x.weights.copy(), x.activation) for x in bottoms.values()], [(x.weights.copy(), x.activation) for x in chain]
    model = split.SplitTraining(bottoms, chain, merge, 0.8, batches=3, epochs=3, batch_of=lambda i: i % 3)
    inputs = {name: split.vectors(df, "id", c).unionByName(split.vectors(df.limit(1).withColumn("id", F.lit(-3).cast("long")), "id", c) if name == "two" else split.vectors(df.limit(0), "id", c)) for name, c in parts.items()}
    model.fit(inputs, df.select("id", "y"))
    low, high, losses = numpy_run([x[:, :2], x[:, 2:]], y, np.arange(n), start, merge, 0.8, 3, 3)
    for own, (w, _) in zip([*bottoms.values(), *chain], [*low, *high], strict=True):
        assert own.weights == pytest.approx(w, abs=1e-9)
    assert model.losses == pytest.approx(losses, abs=1e-9) and np.mean(losses[-3:]) < np.mean(losses[:3])
    assert model.predict(inputs).count() == n


def test_what_crosses_a_cut(spark):
    """Ids with activations one way, ids with gradients the other: no features, labels or weights."""
    df = spark.createDataFrame([(i, [0.1 * i, 1.0], [0.5]) for i in range(6)], "id long, x array<double>, d array<double>")
    layer = split.Layer.random("p", 2, 1, 0)
    held = split.forward(df.select("id", "x"), layer)
    back = split.backward(held.join(df.select("id", "d"), "id"), layer)
    assert back.columns == ["id", "d"] and {len(r.d) for r in back.collect()} == {2} and {len(r.out) for r in held.collect()} == {1}


def test_an_empty_batch_moves_nothing(spark):
    df = spark.createDataFrame([(2, 1.0, 0.5)], "id long, y double, a double")
    layer, top = split.Layer.random("p", 1, 1, 0), split.Layer.random("s", 1, 1, 1, "identity")
    before = layer.weights.copy()
    model = split.SplitTraining({"p": layer}, [top], batches=2, batch_of=lambda i: i % 2)
    assert model.step({"p": split.vectors(df.limit(0), "id", ["a"])}, df.select("id", "y").limit(0)) == 0 and (layer.weights == before).all()
    model.fit({"p": split.vectors(df, "id", ["a"])}, df.select("id", "y"))
    assert model.losses[1] == 0 and model.losses[0] > 0


# --- which epoch is kept ---


def test_best_epoch_by_any_measure(spark):
    from coterie.operators import linear, metrics

    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 2))
    y = (x[:, 0] + 0.8 * rng.standard_normal(200) > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(200)], "id long, y int, a double, b double")
    model = linear.LinearModel(["a", "b"], "y", logistic=True, epochs=5, learning_rate=30.0, best_by=("acc", "auc", "ks")).fit(df, validate=df)
    assert [sorted(h) for h in model.history] == [["acc", "auc", "epoch", "ks", "loss"]] * 5
    best, last = {}, None
    for h in model.history:
        for name in ("acc", "auc", "ks"):
            if h[name] > best.get(name, -9):
                best[name], last = h[name], h
    rows = model.predict(df).withColumnRenamed("probability", "p")
    assert model.loss(df) == pytest.approx(last["loss"]) and metrics.auc(rows).first().auc == pytest.approx(last["auc"])
    plain = linear.LinearModel(["a", "b"], "a", epochs=3, learning_rate=0.3, best_by=("r2",)).fit(df, validate=df)
    assert plain.history[-1]["r2"] == max(h["r2"] for h in plain.history)
    with pytest.raises(ValueError, match="no measures"):
        linear.LinearModel(["a"], "y", best_by=("auc",)).fit(df, validate=df)


def test_clients_of_any_type(spark):
    from coterie.operators import federated

    rows = [(f"site {k % 3}", 1.0, float(k), 2.0 * k + 1) for k in range(30)]
    df = spark.createDataFrame(rows, "client_id string, x0 double, x1 double, y double")
    same = df.withColumn("client_id", F.substring("client_id", 6, 1).cast("long") + 5_000_000_000)
    a, b = (federated.train(d, ["x0", "x1"], "y", rounds=2, rate=0.001, method="scaffold") for d in (df, same))
    assert a == pytest.approx(b) and a != [0, 0]


def test_inputs_of_split_training_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(90, numPartitions=2).select("id", F.array(F.sin("id"), F.cos("id")).alias("x"))
    layers = [split.Layer.random("a", 2, 2, 1), split.Layer.random("b", 2, 2, 2), split.Layer.random("a", 2, 1, 3, "identity")]
    model = split.SplitTraining({"a": layers[0]}, layers[1:], batches=2, epochs=2)
    model.fit({"a": df.mapInArrow(count, df.schema)}, df.select("id", (F.col("id") % 2).alias("y")))
    assert made.value == 90 and len(model.losses) == 4
