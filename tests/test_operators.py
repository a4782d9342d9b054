"""Literal cases, properties and independent computations."""

import hashlib
import json
import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.functions import crypto, losses
from coterie.functions.ordered import quantiles, row_numbers, running
from coterie.operators import clean, evaluate, federated, intersect, kmeans, linear, metrics, neural, select, transform, trees
from coterie.party import PartyFrame, Role
from coterie.pipeline import FittedScale, Intersect, Model, Pipeline, Transform
from coterie.plans import tabular
from coterie.sources import readers, writers
from coterie.streaming import drift


def column(df, c):
    return [r[c] for r in df.orderBy("id").collect()]


@pytest.fixture(scope="module")
def two_classes(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = (x[:, 0] - x[:, 1] + 0.5 * rng.standard_normal(400) > 0).astype(int)
    return spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(400)], "id long, y int, a double, b double, c double").cache()


# --- literal cases ---


def test_bins(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 1, 2, 3])], "id long, v double")
    edges = transform.width_edges(df, ["v"], 3)
    assert edges["v"] == [1.0, 2.0] and column(transform.apply_bins(df, edges), "v") == [0, 0, 1, 2]
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "id long, v double")
    assert column(transform.apply_bins(df, transform.quantile_edges(df, ["v"], 4)), "v") == [0, 0, 1, 2, 3]
    with pytest.raises(ValueError):
        transform.quantile_edges(spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "id long, v double"), ["v"], 4)
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 9)], "id long, v double")
    assert transform.tree_edges(df, "v", 4) == [2, 4, 6, 8]


def test_cleaning(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 3), (4, 1), (5, 2), (6, None)], "id long, v int")
    assert column(clean.fill_mode(df, ["v"]), "v")[-1] == 1
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "id long, v double")
    assert df.agg(F.stddev_pop("v")).first()[0] == pytest.approx(0.816496580927726)
    assert column(clean.outliers_to_null(df, ["v"]), "v") == [None, 2.0, None, None]
    empty = spark.createDataFrame([(1, None, None, "x"), (2, 1, 1, "y"), (3, None, 2, None), (4, 4, 3, "z")], "id long, a int, b int, c string")
    kept = clean.drop_sparse(empty, 0.3, 0.3)
    assert kept.columns == ["id", "b", "c"] and [r.id for r in kept.orderBy("id").collect()] == [2, 4]
    with_dates = clean.parse_dates(spark.createDataFrame([(1, "2024-01-02"), (2, "no")], "id long, d string"), ["d"])
    assert column(with_dates, "d")[1] is None
    codes = clean.category_codes(spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "id long, v string"), "v", "id")
    assert {r.value: r.code for r in codes.collect()} == {"b": 0, "a": 1}


def test_transforms(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0), (2, 5.0, 0.0), (3, 5.0, 3.0)], "id long, u double, v double")
    assert column(transform.scale(df, ["u"]), "u") == [0, 0, 0]
    assert [tuple(r) for r in transform.normalize(df.select("id", "v"), ["v"]).orderBy("id").collect()] == [(1, 0.0), (2, 0.0), (3, 1.0)]
    assert column(transform.parse_label(spark.createDataFrame([(1, -1), (2, 1)], "id long, y int"), "y"), "y") == [0, 1]
    hot = transform.one_hot(spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id long, v string"), "v")
    assert [tuple(r) for r in hot.orderBy("id").collect()] == [(1, 0, 1), (2, 1, 0), (3, 0, 0)]


def test_empty_bin_woe(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0, 0), (3.0, 1), (3.0, 0)], "v double, y int")
    w = {r.bin: r.woe for r in evaluate.woe(df, ["v"], "y").collect()}
    assert w[0] == pytest.approx(math.log(1e-7 / (2 / 3 + 1e-7)))


def test_pca_against_numpy(spark, two_classes):
    x = np.array([list(r) for r in two_classes.orderBy("id").select("a", "b", "c").collect()])
    scores, fitted = transform.pca(two_classes, "id", ["a", "b", "c"], 2)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert fitted["explained_variance"] == pytest.approx(s[:2] ** 2 / 399)
    got = np.array([list(r)[1:] for r in scores.orderBy("id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(u[:, :2] * s[:2]))
    assert fitted["singular_values"] == pytest.approx(s[:2])


def test_chi_merge_against_a_loop(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 12, 500)
    y = (rng.random(500) < np.where(v < 4, 0.2, np.where(v < 9, 0.6, 0.9))).astype(int)
    got = evaluate.chi_merge(spark.createDataFrame([(int(a), int(b)) for a, b in zip(v, y)], "v int, y int"), "v", "y", 4).orderBy("grp").collect()
    groups = [[u, np.array([np.sum((v == u) & (y == k)) for k in (0, 1)], float)] for u in sorted(set(v))]

    def chi(a, b):
        t = np.array([a, b])
        e = t.sum(1, keepdims=True) * t.sum(0) / t.sum()
        return np.where(e > 0, (t - e) ** 2 / np.where(e > 0, e, 1), 0).sum()

    while len(groups) > 4:
        k = int(np.argmin([chi(groups[i][1], groups[i + 1][1]) for i in range(len(groups) - 1)]))
        groups[k][1] = groups[k][1] + groups.pop(k + 1)[1]
    assert [r.low for r in got] == [float(g[0]) for g in groups]
    same = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 1), (2, 0), (2, 0), (2, 1), (2, 1)], "v int, y int")
    assert evaluate.chi_adjacent(same, "v", "y").first().chi == 0


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal(3000), 2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double")
    rn = {r.id: r.rn for r in row_numbers(df, "v", ["id"]).collect()}
    assert [rn[i] for i in np.lexsort((np.arange(3000), v))] == list(range(1, 3001))
    down = {r.id: r.s for r in running(df, "v", ["id"], {"s": F.col("v")}, descending=True, peers=True).collect()}
    assert all(down[i] == pytest.approx(v[v >= v[i]].sum(), abs=1e-6) for i in range(0, 3000, 97))


def test_metrics_edges(spark, two_classes):
    ones = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    assert tuple(metrics.ks_value(ones).first()) == (-1.0, -1.0)
    assert metrics.auc(ones).first().auc is None
    s = two_classes.select("id", "y", losses.sigmoid(F.col("a")).alias("p"))
    a = metrics.auc(s).first()
    rows = s.collect()
    pos, neg = [r.p for r in rows if r.y], [r.p for r in rows if not r.y]
    assert a.auc == pytest.approx(np.mean([(x > z) + 0.5 * (x == z) for x in pos for z in neg]))
    assert a.gini == pytest.approx(2 * a.auc - 1)
    assert sum(r.n for r in metrics.score_histogram(s).collect()) == 400


def test_spearman_needs_known_method(two_classes):
    with pytest.raises(NotImplementedError):
        evaluate.correlation_matrix(two_classes, ["a"], "vif")


def test_information_values_are_not_negative(two_classes):
    assert all(r.iv >= 0 for r in evaluate.information_value(two_classes, ["a", "b", "c"], "y").collect())


@pytest.mark.parametrize("name", sorted(losses.LOSSES))
def test_loss_derivatives(spark, name):
    """Against numeric differences; in the raw score behind p for the cross-entropy family."""
    family = name in ("cross_entropy", "balanced_cross_entropy", "focal")
    ys, zs, d = ([0.0, 1.0] if family else [0.5, 2.0]), [-1.3, -0.2, 0.7, 1.9], 1e-4
    df = spark.createDataFrame([(y, z) for y in ys for z in zs], "y double, z double")
    link = losses.sigmoid if family else (lambda z: z)
    at = lambda k: losses.LOSSES[name](F.col("y"), link(F.col("z") + k))
    loss, g, h = at(0.0)
    out = df.select(g.alias("g"), h.alias("h"), ((at(d)[0] - at(-d)[0]) / (2 * d)).alias("g2"), ((at(d)[1] - at(-d)[1]) / (2 * d)).alias("h2")).collect()
    for r in out:
        assert r.g == pytest.approx(r.g2, abs=1e-5)
        assert name == "absolute" or r.h == pytest.approx(r.h2, abs=1e-4)


# --- parties and intersection ---


def test_party_frame(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 2.0), (2, 1, 3.0, 4.0), (2, 1, 5.0, 6.0)], "id long, y int, a double, b double")
    f = PartyFrame(df, "id", ("a", "b"), "y")
    p = PartyFrame(df.select("id", "a"), "id", ("a",))
    assert f.role is Role.ACTIVE and p.role is Role.PASSIVE and f.n_features == 2 and f.n_samples == 3
    with pytest.raises(ValueError):
        p.labels
    with pytest.raises(ValueError):
        f.filter_fields(["nope"])
    assert f.filter(spark.createDataFrame([(2,), (2,)], "x long")).n_samples == 2
    assert f.vertical_split(0.5)[1].feature_cols == ("a",) and f.vertical_split(0.5)[0].feature_cols == ("b",)
    assert [g.feature_cols for g in f.feature_split(2)] == [("a",), ("b",)] and f.feature_split(2)[0].label_col == "y"


def test_intersections_agree(spark):
    a = spark.range(0, 60).toDF("id")
    b = spark.createDataFrame([(i,) for i in range(40, 90)] + [(41,)], "k long")
    want = set(range(40, 60))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(intersect.intersect(a, b)) == ids(intersect.intersect(b, a)) == sorted(want)
    for option in ("md5", "sha256", "sm3"):
        assert ids(intersect.hashed_intersect(a, b, option)) == sorted(want)
    key = crypto.RSA.generate(256, seed=1)
    assert ids(intersect.blind_intersect(a, b, key)) == sorted(want)
    assert ids(intersect.blind_intersect(a, b, key, signed=intersect.sign_ids(a, key))) == sorted(want)
    decoys = ids(intersect.with_decoys(intersect.intersect(a, b), a, 0.5))
    assert len(decoys) == 30 and want < set(decoys)


def test_crypto():
    assert crypto.sm3(b"abc") == "66c7f0f462eeedd9d1f2d46bdc10e4e24167c4875cf2f7a2297da02b8f4ba8e0"
    assert crypto.sm3(b"abcd" * 16) == "debe9ff92275b8a138604889c18e5a4d6fdb70e5387e5765293dcba39c0c5732"
    sizes = [0, 3, 55, 56, 64, 119, 120, 1000]
    assert crypto.sm3_many([b"x" * n for n in sizes]) == [crypto.sm3(b"x" * n) for n in sizes]
    if "sm3" in hashlib.algorithms_available:
        assert all(crypto.sm3(b"x" * n) == hashlib.new("sm3", b"x" * n).hexdigest() for n in sizes)
    key = crypto.RSA.generate(256, seed=3)
    assert key.decrypt(key.encrypt(12345)) == 12345 and key.encrypt(key.sign(99)) == 99
    he = crypto.Paillier.generate(256, seed=4)
    a, b = he.encrypt(1.5), he.encrypt(-4.25)
    assert he.decrypt(he.add(a, b)) == -2.75 and he.decrypt(he.times(a, -2.0), 1) == -3.0
    assert he.encrypt(1.5) != a


def test_cipher_sum_of_groups(spark):
    key = crypto.Paillier.generate(256, seed=4)
    df = spark.createDataFrame([(i % 3, float(i) - 7.5) for i in range(60)], "g int, v double")
    enc = df.select("g", crypto.encrypt_column(F.col("v"), key, key.zeros(4)).alias("v"))
    got = crypto.cipher_sum(enc, ["g"], "v", key).select("g", crypto.decrypt_column(F.col("v"), key).alias("v")).collect()
    assert {r.g: r.v for r in got} == {g: sum(i - 7.5 for i in range(60) if i % 3 == g) for g in range(3)}


def test_ciphers_of_a_small_file_are_made_by_many_tasks(spark, tmp_path):
    rows = [(k, k % 25, float(k)) for k in range(640)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    read = spark.read.parquet(str(tmp_path / "supplier.parquet"))
    dealt = crypto.spread(read).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(dealt) >= 32 and max(r["count"] for r in dealt) < 64
    sums = tabular.paillier_group_sum(spark, str(tmp_path))
    assert "RoundRobinPartitioning" in sums._jdf.queryExecution().toString()
    assert {r.s_nationkey: r.total for r in sums.collect()} == {g: float(sum(range(g, 640, 25))) for g in range(25)}


# --- models ---


def test_trees_against_numpy(spark, two_classes):
    own, p = ["a", "b"], trees.TreeParams(max_bin=8, max_depth=2, reg_gamma=0.0)
    model = trees.BoostedTrees(own, "y", "id", n_trees=2, params=p).fit(two_classes)
    rows = two_classes.orderBy("id").collect()
    x, y = np.array([[r.a, r.b] for r in rows]), np.array([r.y for r in rows], float)
    edges = [sorted({np.sort(c)[max(1, 400 * (k + 1) // 8) - 1] for k in range(8)})[:-1] for c in x.T]
    score = np.zeros(400)
    for _ in range(2):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, q * (1 - q)

        def grow(at, depth):
            part = lambda m: 0.5 * g[m].sum() ** 2 / (h[m].sum() + 0.1)
            best = None
            if depth < 2 and at.sum() >= 3:
                for f in (0, 1):
                    for e in edges[f]:
                        left = at & (x[:, f] <= e)
                        right = at & ~left
                        if left.any() and right.any():
                            gain = 0.5 * (part(left) + part(right) - part(at))
                            if best is None or gain > best[0] + 1e-12:
                                best = (gain, left, right)
            if best and best[0] > 1e-7:
                grow(best[1], depth + 1)
                grow(best[2], depth + 1)
            else:
                value[at] = -g[at].sum() / (h[at].sum() + 0.1)

        value = np.zeros(400)
        grow(np.ones(400, bool), 0)
        score += 0.3 * value
    got = [r.prediction for r in model.predict(two_classes).orderBy("id").collect()]
    assert got == pytest.approx(1 / (1 + np.exp(-score)))
    assert "leaf" in model.text() and model.importances(spark, "cover").count() >= 1


def test_tree_histograms_add_up(spark, two_classes):
    df = two_classes.select((F.col("y") - 0.5).alias("g"), F.lit(1.0).alias("h"), (F.col("a") > 0).cast("int").alias("node"), (F.col("b") > 0).cast("int").alias("b"))
    whole = trees.histogram(df.withColumn("node", F.lit(0)), ["b"]).drop("node")
    one = trees.histogram(df.where("node = 1"), ["b"]).drop("node")
    other = {(r.feature, r.bin): (r.g, r.n) for r in trees.histogram(df.where("node = 0"), ["b"]).collect()}
    assert {(r.feature, r.bin): (r.g, r.n) for r in trees.subtract(whole, one).collect()} == other


def test_saved_trees_predict_alike(spark, two_classes, tmp_path):
    model = trees.BoostedTrees(["a", "b"], "y", "id", n_trees=1, params=trees.TreeParams(max_depth=2, reg_gamma=0.0)).fit(two_classes)
    writers.save_trees(model, spark, str(tmp_path / "m"))
    again = trees.BoostedTrees(["a", "b"], "y", "id", params=model.params, trees=writers.load_trees(spark, str(tmp_path / "m")))
    a, b = ([r.prediction for r in m.predict(two_classes).orderBy("id").collect()] for m in (model, again))
    assert a == pytest.approx(b)


def test_sampling(spark, two_classes):
    df = two_classes.select("id", (F.col("a")).alias("g"), F.lit(1.0).alias("h"))
    assert trees.sample_rows(df, "id", 0.25).count() == 100
    assert trees.goss(df, "id", 0.2, 0.1).count() == 120
    a, b = select.train_test_split(two_classes, "id", 0.3, random=True, seed=2)
    assert a.count() == 280 and b.count() == 120 and a.join(b, "id").count() == 0


def test_linear_models(spark, two_classes, tmp_path):
    model = linear.LinearModel(["a", "b"], "y", logistic=True, epochs=8, learning_rate=1.0, batch_size=200).fit(two_classes, validate=two_classes)
    acc = metrics.binary_metrics(model.predict(two_classes).withColumnRenamed("probability", "p")).first().acc
    assert acc > 0.85 and len(model.history) == 8
    line = two_classes.select("id", (2 * F.col("a") - F.col("b")).alias("y"), "a", "b")
    fitted = linear.LinearModel(["a", "b"], "y", epochs=60, learning_rate=0.5).fit(line)
    assert fitted.weights == pytest.approx([2, -1], abs=1e-3) and fitted.loss(line) < 1e-4
    writers.save_weights(spark, dict(zip("ab", fitted.weights)), str(tmp_path / "w"))
    assert writers.load_weights(spark, str(tmp_path / "w")) == dict(zip("ab", fitted.weights))


def test_kmeans(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((40, 2)) * 0.2 + c for c in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame([(i, v.tolist(), i // 40 if i % 20 == 0 else -1) for i, v in enumerate(x)], "id long, v array<double>, y int")
    model = kmeans.SeededKMeans(3, "id", "v", "y", constrained=True).fit(df)
    assert all(r.cluster == r.id // 40 for r in model.predict(df).collect())
    assert model.score(df) == pytest.approx(-sum(((x[40 * k : 40 * k + 40] - x[40 * k : 40 * k + 40].mean(0)) ** 2).sum() for k in range(3)))
    free = kmeans.SeededKMeans(3, "id", "v").fit(df)
    assert free.score(df) <= 0 and len(model.transform(df).first().distances) == 3


def test_federated(spark, two_classes):
    df = two_classes.withColumn("client_id", (F.col("id") % 4).cast("int")).withColumn("z", 2 * F.col("a") - F.col("b"))
    for method in ("fedavg", "fedavg_mean", "fedprox", "scaffold"):
        w = federated.train(df, ["a", "b"], "z", rounds=6, local_steps=2, rate=0.5, method=method, mu=0.01)
        assert w == pytest.approx([2, -1], abs=0.05), method
    noise = spark.range(20000).select(federated.laplace_noise(1.0, 0.5, 1.0, 1).alias("l"), federated.gaussian_noise(1.0, 1e-5, 0.5, 1.0, 2).alias("g"))
    r = noise.agg(F.stddev("l"), F.stddev("g")).first()
    assert r[0] == pytest.approx(math.sqrt(2), rel=0.1) and r[1] == pytest.approx(math.sqrt(2 * math.log(1.25e5)), rel=0.1)


def test_split_network_learns(two_classes):
    model = neural.SplitNetwork([("a",), ("b", "c")], "y", hidden=4, rate=1.0, epochs=25).fit(two_classes)
    out = model.predict(two_classes).withColumnRenamed("probability", "p")
    assert metrics.auc(out).first().auc > 0.9
    dp = two_classes.select(neural.label_dp(F.col("y"), 2, 1.0, 3).alias("z"), "y")
    kept = dp.where("z = y").count() / 400
    assert kept == pytest.approx(math.e / (1 + math.e), abs=0.08)


def test_pipeline(spark, two_classes):
    ids = PartyFrame(spark.range(0, 300).toDF("id"), "id", ())
    frame = PartyFrame(two_classes, "id", ("a", "b"), "y")
    steps = [Intersect([ids]), FittedScale(), Transform(lambda f: f.with_df(transform.add_intercept(f.df))), Model(linear.LinearModel(["a", "b", "intercept"], "y", logistic=True, epochs=5, learning_rate=1.0))]
    pipe = Pipeline(steps).fit(frame)
    out = pipe.transform(frame)
    assert out.n_samples == 300 and "probability" in out.df.columns


# --- sources, streams, packaging ---


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1, 0, 2.5\n2, 1, 3.5\n")
    df = readers.from_anyfile(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["id", "y", "x0"] and df.agg(F.sum("x0")).first()[0] == 6.0
    (tmp_path / "t.json").write_text(json.dumps({"data": [{"id": 1, "v": "a"}, {"id": 2, "v": None}]}))
    assert [tuple(r) for r in readers.from_anyfile(spark, str(tmp_path / "t.json")).orderBy("id").collect()] == [(1, "a"), (2, None)]
    writers.save_table(df, str(tmp_path / "out.csv"), "csv")
    assert readers.from_csv(spark, str(tmp_path / "out.csv"), has_header=True).count() == 2
    with pytest.raises(ValueError):
        readers.from_anyfile(spark, "x.unknown")
    got = readers.from_api(spark, (tmp_path / "t.json").as_uri(), "id long, v string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, None)]
    o = readers.database_options("oracle", "h", "d", "t", "u", "p", target=["a", "b"])
    assert o["url"] == "jdbc:oracle:thin:@h:1521/d" and o["query"] == "select a, b from t"
    assert readers.database_options("gaussdb", "h", "d", "t", "u", "p")["url"] == "jdbc:postgresql://h:6789/d"
    parts = readers.database_options("gaussdb", "h", "d", "t", "u", "p", target=["a", "id"], split=("id", 1, 900, 9))
    assert parts["dbtable"] == "(select a, id from t) chosen" and "query" not in parts
    assert (parts["partitionColumn"], parts["lowerBound"], parts["upperBound"], parts["numPartitions"]) == ("id", "1", "900", "9")
    assert readers.dummy_ids(spark, 10).agg(F.sum("id")).first()[0] == 55 and readers.dummy_ids(spark, 10, True).distinct().count() == 10
    assert readers.dummy_table(spark, 5, 3).columns == ["id", "y", "x0", "x1", "x2"]
    writers.append_metrics(spark, str(tmp_path / "log"), "r", 1, {"loss": 0.5})
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_image_parts(spark):
    df = spark.createDataFrame([(1, list(range(16)))], "id long, px array<int>")
    parts = df.select(*[c.alias(f"c{i}") for i, c in enumerate(readers.party_crops(F.col("px"), 4, 4, 4))]).first()
    assert list(parts) == [[0, 1, 4, 5], [2, 3, 6, 7], [8, 9, 12, 13], [10, 11, 14, 15]]


def test_streaming_counts_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = drift.windowed_bins(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), [25.0, 50.0, 75.0])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    batch = drift.windowed_bins(events, [25.0, 50.0, 75.0])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("bins")) == rows(batch)
    base = batch.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / 1000).drop("n")
    psi = drift.window_stability(batch, base).collect()
    assert len(psi) == batch.select("start").distinct().count() and all(r.psi >= 0 for r in psi)


def test_entry_stands_without_the_corpus_operators():
    import subprocess

    root = str(Path(__file__).resolve().parent.parent)
    code = "import sys; sys.modules['coterie.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_distance_correlation_of_all_dimensions(spark, tmp_path):
    from coterie.plans import registry

    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 64)) + 3
    x[:, 40:] += x[:, 8:32]
    spark.createDataFrame([(i, list(map(float, r)), i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES["distance_correlation_whole"](spark, str(tmp_path)).first()["dcor"]

    def centred(v):
        d = ((v[:, None] - v[None]) ** 2).sum(-1)
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x[:, :32]), centred(x[:, 32:])
    assert got == pytest.approx(np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean())), abs=2e-6)


def test_labels_beyond_the_first_ids_count(spark, tmp_path):
    from coterie.plans import registry

    rng = np.random.default_rng(5)
    rows = [(1000 + i, list(map(float, rng.standard_normal(64) + 20 * (i % 10))), i % 10) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert registry.QUERIES["kmeans_labelled_centroids"](spark, str(tmp_path)).count() == 640
    label = {i: y for i, _, y in rows}
    assert all(r.cluster == label[r.vec_id] for r in registry.QUERIES["kmeans_constrained"](spark, str(tmp_path)).collect())


def test_ties_are_cut_into_ranges(spark):
    """One value in all rows still takes more than one range, and sums stay right."""
    from coterie.functions.ordered import with_range

    df = spark.range(5000).select("id", F.lit(1.0).alias("v"), (F.col("id") % 7).cast("double").alias("x"))
    ranged = with_range(df, "v", ["id"]).groupBy("_range", "_sub").count().collect()
    assert len(ranged) > 10 and max(r["count"] for r in ranged) < 1000
    mixed = df.withColumn("v", F.when(F.col("id") % 3 == 0, 2.0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 11).cast("double"))
    for descending in (False, True):
        for peers in (False, True):
            got = {r["id"]: r["s"] for r in running(mixed, "v", ["id"], {"s": F.col("x")}, descending, peers).collect()}
            rows = [(r["v"], r["id"], r["x"]) for r in mixed.collect()]
            rank = lambda v: -1e9 if v is None else v
            rows.sort(key=lambda r: ((-rank(r[0]) if descending else rank(r[0])), r[1]))
            total, want = 0.0, {}
            for v, i, x in rows:
                total += x
                want[i] = total
            if peers:
                last = {v: want[i] for v, i, _ in rows}
                want = {i: last[v] for v, i, _ in rows}
            assert got == want, (descending, peers)


def test_a_cluster_needs_a_shared_folder(spark):
    from coterie import shared

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_resumed_boosting(spark, two_classes):
    from dataclasses import replace

    params = trees.TreeParams(max_depth=2)
    whole = trees.BoostedTrees(["a", "b", "c"], "y", "id", n_trees=3, params=params).fit(two_classes)
    part = trees.BoostedTrees(["a", "b", "c"], "y", "id", n_trees=1, params=params).fit(two_classes)
    more = replace(part, n_trees=3).resume(two_classes)
    assert more.text() == whole.text()
    assert whole.score(two_classes).first() is not None


def test_noise_on_clipped_updates(spark):
    df = spark.createDataFrame([(k % 2, 1.0, float(k), 2.0 * k) for k in range(40)], "client_id int, x0 double, x1 double, y double")
    plain = federated.train(df, ["x0", "x1"], "y", 2, rate=0.01, bound=1.0)
    runs = [federated.train(df, ["x0", "x1"], "y", 2, rate=0.01, bound=1.0, noise=(kind, 5.0, 1e-5), seed=3) for kind in ("gaussian", "laplace", "gaussian")]
    assert runs[0] == runs[2] and runs[0] != runs[1] and all(abs(a - b) < 1 for r in runs for a, b in zip(r, plain))


def test_packed_sums_keep_signs(spark):
    key = crypto.Paillier.generate(512, seed=3)
    rows = spark.createDataFrame([(k % 2, (-1.0) ** k * k / 7, k / 3) for k in range(30)], "k int, a double, b double")
    sent = rows.select("k", crypto.encrypt_packed([F.col("a"), F.col("b")], key, key.zeros(6, base=3)).alias("c"))
    got = {r["k"]: r["x"] for r in crypto.cipher_sum(sent, ["k"], "c", key).select("k", crypto.decrypt_packed(F.col("c"), key, 2).alias("x")).collect()}
    for k in (0, 1):
        assert got[k] == pytest.approx([sum((-1.0) ** i * i / 7 for i in range(30) if i % 2 == k), sum(i / 3 for i in range(30) if i % 2 == k)], abs=1e-6)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=501), rng.integers(0, 4, 501).astype(float)
    rows = [(float(x), float(y) if k % 3 else None, None) for k, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {r["column"]: r["q"] for r in quantiles(df, ["a", "b", "c"], shares, ranges=7).collect()}
    assert sorted(got) == ["a", "b"]  # a column of nulls has no row
    assert np.allclose(got["a"], np.quantile(a, shares), atol=1e-12)
    assert np.allclose(got["b"], np.quantile([y for k, y in enumerate(b) if k % 3], shares), atol=1e-12)
    assert quantiles(df.limit(0), ["a"], shares).count() == 0
    one = quantiles(spark.createDataFrame([(2.0,)] * 9, "a double"), ["a"], shares).first()["q"]
    assert one == [2.0] * 6
