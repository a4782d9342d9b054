"""Queries on sources and sinks, encrypted exchanges, several classes, federated inference and profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto, losses
from ..operators import evaluate, federated, intersect, kmeans, linear, metrics, neural, transform, trees
from ..party import Role
from ..shared import shared_dir
from ..sources import readers, writers
from . import fixtures as fx
from .modelling import _BINS, _GH, _TREE, _TREE_EDGES, _WOE_WITH, _coded
from .tabular import joined_frame, query

KEY_BITS, KEY_SEED = 512, 11


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/coterie-{name}-{uuid.uuid4().hex}"


# --- sources and sinks ---

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query(_NATION)
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    n, path = fx.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), _path(spark, "csv")
    writers.save_table(n, path, "csv")
    return readers.from_csv(spark, path, has_header=True, schema=n.schema)


@query("SELECT n_nationkey AS id, n_regionkey AS x0 FROM nation")
def csv_headless(spark: SparkSession, sf: str) -> DataFrame:
    """Columns without a header are named by their places."""
    n, path = fx.table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), _path(spark, "csv")
    n.write.csv(path)
    out = readers.from_csv(spark, path, labelled=False)
    return out.select(F.col("id").cast(n.schema["n_nationkey"].dataType).alias("id"), F.col("x0").cast(n.schema["n_regionkey"].dataType).alias("x0"))


@query(_NATION)
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Records as the list of a JSON object's field: 25 rows, written as one object."""
    n, path = fx.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), _path(spark, "json")
    n.agg(F.collect_list(F.struct("*")).alias("data")).write.json(path)
    out = readers.from_json(spark, path)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in n.schema])


@query("SELECT p_partkey, p_size FROM part")
def anyfile_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    return readers.from_anyfile(spark, f"{sf}/part.parquet", target=["p_partkey", "p_size"])


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def column_choice(spark: SparkSession, sf: str) -> DataFrame:
    return readers.from_parquet(spark, f"{sf}/supplier.parquet", target=["s_suppkey", "s_nationkey", "s_acctbal"], excluding=["s_acctbal"])


@query("SELECT CAST(row_number() OVER () AS BIGINT) AS id FROM supplier")
def dummy_ids(spark: SparkSession, sf: str) -> DataFrame:
    """As many ids as there are suppliers."""
    return readers.dummy_ids(spark, fx.table(spark, sf, "supplier").count())


@query("SELECT count(*) AS n, count(*) AS n_ids, count(*) AS inside, count(*) AS n_binary FROM orders")
def dummy_table_shape(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up party of as many rows as there are orders."""
    d = readers.dummy_table(spark, fx.table(spark, sf, "orders").count(), 3, seed=4)
    inside = F.count(F.when((F.col("x0") >= 0) & (F.col("x2") < 1), 1))
    return d.agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), inside.alias("inside"), F.count(F.when(F.col("y").isin(0, 1), 1)).alias("n_binary"))


_NAMED = lambda sf: {"parts": readers.NamedDataset(f"{sf}/part.parquet", "p_partkey", ("p_size", "p_retailprice", "p_brand"), "p_type")}


@query("SELECT p_partkey AS id, p_retailprice AS x0 FROM part")
def named_dataset_passive(spark: SparkSession, sf: str) -> DataFrame:
    """By importance the price comes first, and a share of 0.5 gives the passive party one of three features."""
    rank = {"p_size": 0.2, "p_retailprice": 0.7, "p_brand": 0.1}
    return readers.named_dataset(spark, _NAMED(sf), "parts", Role.PASSIVE, 0.5, "importance", importances=rank).rename(["id", "x0"]).table()


@query("SELECT p_partkey AS id, p_type AS y, p_size AS x0, p_brand AS x1 FROM part")
def named_dataset_active(spark: SparkSession, sf: str) -> DataFrame:
    rank = {"p_size": 0.2, "p_retailprice": 0.7, "p_brand": 0.1}
    return readers.named_dataset(spark, _NAMED(sf), "parts", Role.ACTIVE, 0.5, "importance", importances=rank).rename(["id", "y", "x0", "x1"]).table()


@query(f"WITH {fx.VECTORS}, m AS (SELECT label, i, round(avg(vec[i]), 9) AS m FROM vectors, range(1, 65) r(i) GROUP BY 1, 2) SELECT 'class' || label AS name, 3 AS epoch, round(sum(m), 6) AS total FROM m GROUP BY 1 UNION ALL SELECT 'all', 3, round(sum(m), 6) FROM m")
def layers_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Layers made of class centroids, a vector each and a matrix of all, saved with an epoch and read back."""
    v = fx.vectors(spark, sf)
    rows = kmeans.to_lists(kmeans.centroids(v, "vec", "label"), v.agg(F.max("label")).first()[0] + 1)
    rows = [[round(x, 9) for x in r] for r in rows]
    path = _path(spark, "layers")
    writers.save_layers(spark, {"all": rows} | {f"class{k}": r for k, r in enumerate(rows)}, 3, path)
    layers, epoch = writers.load_layers(spark, path)
    return spark.createDataFrame([(k, epoch, round(float(v.sum()), 6)) for k, v in layers.items()], "name string, epoch int, total double")


@query(f"WITH {fx.JOINED} SELECT feature AS name, round(w, 6) AS value FROM (UNPIVOT (SELECT corr(n_lines, y) AS n_lines, corr(sum_qty, y) AS sum_qty, corr(avg_disc, y) AS avg_disc, corr(avg_tax, y) AS avg_tax, corr(sum_price, y) AS sum_price FROM joined) ON n_lines, sum_qty, avg_disc, avg_tax, sum_price INTO NAME feature VALUE w)")
def weights_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Weights taken from the features' correlations with the label, saved and read back."""
    path = _path(spark, "weights")
    found = evaluate.label_correlation(fx.joined(spark, sf), fx.FEATURES, "y").collect()
    writers.save_weights(spark, {r["feature"]: round(r["corr"], 6) for r in found}, path)
    return spark.createDataFrame(sorted(writers.load_weights(spark, path).items()), "name string, value double")


@query(f"WITH {fx.CLIENTS}, s AS (SELECT client_id, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean FROM clients GROUP BY 1) SELECT 'run' AS run, client_id AS step, metric, value FROM (UNPIVOT s ON n, mean INTO NAME metric VALUE value)")
def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of each client's rows and mean value, appended step by step."""
    path = _path(spark, "log")
    sums = fx.clients(spark, sf).groupBy("client_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    for r in sums.collect():  # a row per client
        writers.append_metrics(spark, path, "run", r["client_id"], {"n": float(r["n"]), "mean": r["mean"]})
    return spark.read.parquet(path)


@query("SELECT vec_id, list_transform(embedding, lambda x: round((CAST(x AS DOUBLE) / 255 - 0.5) / 0.25, 9)) AS pixels FROM embeddings")
def image_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors read as images of four rows, flattened, centred and scaled."""
    rows = F.array(*[F.slice("vec", 16 * k + 1, 16) for k in range(4)])
    flat = transform.flatten_image(rows, 0.5, 0.25, 255.0)
    return fx.vectors(spark, sf).select("vec_id", F.transform(flat, lambda x: fx.rounded(x, 9)).alias("pixels"))


@query("WITH s AS (SELECT 'p_brand' AS \"column\", count(DISTINCT p_brand) AS size FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part) SELECT \"column\", size, least(50, (size + 1) // 2) AS dim FROM s")
def embedding_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return transform.embedding_sizes(fx.table(spark, sf, "part"), ["p_brand", "p_size", "p_type"])


@query(f"WITH {fx.DIRTY} SELECT id, coalesce(CAST(size AS DOUBLE), -1) AS size, coalesce(CAST(price AS DOUBLE), -1) AS price FROM dirty")
def fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.fill_missing(fx.dirty(spark, sf).select("id", "size", "price"), ["size", "price"])


@query(f"WITH {fx.JOINED} SELECT 'active' AS role, 3 AS n_features, count(*) AS n, count(y) AS n_labels FROM joined UNION ALL SELECT 'passive', 2, count(*), 0 FROM joined")
def feature_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Features, rows and labels of both sides of a vertical split."""
    out = None
    for x in joined_frame(spark, sf).vertical_split(0.4):
        labels = F.count(x.label_col) if x.label_col else F.lit(0).cast("long")
        own = x.df.agg(F.lit(x.role.value).alias("role"), F.lit(x.n_features).alias("n_features"), F.count("*").alias("n"), labels.alias("n_labels"))
        out = own if out is None else out.unionByName(own)
    return out


# --- intersection ---


@query("WITH i AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)), o AS (SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM i)), r AS (SELECT id, row_number() OVER (ORDER BY substr(md5(concat(CAST(id AS VARCHAR), '-4')), 1, 15), id) AS rn FROM o) SELECT id FROM i UNION ALL SELECT id FROM r WHERE rn <= (SELECT CAST(floor(0.1 * count(*)) AS BIGINT) FROM i)")
def decoy_reply(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "customer").select("c_custkey")
    reply = intersect.intersect(c, fx.table(spark, sf, "orders").select("o_custkey"))
    return intersect.with_decoys(reply, c, 0.1, seed=4)


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def signed_ids_reused(spark: SparkSession, sf: str) -> DataFrame:
    """The offline table of signed ids serves two online runs; the second one's result is returned."""
    key = crypto.RSA.generate(512, seed=5)
    signed = intersect.sign_ids(fx.table(spark, sf, "supplier").select("s_nationkey").distinct(), key)
    nations = fx.table(spark, sf, "nation").select("n_nationkey")
    first = intersect.blind_intersect(signed.select("id"), nations, key, seed=1, signed=signed)
    return intersect.blind_intersect(signed.select("id"), first, key, seed=2, signed=signed)


# --- encrypted exchanges ---

_HISTOGRAM = f"WITH {fx.JOINED}, {_GH}, {_BINS} SELECT feature, bin, round(g, 6) AS g, round(h, 6) AS h, n FROM hist"


def _key() -> crypto.Paillier:
    return crypto.Paillier.generate(KEY_BITS, seed=KEY_SEED)


def _rounded(h: DataFrame) -> DataFrame:
    return h.select("feature", "bin", F.round("g", 6).alias("g"), F.round("h", 6).alias("h"), "n")


@query(_HISTOGRAM)
def cipher_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(trees.cipher_histogram(_coded(spark, sf), _TREE, _key(), packed=False))


@query(_HISTOGRAM)
def packed_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(trees.cipher_histogram(_coded(spark, sf), _TREE, _key()))


@query(f"{_WOE_WITH} SELECT feature, bin, pos, neg, round(woe, 6) AS woe, round((p - q) * woe, 6) AS iv FROM woe")
def two_party_woe(spark: SparkSession, sf: str) -> DataFrame:
    ids = fx.joined(spark, sf)
    w = evaluate.private_woe(ids.select("id", *fx.FEATURES), ids.select("id", "y"), "id", fx.FEATURES, "y", _key())
    return w.withColumn("woe", F.round("woe", 6)).withColumn("iv", F.round("iv", 6))


@query("SELECT 'x0' AS feature, CAST(sum(r_regionkey * (r_regionkey - 2)) AS DOUBLE) AS product FROM region UNION ALL SELECT 'x1', CAST(sum(0.5 * (r_regionkey - 2)) AS DOUBLE) FROM region")
def cipher_matmul(spark: SparkSession, sf: str) -> DataFrame:
    """X' E(r) of plain features and an encrypted residue."""
    key = _key()
    r = fx.table(spark, sf, "region").select(F.col("r_regionkey").alias("x0"), F.lit(0.5).alias("x1"), crypto.encrypt_column((F.col("r_regionkey") - 2).cast("double"), key).alias("c"))
    out = crypto.cipher_matmul(r, "c", ["x0", "x1"], key)
    return out.select("feature", F.round(crypto.decrypt_column(F.col("product"), key, 1), 6).alias("product"))


@query("""WITH v AS (SELECT s_suppkey, s_acctbal AS x FROM supplier UNION ALL SELECT -s_suppkey, s_acctbal * 1e15 FROM supplier), e AS (SELECT *, CAST(greatest(-10, ceil(log2(greatest(abs(x), 1e-300))) - 53) AS INTEGER) AS exponent FROM v)
  SELECT s_suppkey, CAST(round(x / pow(2::DOUBLE, exponent)) AS BIGINT) AS mantissa, exponent, CAST(round(x / pow(2::DOUBLE, exponent)) AS BIGINT) * pow(2::DOUBLE, exponent) AS value FROM e""")
def exponent_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Balances, and balances with fifteen places more, whose mantissas would not fit at that precision."""
    s = fx.table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"))
    own = s.unionByName(s.select((-F.col("s_suppkey")).alias("s_suppkey"), (F.col("x") * 1e15).alias("x")))
    code = crypto.exponent_encode(F.col("x"), 0.001)
    return own.select("s_suppkey", code["mantissa"].alias("mantissa"), code["exponent"].alias("exponent"), crypto.exponent_decode(code).alias("value"))


@query("SELECT name, n_regionkey, CAST(sum(n_nationkey) AS DOUBLE) AS total FROM nation, (SELECT unnest(['plain', 'paillier', 'fast_paillier']) AS name) GROUP BY 1, 2")
def sums_by_system(spark: SparkSession, sf: str) -> DataFrame:
    """Group sums in each system by name; the fast one refreshes with products of a few zeros."""
    n, out = fx.table(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").cast("double").alias("v")), None
    for name in ("plain", "paillier", "fast_paillier"):
        encrypt, add_up, decrypt = crypto.system(name, KEY_BITS, seed=KEY_SEED)
        sums = add_up(n.select("n_regionkey", encrypt(F.col("v")).alias("v")), ["n_regionkey"], "v")
        own = sums.select(F.lit(name).alias("name"), "n_regionkey", F.round(decrypt(F.col("v")), 4).alias("total"))
        out = own if out is None else out.union(own)
    return out


@query("SELECT r_regionkey, CAST(r_regionkey * 0.5 - 2 AS DOUBLE) AS output FROM region")
def encrypted_cut_layer(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.table(spark, sf, "region").select("r_regionkey", F.array(F.col("r_regionkey").cast("double"), F.lit(1.0)).alias("vec"))
    return neural.encrypted_layer(r, "vec", [0.5, -2.0], _key(), noise=3.25).select("r_regionkey", F.round("output", 6).alias("output"))


@query(f"WITH {fx.JOINED}, d AS (SELECT id, y, n_lines / 7 AS a, sum_qty / 300 AS b FROM joined), s AS (SELECT *, tanh(0.5 * a - 0.25 * b) AS h0, tanh(b) AS h1 FROM d), t AS (SELECT *, 1 / (1 + exp(-(0.8 * tanh(h0 + h1) - 0.3 * tanh(h0 - h1)))) AS p FROM s) SELECT id, round(p, 6) AS probability, round(-(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS loss FROM t")
def u_shaped_split(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.joined(spark, sf).select("id", "y", (F.col("n_lines") / 7).alias("a"), (F.col("sum_qty") / 300).alias("b"))
    out = neural.u_shaped(d, ["a", "b"], [[0.5, -0.25], [0.0, 1.0]], [[1.0, 1.0], [1.0, -1.0]], [0.8, -0.3], "y")
    return out.select("id", F.round("probability", 6).alias("probability"), F.round("loss", 6).alias("loss"))


# --- trees and losses ---


@query(f"WITH {fx.JOINED}, {_GH}, {_BINS}, r AS (SELECT feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (SELECT 0.5::DOUBLE - y AS g, 0.25::DOUBLE AS h, 'sum_qty' AS feature, CAST(sum_qty > 50 AS INTEGER) + CAST(sum_qty > 100 AS INTEGER) + CAST(sum_qty > 150 AS INTEGER) AS bin FROM joined WHERE sum_qty > 100 UNION ALL SELECT 0.5::DOUBLE - y, 0.25::DOUBLE, 'n_lines', CAST(n_lines > 2 AS INTEGER) + CAST(n_lines > 4 AS INTEGER) FROM joined WHERE sum_qty > 100) GROUP BY 1, 2) SELECT feature, bin, round(coalesce(r.g, 0), 6) + 0.0 AS g, round(coalesce(r.h, 0), 6) AS h, coalesce(r.n, 0) AS n FROM hist LEFT JOIN r USING (feature, bin)")
def tree_sibling(spark: SparkSession, sf: str) -> DataFrame:
    """The right child's histogram: the parent's minus the left child's."""
    rows = _coded(spark, sf)
    left = rows.where("sum_qty < 2")  # codes 0 and 1: up to 100
    out = trees.subtract(trees.histogram(rows, _TREE).drop("node"), trees.histogram(left, _TREE).drop("node"))
    return out.select("feature", "bin", (F.round("g", 6) + 0.0).alias("g"), (F.round("h", 6) + 0.0).alias("h"), "n")


_CLASSES = "k AS (SELECT id, o_totalprice, CAST(priority - 1 AS INTEGER) % 3 AS y, [o_totalprice / 500000, 0.3, priority / 10] AS s, n_lines, sum_qty FROM joined), e AS (SELECT *, list_transform(s, lambda x: exp(x)) AS e FROM k), p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"


def _three(spark: SparkSession, sf: str) -> tuple[DataFrame, list]:
    j = fx.joined(spark, sf).withColumn("y", (F.col("priority") - 1).cast("int") % 3)
    return j, [F.col("o_totalprice") / 500000, F.lit(0.3), F.col("priority") / 10]


@query(f"WITH {fx.JOINED}, {_CLASSES} SELECT id, round(-ln(p[y + 1]), 6) AS loss, " + ", ".join(f"round(p[{k + 1}] - CAST(y = {k} AS INTEGER), 6) AS g{k}, round(p[{k + 1}] * (1 - p[{k + 1}]), 6) AS h{k}" for k in range(3)) + " FROM p")
def multiclass_gradients(spark: SparkSession, sf: str) -> DataFrame:
    j, scores = _three(spark, sf)
    loss, g, h = losses.multi_cross_entropy(F.col("y"), scores)
    return j.select("id", F.round(loss, 6).alias("loss"), *[F.round(x[k], 6).alias(f"{n}{k}") for k in range(3) for n, x in (("g", g), ("h", h))])


_CLASS_HIST = "coded AS (SELECT p, y, 'sum_qty' AS feature, CAST(sum_qty > 50 AS INTEGER) + CAST(sum_qty > 100 AS INTEGER) + CAST(sum_qty > 150 AS INTEGER) AS bin FROM p UNION ALL SELECT p, y, 'n_lines', CAST(n_lines > 2 AS INTEGER) + CAST(n_lines > 4 AS INTEGER) FROM p), hist AS (SELECT feature, bin, c, sum(p[c + 1] - CAST(y = c AS INTEGER)) AS g, sum(p[c + 1] * (1 - p[c + 1])) AS h FROM coded, range(3) t(c) GROUP BY 1, 2, 3)"


def _class_hist(spark: SparkSession, sf: str) -> DataFrame:
    j, scores = _three(spark, sf)
    _, g, h = losses.multi_cross_entropy(F.col("y"), scores)
    rows = j.select(*[x[k].alias(f"{n}{k}") for k in range(3) for n, x in (("g", g), ("h", h))], *_TREE)
    return trees.class_histogram(transform.apply_bins(rows, _TREE_EDGES), _TREE, 3)


@query(f"WITH {fx.JOINED}, {_CLASSES}, {_CLASS_HIST}, cum AS (SELECT feature, bin, c, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER f AS gt, sum(h) OVER f AS ht, max(bin) OVER f AS last FROM hist WINDOW w AS (PARTITION BY feature, c ORDER BY bin), f AS (PARTITION BY feature, c)) SELECT feature, bin, round(sum(0.5 * (0.5 * gl * gl / (hl + 0.1) + 0.5 * (gt - gl) * (gt - gl) / (ht - hl + 0.1) - 0.5 * gt * gt / (ht + 0.1))) - 0.1, 5) AS gain FROM cum WHERE bin < last GROUP BY 1, 2")
def multiclass_gains(spark: SparkSession, sf: str) -> DataFrame:
    return trees.class_split_gains(_class_hist(spark, sf)).withColumn("gain", F.round("gain", 5))


@query(f"WITH {fx.JOINED}, {_CLASSES}, {_CLASS_HIST} SELECT CAST(c AS INTEGER) AS class, round(-sum(g) / (sum(h) + 0.1), 6) AS weight FROM hist WHERE feature = 'n_lines' GROUP BY 1")
def multiclass_leaf_weights(spark: SparkSession, sf: str) -> DataFrame:
    root = _class_hist(spark, sf).where("feature = 'n_lines'").groupBy("class").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return root.select("class", F.round(trees.leaf_weight(F.col("g"), F.col("h")), 6).alias("weight"))


@query(f"""WITH {fx.SCORED}, q AS (SELECT id, y, 0.05 + p * 0.9 AS p FROM scored), t AS (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS t, CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END AS a FROM q)
  SELECT id, round(-(0.7 * y * ln(p) + 0.3 * (1 - y) * ln(1 - p)), 6) AS balanced, round(0.3 * (1 - y) * p - 0.7 * y * (1 - p), 6) AS balanced_g, round(-a * (1 - t) * (1 - t) * ln(t), 6) AS focal,
    round(CASE WHEN y = 1 THEN 1 ELSE -1 END * a * (1 - t) * (1 - t) * (2 * t * ln(t) - (1 - t)), 6) AS focal_g, round(2 * y * exp(-0.5 * p) + 2 * exp(0.5 * p), 6) AS tweedie, round(-y * exp(-0.5 * p) + exp(0.5 * p), 6) AS tweedie_g, round(0.5 * y * exp(-0.5 * p) + 0.5 * exp(0.5 * p), 6) AS tweedie_h FROM t""")
def class_losses(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.scored(spark, sf).select("id", "y", (F.lit(0.05) + F.col("p") * 0.9).alias("p"))
    y, p = F.col("y"), F.col("p")
    balanced, focal, tweedie = losses.balanced_cross_entropy(y, p, 0.7), losses.focal(y, p, 0.25, 2.0), losses.tweedie(y, p, 1.5)
    out = {"balanced": balanced[0], "balanced_g": balanced[1], "focal": focal[0], "focal_g": focal[1], "tweedie": tweedie[0], "tweedie_g": tweedie[1], "tweedie_h": tweedie[2]}
    return s.select("id", *[F.round(c, 6).alias(n) for n, c in out.items()])


# --- profiles ---

_IV = "ivs AS (SELECT feature, sum((p - q) * woe) AS iv FROM woe GROUP BY 1)"


@query(f"{_WOE_WITH}, {_IV}, c AS (SELECT feature, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rn, sum(n) OVER (PARTITION BY feature) AS total FROM c), t AS (SELECT feature, " + ", ".join(f"max(value) FILTER (rn = {k}) AS top{k}, round(max(n / total) FILTER (rn = {k}), 6) AS share{k}" for k in (1, 2, 3)) + " FROM r GROUP BY 1) SELECT feature, round(iv, 6) AS iv, round(iv / sum(iv) OVER (), 6) AS iv_share, CAST(row_number() OVER (ORDER BY iv DESC, feature) AS INTEGER) AS iv_rank, top1, share1, top2, share2, top3, share3 FROM ivs JOIN t USING (feature)")
def profile_features(spark: SparkSession, sf: str) -> DataFrame:
    p = evaluate.profile(fx.joined(spark, sf), fx.FEATURES, "y")
    return p.withColumns({c: F.round(c, 6) for c in ("iv", "iv_share", "share1", "share2", "share3")})


@query(f"{_WOE_WITH}, {_IV} SELECT feature, round(iv, 6) AS importance, CAST(row_number() OVER (ORDER BY round(iv, 6) DESC, feature) AS INTEGER) AS rank FROM ivs ORDER BY 3 LIMIT 3")
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    iv = evaluate.information_value(fx.joined(spark, sf), fx.FEATURES, "y")
    return evaluate.top_features(iv.select("feature", F.round("iv", 6).alias("importance")), 3)


@query(f"WITH {fx.SCORED} SELECT id, round(y - p, 6) AS residual FROM scored")
def residual_series(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.residuals(fx.scored(spark, sf), "id", "y", "p").withColumn("residual", F.round("residual", 6))


# --- federated and split learning ---

_LINEAR = "k AS (SELECT id, o_totalprice / 500000 AS a, priority / 5 AS b, CAST(priority - 1 AS INTEGER) % 3 AS label, CAST(id % 4 AS INTEGER) AS client_id FROM active), s AS (SELECT *, [a, b, 0.6 - 0.2 * a + 0.1 * b] AS s FROM k), e AS (SELECT *, list_transform(s, lambda x: exp(x)) AS e FROM s), inferred AS (SELECT *, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS prediction, -ln(e[label + 1] / list_sum(e)) AS loss FROM e)"
_WEIGHTS = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [-0.2, 0.1, 0.6]]


def _inferred(spark: SparkSession, sf: str) -> DataFrame:
    a = fx.active(spark, sf).select("id", (F.col("o_totalprice") / 500000).alias("a"), (F.col("priority") / 5).alias("b"), F.lit(1.0).alias("one"), ((F.col("priority") - 1).cast("int") % 3).alias("label"), (F.col("id") % 4).cast("int").alias("client_id"))
    # the intercept first, as in SQL: scores that are next to equal come out alike
    return federated.inference(a, ["one", "a", "b"], [[w[2], *w[:2]] for w in _WEIGHTS])


@query(f"WITH {fx.ACTIVE}, {_LINEAR} SELECT id, prediction, round(loss, 6) AS loss FROM inferred")
def fed_inference(spark: SparkSession, sf: str) -> DataFrame:
    return _inferred(spark, sf).select("id", "prediction", fx.rounded(F.col("loss"), 6).alias("loss"))


@query(f"WITH {fx.ACTIVE}, {_LINEAR} SELECT client_id, count(*) AS n, round(avg(CAST(prediction = label AS DOUBLE)), 6) AS accuracy, round(avg(loss), 6) AS loss FROM inferred GROUP BY 1")
def fed_score(spark: SparkSession, sf: str) -> DataFrame:
    return federated.score(_inferred(spark, sf), ["client_id"]).withColumn("accuracy", F.round("accuracy", 6)).withColumn("loss", F.round("loss", 6))


_F1 = "by_class AS (SELECT k.c, count(*) FILTER (y = k.c) AS t, count(*) FILTER (q = k.c) AS n, count(*) FILTER (y = k.c AND q = k.c) AS h FROM q, (SELECT DISTINCT y AS c FROM q UNION SELECT DISTINCT q FROM q) k GROUP BY 1), f1 AS (SELECT sum(h) / sum(t) AS accuracy, sum(t * coalesce(2 * h / nullif(t + n, 0), 0)) / sum(t) AS weighted_f1 FROM by_class)"
_RANKS = "a AS (SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM q))"


@query(f"WITH {fx.ACTIVE}, l AS (SELECT y, o_totalprice / 500000 AS a, priority / 5 AS b FROM active), z AS (SELECT y, a - b AS s0, b - 0.5 * a AS s1 FROM l), q AS (SELECT y, CAST(s1 > s0 AS INTEGER) AS q, round(1 / (1 + exp(s0 - s1)), 12) AS p, -ln(exp(CASE WHEN y = 1 THEN s1 ELSE s0 END) / (exp(s0) + exp(s1))) AS loss FROM z), {_F1}, {_RANKS} SELECT (SELECT count(*) FROM q) AS n, (SELECT round(avg(loss), 6) FROM q) AS loss, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1, round(auc, 6) AS auc FROM f1, a")
def fed_validate(spark: SparkSession, sf: str) -> DataFrame:
    """A shared model of two classes: loss, accuracy, weighted F1 and the area under class 1's curve."""
    a = fx.active(spark, sf).select((F.col("o_totalprice") / 500000).alias("a"), (F.col("priority") / 5).alias("b"), F.col("y").alias("label"))
    m = federated.validate(a, ["a", "b"], [[1.0, -1.0], [-0.5, 1.0]])
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "weighted_f1", "auc")])


@query(f"WITH {fx.ACTIVE}, {_LINEAR}, q AS (SELECT label AS y, prediction AS q, s FROM inferred), {_F1}, near AS (SELECT avg(CAST((SELECT count(*) FROM range(1, 4) t(i) WHERE s[i] > s[y + 1] OR (s[i] = s[y + 1] AND i < y + 1)) < 2 AS DOUBLE)) AS topk FROM q) SELECT round(accuracy, 6) AS acc, 0::DOUBLE AS auc, round(topk, 6) AS topk_acc FROM f1, near")
def network_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and top-2 accuracy of class scores; the curve's area is for two classes and 0 for more."""
    scores = F.array(*[F.col("a") * w[0] + F.col("b") * w[1] + F.lit(w[2]) for w in _WEIGHTS[:2]], F.lit(0.6) - 0.2 * F.col("a") + 0.1 * F.col("b"))
    m = neural.validate(_inferred(spark, sf).withColumn("s", scores), "s", "label", 3, top=2)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(f"WITH {fx.ACTIVE}, {_LINEAR} SELECT label, count(*) AS n, round(avg(CAST(prediction = label AS DOUBLE)), 6) AS accuracy FROM inferred GROUP BY 1")
def class_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_accuracy(_inferred(spark, sf), "label", "prediction").withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {fx.ACTIVE}, {_LINEAR} SELECT count(*) AS n, round(avg(CAST(prediction = 2 AS DOUBLE)), 6) AS rate FROM inferred WHERE label <> 2")
def attack_success(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.attack_success(_inferred(spark, sf), "label", "prediction", 2).withColumn("rate", F.round("rate", 6))


@query(f"WITH {fx.ACTIVE}, {_LINEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY prediction ORDER BY list_max(s) DESC, id) AS rn FROM inferred) SELECT prediction AS label, count(*) AS n, round(avg(CAST(prediction = label AS DOUBLE)), 6) AS accuracy FROM r WHERE rn <= 20 GROUP BY 1")
def confident_top_k(spark: SparkSession, sf: str) -> DataFrame:
    scores = F.array(*[F.col("a") * w[0] + F.col("b") * w[1] + F.lit(w[2]) for w in _WEIGHTS[:2]], F.lit(0.6) - 0.2 * F.col("a") + 0.1 * F.col("b"))
    return metrics.confident_top_k(_inferred(spark, sf).withColumn("s", scores), "s", "label", 20).withColumn("accuracy", F.round("accuracy", 6))


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY substr(md5(concat(CAST(event_id AS VARCHAR), '-2')), 1, 15), event_id) AS rn FROM events) SELECT event_id, CAST((rn - 1) % 4 AS INTEGER) AS client_id FROM r")
def iid_clients(spark: SparkSession, sf: str) -> DataFrame:
    return federated.iid_clients(fx.table(spark, sf, "events").select("event_id"), "event_id", 4, seed=2)


_FED = "d AS (SELECT client_id, 1.0::DOUBLE AS x0, CAST(day AS DOUBLE) / 31 AS x1, value / 100 AS y FROM clients), g AS (SELECT client_id, count(*) AS n, -avg(y * x0) AS g0, -avg(y * x1) AS g1 FROM d GROUP BY 1)"


def _fed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return fx.clients(spark, sf).select("client_id", F.lit(1.0).alias("x0"), (F.col("day").cast("double") / 31).alias("x1"), (F.col("value") / 100).alias("y"))


@query(f"WITH {fx.CLIENTS}, {_FED}, c AS (SELECT n, g0 / greatest(1, sqrt(g0 * g0 + g1 * g1) / 0.05) AS g0, g1 / greatest(1, sqrt(g0 * g0 + g1 * g1) / 0.05) AS g1 FROM g) SELECT round(sum(n * -0.1 * g0) / sum(n), 6) AS w0, round(sum(n * -0.1 * g1) / sum(n), 6) AS w1 FROM c")
def fed_clipped_round(spark: SparkSession, sf: str) -> DataFrame:
    w = federated.train(_fed_rows(spark, sf), ["x0", "x1"], "y", 1, rate=0.1, bound=0.05)
    return spark.createDataFrame([tuple(round(x, 6) for x in w)], "w0 double, w1 double")


@query(f"WITH {fx.JOINED}, b AS (SELECT *, 0.02 * n_lines - 0.5 AS r FROM joined) SELECT round(avg(CAST((1 / (1 + exp(-r)) > 0.5) = (y = 1) AS DOUBLE)), 6) AS accuracy, round(avg(ln(1 + exp(-abs(r))) + greatest(r, 0) - y * r), 6) AS loss FROM b")
def linear_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and loss of a logistic model: what validation logs per epoch."""
    j = fx.joined(spark, sf).withColumn("one", F.lit(1.0))
    model = linear.LinearModel(["n_lines", "one"], "y", logistic=True, weights=[0.02, -0.5])
    hit = model.predict(j).agg(F.round(F.avg((F.col("prediction") == F.col("y")).cast("double")), 6).alias("accuracy"))
    return hit.withColumn("loss", F.lit(round(model.loss(j), 6)))
