"""Queries on ids, selection, cleaning, profiles, transforms and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto
from ..operators import clean, evaluate, intersect, select, transform
from ..party import PartyFrame
from ..sources.readers import augmented, overridden, party_crops
from . import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def orders_frame(spark: SparkSession, sf: str) -> PartyFrame:
    return PartyFrame(fx.active(spark, sf), "id", ("o_totalprice", "priority"), "y")


def joined_frame(spark: SparkSession, sf: str) -> PartyFrame:
    return PartyFrame(fx.joined(spark, sf), "id", fx.FEATURES, "y")


# --- ids ---


@query("SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def intersect_two(spark: SparkSession, sf: str) -> DataFrame:
    return intersect.intersect(fx.table(spark, sf, "orders"), fx.table(spark, sf, "lineitem").select("l_orderkey"))


@query("SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT user_id FROM events)")
def intersect_three(spark: SparkSession, sf: str) -> DataFrame:
    return intersect.intersect(fx.table(spark, sf, "customer").select("c_custkey"), fx.table(spark, sf, "orders").select("o_custkey"), fx.table(spark, sf, "events").select("user_id"))


_DOCS = "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


@query(_DOCS)
def intersect_hashed_md5(spark: SparkSession, sf: str) -> DataFrame:
    return intersect.hashed_intersect(fx.table(spark, sf, "documents").select("doc_id"), fx.table(spark, sf, "labels").select("doc_id"), "md5")


@query(_DOCS)
def intersect_hashed_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return intersect.hashed_intersect(fx.table(spark, sf, "documents").select("doc_id"), fx.table(spark, sf, "labels").select("doc_id"), "sha256", salt="pepper")


@query("SELECT s_suppkey AS id, md5(CAST(s_suppkey AS VARCHAR)) AS md5, sha256(CAST(s_suppkey AS VARCHAR)) AS sha256 FROM supplier")
def obfuscated_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return fx.table(spark, sf, "supplier").select(key.alias("id"), intersect.obfuscate(key, "md5").alias("md5"), intersect.obfuscate(key, "sha256").alias("sha256"))


@query()
def obfuscated_ids_sm3(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), intersect.obfuscate(F.col("s_suppkey"), "sm3").alias("sm3"))


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def blind_intersect(spark: SparkSession, sf: str) -> DataFrame:
    key = crypto.RSA.generate(512, seed=5)
    return intersect.blind_intersect(fx.table(spark, sf, "supplier").select("s_nationkey").distinct(), fx.table(spark, sf, "nation").select("n_nationkey"), key)


@query("SELECT s_nationkey, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def paillier_group_sum(spark: SparkSession, sf: str) -> DataFrame:
    key = crypto.Paillier.generate(512, seed=5)
    rows = crypto.spread(fx.table(spark, sf, "supplier").select("s_nationkey", "s_acctbal"))
    rows = rows.select("s_nationkey", crypto.encrypt_column(F.col("s_acctbal"), key).alias("total"))
    sums = crypto.cipher_sum(rows, ["s_nationkey"], "total", key)
    return sums.select("s_nationkey", F.round(crypto.decrypt_column(F.col("total"), key), 2).alias("total"))


@query("SELECT r_regionkey, CAST(r_regionkey * 3 AS DOUBLE) AS times3 FROM region")
def paillier_times(spark: SparkSession, sf: str) -> DataFrame:
    key = crypto.Paillier.generate(512, seed=6)
    zeros = key.zeros(8)
    r = fx.table(spark, sf, "region").select("r_regionkey", crypto.encrypt_column(F.col("r_regionkey").cast("double"), key, zeros).alias("c"))
    r = r.withColumn("c", crypto.times_column(F.col("c"), F.lit(3.0), key))
    return r.select("r_regionkey", F.round(crypto.decrypt_column(F.col("c"), key, 1), 6).alias("times3"))


@query(f"WITH {fx.PASSIVE} SELECT o_orderkey AS id, o_totalprice, n_lines, sum_qty FROM orders JOIN passive ON id = o_orderkey")
def align_parties(spark: SparkSession, sf: str) -> DataFrame:
    return intersect.align([fx.active(spark, sf).select("id", "o_totalprice"), fx.passive(spark, sf).select("id", "n_lines", "sum_qty")])


# --- selection ---


@query(f"WITH {fx.ACTIVE} SELECT * FROM active WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_filter(spark: SparkSession, sf: str) -> DataFrame:
    return orders_frame(spark, sf).filter(fx.table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey")).table()


@query(f"WITH {fx.JOINED} SELECT id, y, n_lines, avg_disc FROM joined")
def field_filter(spark: SparkSession, sf: str) -> DataFrame:
    return joined_frame(spark, sf).filter_fields(["n_lines", 2, "sum_price"], excluding=[4]).table()


@query(f"WITH {fx.ACTIVE} SELECT id AS key, y AS target, o_totalprice AS x0, priority AS x1 FROM active")
def rename_header(spark: SparkSession, sf: str) -> DataFrame:
    return orders_frame(spark, sf).rename(["key", "target", "x0", "x1"]).table()


@query(f"WITH {fx.ACTIVE} SELECT y, CAST(count(*) AS BIGINT) AS n FROM active GROUP BY 1")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return orders_frame(spark, sf).labels.groupBy("y").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rn, count(*) OVER () AS n FROM part) SELECT p_partkey, CAST(CASE WHEN rn <= floor(n * 0.8 + 1e-9) THEN 1 ELSE 0 END AS INTEGER) AS train FROM r")
def split_sequence(spark: SparkSession, sf: str) -> DataFrame:
    a, b = select.train_test_split(fx.table(spark, sf, "part"), "p_partkey", 0.2)
    return a.select("p_partkey", F.lit(1).alias("train")).union(b.select("p_partkey", F.lit(0).alias("train")))


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY substr(md5(concat(CAST(p_partkey AS VARCHAR), '-7')), 1, 15), p_partkey) AS rn, count(*) OVER () AS n FROM part) SELECT p_partkey, CAST(CASE WHEN rn <= floor(n * 0.75 + 1e-9) THEN 1 ELSE 0 END AS INTEGER) AS train FROM r")
def split_hashed(spark: SparkSession, sf: str) -> DataFrame:
    a, b = select.train_test_split(fx.table(spark, sf, "part"), "p_partkey", 0.25, random=True, seed=7)
    return a.select("p_partkey", F.lit(1).alias("train")).union(b.select("p_partkey", F.lit(0).alias("train")))


@query(f"WITH {fx.JOINED} SELECT id, y, avg_disc, avg_tax, sum_price FROM joined")
def feature_split(spark: SparkSession, sf: str) -> DataFrame:
    return joined_frame(spark, sf).feature_split(2)[1].table()


@query(f"WITH {fx.JOINED} SELECT id, n_lines, sum_qty FROM joined")
def vertical_split(spark: SparkSession, sf: str) -> DataFrame:
    return joined_frame(spark, sf).vertical_split(0.5)[1].table()


@query("SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 5")
def sample_first_k_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return select.first_per_class(fx.table(spark, sf, "embeddings").select("vec_id", "label"), "label", ["vec_id"], 5)


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM events), s AS (SELECT *, CAST((rn - 1) // CAST(ceil(n / 8) AS BIGINT) AS INTEGER) AS shard FROM r) SELECT event_id, shard, CAST(shard % 4 AS INTEGER) AS client_id FROM s")
def noniid_shards(spark: SparkSession, sf: str) -> DataFrame:
    return select.shards(fx.table(spark, sf, "events").select("event_id", "value"), ["event_id"], "value", 8, 4).select("event_id", "shard", "client_id")


@query("SELECT vec_id, embedding[1:8] || embedding[17:24] || embedding[33:40] || embedding[49:56] AS left_half FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)")
def image_crop(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors read as images of 4 x 16 pixels; the left party's half."""
    return fx.vectors(spark, sf).select("vec_id", party_crops(F.col("vec"), 4, 16, 2)[0].alias("left_half"))


# --- cleaning ---


def _drawn(name: str, n: int) -> str:
    return f"CAST(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '-2-5-{name}'), 1, 8) AS UBIGINT) % {n} AS INTEGER)"


@query(f"""WITH {fx.VECTORS}, own AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN list_transform(vec, lambda x: 1.0::DOUBLE) ELSE vec END AS px, {_drawn('y', 3)} - 1 AS dy, {_drawn('x', 3)} - 1 AS dx, {_drawn('flip', 2)} AS f FROM vectors),
  p AS (SELECT vec_id, px, i, i // 8 + dy AS y, CASE WHEN f = 1 THEN 7 - i % 8 ELSE i % 8 END + dx AS x FROM own, range(64) r(i))
  SELECT vec_id, list(CASE WHEN y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 THEN px[y * 8 + x + 1] ELSE 0 END ORDER BY i) AS image FROM p GROUP BY 1""")
def image_augmented(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as images of 8 x 8 pixels in epoch 2: some replaced, then shifted by up to a pixel and turned."""
    v = fx.vectors(spark, sf).select("vec_id", "vec")
    poisoned = v.where("vec_id % 50 = 0").select("vec_id", F.transform("vec", lambda x: F.lit(1.0)).alias("vec"))
    return overridden(v, "vec_id", "vec", poisoned).select("vec_id", augmented("vec", 8, 8, "vec_id", seed=5, epoch=2, pad=1).alias("image"))


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP) AS day FROM orders")
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "none").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    return clean.parse_dates(o, ["day"])


@query(f"WITH {fx.DIRTY} SELECT id, size, price, brand FROM dirty WHERE CAST(size IS NULL AS INTEGER) + CAST(price IS NULL AS INTEGER) + CAST(brand IS NULL AS INTEGER) + CAST(type IS NULL AS INTEGER) < 1.5")
def clean_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_sparse(fx.dirty(spark, sf), 0.3, 0.3)


@query(f"WITH {fx.DIRTY}, s AS (SELECT avg(size) AS m, stddev_pop(size) AS s FROM dirty) SELECT id, CASE WHEN abs(size - m) > s THEN NULL ELSE size END AS size FROM dirty, s")
def outlier_to_null(spark: SparkSession, sf: str) -> DataFrame:
    return clean.outliers_to_null(fx.dirty(spark, sf).select("id", "size"), ["size"])


@query(f"WITH {fx.DIRTY}, m AS (SELECT (SELECT size FROM dirty WHERE size IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS size, (SELECT brand FROM dirty WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS brand) SELECT id, coalesce(dirty.size, m.size) AS size, coalesce(dirty.brand, m.brand) AS brand FROM dirty, m")
def fill_mode(spark: SparkSession, sf: str) -> DataFrame:
    return clean.fill_mode(fx.dirty(spark, sf).select("id", "size", "brand"), ["size", "brand"])


@query("WITH c AS (SELECT c_mktsegment AS v, CAST(row_number() OVER (ORDER BY min(c_custkey), c_mktsegment) - 1 AS INTEGER) AS code FROM customer GROUP BY 1) SELECT c_custkey, code AS c_mktsegment FROM customer JOIN c ON v = c_mktsegment")
def encode_categories(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return clean.encode(c, "c_mktsegment", clean.category_codes(c, "c_mktsegment", "c_custkey"))


@query(f"""WITH {fx.DIRTY}, kept AS (SELECT id, size, price, brand FROM dirty WHERE CAST(size IS NULL AS INTEGER) + CAST(price IS NULL AS INTEGER) + CAST(brand IS NULL AS INTEGER) + CAST(type IS NULL AS INTEGER) < 1.5),
  s AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM kept),
  o AS (SELECT id, size, CASE WHEN abs(price - m) > s THEN NULL ELSE price END AS price, brand FROM kept, s),
  f AS (SELECT id, coalesce(size, (SELECT size FROM o WHERE size IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS size,
               coalesce(price, (SELECT price FROM o WHERE price IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS price,
               coalesce(brand, (SELECT brand FROM o WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS brand FROM o),
  c AS (SELECT brand AS v, CAST(row_number() OVER (ORDER BY min(id), brand) - 1 AS INTEGER) AS code FROM f GROUP BY 1)
  SELECT id, size, price, code AS brand FROM f JOIN c ON v = brand""")
def clean_chain(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean(fx.dirty(spark, sf), "id")


@query(f"""WITH {fx.JOINED}, {fx.LONG}, t AS (SELECT feature, max(c) AS top_n FROM (SELECT feature, value, count(*) AS c FROM long GROUP BY 1, 2) GROUP BY 1)
  SELECT feature, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, max(value) AS max,
  count(DISTINCT value) AS nunique, CAST(0 AS DOUBLE) AS missing_rate, round(max(value) - min(value), 4) AS range, round(any_value(top_n) / count(value), 6) AS top_share FROM long JOIN t USING (feature) GROUP BY 1""")
def describe_features(spark: SparkSession, sf: str) -> DataFrame:
    d = evaluate.describe(fx.joined(spark, sf), fx.FEATURES)
    return d.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75", "range")}).withColumn("top_share", F.round("top_share", 6))


# --- transforms ---


@query(f"WITH {fx.JOINED} SELECT id, round((sum_qty - avg(sum_qty) OVER ()) / stddev_pop(sum_qty) OVER (), 6) AS sum_qty, round((sum_price - avg(sum_price) OVER ()) / stddev_pop(sum_price) OVER (), 6) AS sum_price FROM joined")
def scale_features(spark: SparkSession, sf: str) -> DataFrame:
    s = transform.scale(fx.joined(spark, sf), ["sum_qty", "sum_price"])
    return s.select("id", F.round("sum_qty", 6).alias("sum_qty"), F.round("sum_price", 6).alias("sum_price"))


def _normalized(spark: SparkSession, sf: str, norm: str) -> DataFrame:
    n = transform.normalize(fx.passive(spark, sf), ["n_lines", "sum_qty", "avg_disc"], norm)
    return n.select("id", *[F.round(c, 6).alias(c) for c in ("n_lines", "sum_qty", "avg_disc")])


def _norm_sql(size: str) -> str:
    return f"WITH {fx.PASSIVE} SELECT id, round(n_lines / ({size}), 6) AS n_lines, round(sum_qty / ({size}), 6) AS sum_qty, round(avg_disc / ({size}), 6) AS avg_disc FROM passive"


@query(_norm_sql("abs(n_lines) + abs(sum_qty) + abs(avg_disc)"))
def normalize_l1(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf, "l1")


@query(_norm_sql("sqrt(n_lines * n_lines + sum_qty * sum_qty + avg_disc * avg_disc)"))
def normalize_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf, "l2")


@query(_norm_sql("greatest(abs(n_lines), abs(sum_qty), abs(avg_disc))"))
def normalize_max(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf, "max")


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS y FROM orders")
def parse_label(spark: SparkSession, sf: str) -> DataFrame:
    return transform.parse_label(fx.active(spark, sf).select("id", F.when(F.col("y") == 1, 1).otherwise(-1).alias("y")), "y")


@query(f"WITH {fx.ACTIVE} SELECT *, CAST(1 AS DOUBLE) AS intercept FROM active")
def add_intercept(spark: SparkSession, sf: str) -> DataFrame:
    return transform.add_intercept(fx.active(spark, sf))


@query("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{v}' AS INTEGER) AS \"c_mktsegment_{v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return transform.one_hot(fx.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))


_EDGES = "e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1), coded AS (SELECT l.*, CAST(value > lo + 1 * ((hi - lo) / 3) AS INTEGER) + CAST(value > lo + 2 * ((hi - lo) / 3) AS INTEGER) AS bin FROM long l JOIN e USING (feature))"


@query(f"WITH {fx.JOINED}, {fx.LONG}, {_EDGES} SELECT id, max(bin) FILTER (feature = 'sum_qty') AS sum_qty, max(bin) FILTER (feature = 'sum_price') AS sum_price FROM coded GROUP BY 1")
def bin_equal_width(spark: SparkSession, sf: str) -> DataFrame:
    j = fx.joined(spark, sf)
    return transform.apply_bins(j, transform.width_edges(j, ["sum_qty", "sum_price"], 3)).select("id", "sum_qty", "sum_price")


@query("WITH e AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part) SELECT p_partkey, CAST(p_retailprice > q[1] AS INTEGER) + CAST(p_retailprice > q[2] AS INTEGER) + CAST(p_retailprice > q[3] AS INTEGER) AS p_retailprice FROM part, e")
def bin_quantile(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return transform.apply_bins(p, transform.quantile_edges(p, ["p_retailprice"], 4))


@query(f"WITH {fx.JOINED}, r AS (SELECT sum_qty AS v, row_number() OVER (ORDER BY sum_qty, id) AS rn, count(*) OVER () AS n FROM joined), e AS (SELECT DISTINCT v FROM r, range(1, 9) t(k) WHERE rn = greatest(1, n * k // 8)) SELECT id, CAST((SELECT count(*) FROM e WHERE e.v < j.sum_qty) AS INTEGER) AS bin FROM joined j")
def bin_tree(spark: SparkSession, sf: str) -> DataFrame:
    j = fx.joined(spark, sf)
    return j.select("id", transform.bin_code(F.col("sum_qty"), transform.tree_edges(j, "sum_qty", 8)).alias("bin"))


@query(f"WITH {fx.JOINED}, s AS (SELECT id, (sum_qty - avg(sum_qty) OVER ()) / stddev_pop(sum_qty) OVER () AS a, (sum_price - avg(sum_price) OVER ()) / stddev_pop(sum_price) OVER () AS b FROM joined) SELECT id, round(a / sqrt(a * a + b * b), 6) AS sum_qty, round(b / sqrt(a * a + b * b), 6) AS sum_price, CAST(1 AS DOUBLE) AS intercept FROM s")
def compose_transforms(spark: SparkSession, sf: str) -> DataFrame:
    own = ["sum_qty", "sum_price"]
    out = transform.compose(fx.joined(spark, sf), [lambda d: transform.scale(d, own), lambda d: transform.normalize(d, own), transform.add_intercept])
    return out.select("id", *[F.round(c, 6).alias(c) for c in own], "intercept")


@query(f"WITH {fx.JOINED} SELECT a, b, round(cov, 4) AS cov FROM (SELECT 'n_lines' AS a, 'n_lines' AS b, covar_pop(n_lines, n_lines) AS cov FROM joined UNION ALL SELECT 'n_lines', 'sum_qty', covar_pop(n_lines, sum_qty) FROM joined UNION ALL SELECT 'sum_qty', 'sum_qty', covar_pop(sum_qty, sum_qty) FROM joined)")
def covariance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return transform.covariance(fx.joined(spark, sf), ["n_lines", "sum_qty"]).withColumn("cov", F.round("cov", 4))


@query(f"WITH {fx.VECTORS} SELECT max(n) AS n, round(sum(v), 6) AS total FROM (SELECT i, var_samp(vec[i]) AS v, count(*) AS n FROM vectors, range(1, 65) r(i) GROUP BY 1)")
def pca_total_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Variances along eight components and the noise in the other dimensions make up the whole."""
    p = transform.pca_fit(fx.vectors(spark, sf), "vec", 8)
    return spark.createDataFrame([(p["n_samples"], round(float(p["explained_variance"].sum() + 56 * p["noise_variance"]), 6))], "n long, total double")


@query()
def pca_scores(spark: SparkSession, sf: str) -> DataFrame:
    return transform.pca(transform.scale(fx.joined(spark, sf), fx.FEATURES), "id", fx.FEATURES, 2)[0]
