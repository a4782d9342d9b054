"""Queries on feature evaluation, metrics, trees, linear models, clusters, federated and split learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto, losses
from ..operators import evaluate, federated, kmeans, linear, metrics, neural, select, transform, trees
from ..operators.trees import TreeParams
from . import fixtures as fx
from .tabular import _EDGES, query

# --- feature evaluation ---

_WOE = """sums AS (SELECT feature, bin, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM coded GROUP BY 1, 2),
  pq AS (SELECT *, pos / sum(pos) OVER (PARTITION BY feature) AS p, neg / sum(neg) OVER (PARTITION BY feature) AS q FROM sums),
  woe AS (SELECT *, CASE WHEN pos = 0 OR neg = 0 THEN ln((p + 1e-7) / (q + 1e-7)) ELSE ln(p / q) END AS woe FROM pq)"""
_WOE_WITH = f"WITH {fx.JOINED}, {fx.LONG}, {_EDGES}, {_WOE}"


@query(f"{_WOE_WITH} SELECT feature, round(sum((p - q) * woe), 6) AS iv FROM woe GROUP BY 1")
def vertical_iv(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the passive party's features tell most about the active party's label?"""
    iv = evaluate.information_value(fx.joined(spark, sf), fx.FEATURES, "y")
    return iv.select("feature", F.round("iv", 6).alias("iv"))


@query(f"{_WOE_WITH} SELECT feature, bin, pos, neg, round(woe, 6) AS woe, round((p - q) * woe, 6) AS iv FROM woe")
def woe_table(spark: SparkSession, sf: str) -> DataFrame:
    w = evaluate.woe(fx.joined(spark, sf), fx.FEATURES, "y")
    return w.withColumn("woe", F.round("woe", 6)).withColumn("iv", F.round("iv", 6))


@query(f"{_WOE_WITH} SELECT c.id, round(max(w.woe) FILTER (feature = 'sum_qty'), 6) AS sum_qty, round(max(w.woe) FILTER (feature = 'avg_disc'), 6) AS avg_disc FROM coded c JOIN woe w USING (feature, bin) GROUP BY 1")
def woe_encode(spark: SparkSession, sf: str) -> DataFrame:
    j = fx.joined(spark, sf)
    own = ["sum_qty", "avg_disc"]
    return evaluate.woe_encode(j, evaluate.fit_woe(j, own, "y")).select("id", *[F.round(c, 6).alias(c) for c in own])


@query(f"""WITH {fx.JOINED.replace('joined AS (SELECT', 'every AS (SELECT')}, joined AS (SELECT * FROM every WHERE id % 2 = 0), {fx.LONG}, {_EDGES}, {_WOE}
  SELECT j.id, round(w.woe, 6) AS sum_qty FROM (SELECT id, CAST(sum_qty > lo + (hi - lo) / 3 AS INTEGER) + CAST(sum_qty > lo + 2 * ((hi - lo) / 3) AS INTEGER) AS bin FROM every, (SELECT * FROM e WHERE feature = 'sum_qty') WHERE id % 2 = 1) j JOIN woe w ON w.bin = j.bin AND w.feature = 'sum_qty'""")
def woe_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Weights fitted on one half of the ids and applied to the other half."""
    j = fx.joined(spark, sf)
    fitted = evaluate.fit_woe(j.where("id % 2 = 0"), ["sum_qty"], "y")
    return evaluate.woe_encode(j.where("id % 2 = 1"), fitted).select("id", F.round("sum_qty", 6).alias("sum_qty"))


_CHI_BASE = "t AS (SELECT p_size AS value, CAST(p_retailprice > 1500 AS INTEGER) AS y FROM part), x AS (SELECT value, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM t GROUP BY 1)"


def _chi_parts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "part").select(F.col("p_size").alias("value"), (F.col("p_retailprice") > 1500).cast("int").alias("y"))


@query(f"""WITH {_CHI_BASE}, l AS (SELECT *, lag(n0) OVER (ORDER BY value) AS p0, lag(n1) OVER (ORDER BY value) AS p1 FROM x),
  n AS (SELECT *, p0 + p1 + n0 + n1 AS t FROM l WHERE p0 IS NOT NULL),
  e AS (SELECT value, unnest([p0, p1, n0, n1]) AS o, unnest([(p0 + p1) * (p0 + n0) / t, (p0 + p1) * (p1 + n1) / t, (n0 + n1) * (p0 + n0) / t, (n0 + n1) * (p1 + n1) / t]) AS e FROM n)
  SELECT value, round(sum(CASE WHEN e > 0 THEN (o - e) * (o - e) / e ELSE 0 END), 6) AS chi FROM e GROUP BY 1""")
def chi_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.chi_adjacent(_chi_parts(spark, sf), "value", "y").withColumn("chi", F.round("chi", 6))


def _merge_sql(source: str, max_group: int) -> str:
    """The greedy loop as a recursion over lists of groups, from source (feature, value, y)."""
    cell = lambda at, col: f"CASE WHEN g[{at}].t * (g[i].{col} + g[i + 1].{col}) > 0 THEN pow(g[{at}].{col} - g[{at}].t * (g[i].{col} + g[i + 1].{col}) / (g[i].t + g[i + 1].t), 2) / (g[{at}].t * (g[i].{col} + g[i + 1].{col}) / (g[i].t + g[i + 1].t)) ELSE 0 END"
    chi = f"(({cell('i', 'a')} + {cell('i', 'b')}) + ({cell('i + 1', 'a')} + {cell('i + 1', 'b')}))"
    return f"""x AS (SELECT feature, value, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS b FROM {source} GROUP BY 1, 2),
  m AS (SELECT feature, list({{'low': CAST(value AS DOUBLE), 'a': a, 'b': b, 't': a + b}} ORDER BY value) AS g FROM x GROUP BY 1
    UNION ALL SELECT feature, g[1:k - 1] || [{{'low': g[k].low, 'a': g[k].a + g[k + 1].a, 'b': g[k].b + g[k + 1].b, 't': g[k].t + g[k + 1].t}}] || g[k + 2:] FROM (SELECT feature, g, list_position(c, list_min(c)) AS k FROM (SELECT feature, g, list_transform(range(1, len(g)), lambda i: {chi}) AS c FROM m WHERE len(g) > {max_group}))),
  kept AS (SELECT feature, unnest(range(1, len(g) + 1)) AS grp, g FROM m WHERE len(g) <= {max_group})"""


@query(f"WITH RECURSIVE t AS (SELECT 'value' AS feature, p_size AS value, CAST(p_retailprice > 1500 AS INTEGER) AS y FROM part), {_merge_sql('t', 5)} SELECT CAST(grp AS INTEGER) AS grp, g[grp].low AS low FROM kept")
def chi_merge(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.chi_merge(_chi_parts(spark, sf), "value", "y", 5)


@query()
def chi_merge_features(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of all features of both parties, counts and sums alike."""
    return evaluate.chi_merge_all(fx.joined(spark, sf), [*fx.ACTIVE_FEATURES, *fx.FEATURES], "y", 5)


_CHI_TWO = "u AS (SELECT 'p_size' AS feature, p_size AS value, CAST(p_retailprice > 1500 AS INTEGER) AS y FROM part UNION ALL SELECT 'letters', length(p_name || p_type), CAST(p_retailprice > 1500 AS INTEGER) FROM part)"


def _chi_two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = fx.table(spark, sf, "part")
    return p.select("p_partkey", "p_size", F.length(F.concat("p_name", "p_type")).alias("letters")), p.select("p_partkey", (F.col("p_retailprice") > 1500).cast("int").alias("y"))


@query(f"WITH RECURSIVE {_CHI_TWO}, {_merge_sql('u', 4)} SELECT feature, CAST(grp AS INTEGER) AS grp, g[grp].low AS low FROM kept")
def chi_merge_private(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of one party's features by labels that the other keeps encrypted."""
    passive, active = _chi_two(spark, sf)
    return evaluate.private_chi_merge(passive, active, "p_partkey", ["p_size", "letters"], "y", crypto.Paillier.generate(512, seed=11), 4)


@query(f"WITH RECURSIVE {_CHI_TWO}, {_merge_sql('u', 4)}, w AS (SELECT feature, list(g[grp].low) AS lows FROM kept GROUP BY 1), b AS (SELECT p_partkey, p_size, length(p_name || p_type) AS letters FROM part) SELECT p_partkey, 'group' || greatest(len(list_filter(s.lows, lambda e: p_size >= e)), 1) AS p_size, 'group' || greatest(len(list_filter(l.lows, lambda e: letters >= e)), 1) AS letters FROM b, (SELECT lows FROM w WHERE feature = 'p_size') s, (SELECT lows FROM w WHERE feature = 'letters') l")
def chi_bin(spark: SparkSession, sf: str) -> DataFrame:
    """Values replaced by their groups."""
    passive, active = _chi_two(spark, sf)
    groups = evaluate.chi_merge_all(passive.join(active, "p_partkey"), ["p_size", "letters"], "y", 4)
    return evaluate.chi_bin(passive, groups)


@query("SELECT p_partkey, 'group' || greatest(CAST(p_size >= 10 AS INTEGER) + CAST(p_size >= 20 AS INTEGER) + CAST(p_size >= 40 AS INTEGER), 1) AS grp FROM part")
def chi_groups(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "part").select("p_partkey", evaluate.chi_groups(F.col("p_size"), [10, 20, 40]).alias("grp"))


@query(f"WITH {fx.JOINED} SELECT feature, round(corr, 6) AS corr FROM (UNPIVOT (SELECT corr(n_lines, y) AS n_lines, corr(sum_qty, y) AS sum_qty, corr(avg_disc, y) AS avg_disc, corr(avg_tax, y) AS avg_tax, corr(sum_price, y) AS sum_price FROM joined) ON n_lines, sum_qty, avg_disc, avg_tax, sum_price INTO NAME feature VALUE corr)")
def pearson_label(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.label_correlation(fx.joined(spark, sf), fx.FEATURES, "y").withColumn("corr", F.round("corr", 6))


_TRIO = ("n_lines", "sum_qty", "avg_disc")


def _matrix_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(corr({a}, {b}), 0), 6) AS corr FROM {source}" for a in _TRIO for b in _TRIO)


@query(f"WITH {fx.JOINED} {_matrix_sql('joined')}")
def pearson_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.correlation_matrix(fx.joined(spark, sf), _TRIO).withColumn("corr", F.round("corr", 6))


@query(f"WITH {fx.JOINED}, ranked AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in _TRIO) + f" FROM joined) {_matrix_sql('ranked')}")
def spearman_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.correlation_matrix(fx.joined(spark, sf).select("id", *_TRIO), _TRIO, "spearman").withColumn("corr", F.round("corr", 6))


_HOLES = "holes AS (SELECT id, size, price, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 17 END AS cycle FROM dirty)"


def _pair_sql(a: str, b: str) -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {n}" for c, n in ((a, "u"), (b, "w")))
    return f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(corr(u, w), 0), 6) AS corr FROM (SELECT {ranks} FROM holes WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query(f"WITH {fx.DIRTY}, {_HOLES} " + " UNION ALL ".join(_pair_sql(a, b) for a in ("size", "price", "cycle") for b in ("size", "price", "cycle")))
def spearman_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair over the rows that have both."""
    holes = fx.dirty(spark, sf).select("id", "size", "price", F.when(F.col("id") % 3 != 0, F.col("id") % 17).alias("cycle"))
    return evaluate.correlation_matrix(holes, ["size", "price", "cycle"], "spearman").withColumn("corr", F.round("corr", 6))


@query(f"""WITH {fx.CLIENTS}, base AS (SELECT value FROM clients WHERE day <= 15), test AS (SELECT value FROM clients WHERE day > 15),
  k AS (SELECT least(20, count(value) // 10) AS k, count(value) AS n FROM base), m AS (SELECT count(value) AS n FROM test),
  e AS (SELECT DISTINCT round(unnest(quantile_cont(value, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])), 4) AS e FROM base),
  b AS (SELECT (SELECT count(*) FROM e WHERE e < value) AS bin, count(*) / any_value(k.n) AS s FROM base, k GROUP BY 1),
  t AS (SELECT (SELECT count(*) FROM e WHERE e < value) AS bin, count(*) / any_value(m.n) AS s FROM test, m GROUP BY 1),
  j AS (SELECT coalesce(b.s, 0) AS b0, coalesce(t.s, 0) AS t0, (SELECT n FROM k) AS nb, (SELECT n FROM m) AS nt FROM b FULL JOIN t USING (bin)),
  f AS (SELECT CASE WHEN b0 = 0 THEN 1 / nb ELSE b0 END AS b, CASE WHEN t0 = 0 THEN 1 / nt ELSE t0 END AS t FROM j)
  SELECT round(sum((t - b) * ln(t / b)), 6) AS psi FROM f""")
def stability_index(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.clients(spark, sf)
    return evaluate.stability_index(c.where("day <= 15"), c.where("day > 15"), "value").select(F.round("psi", 6).alias("psi"))


@query()
def tree_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Features ranked by the gain of this library's own boosted trees."""
    ranked = evaluate.importance_ranking(evaluate.tree_importance(fx.joined(spark, sf), fx.FEATURES, "y", trees=3))
    return ranked.withColumn("importance", F.round("importance", 6))


# --- metrics ---

_KS = "g AS (SELECT k, k / 49 AS t FROM range(50) r(k)), kt AS (SELECT k, any_value(t) AS threshold, count(*) FILTER (y = 1 AND p > t) / count(*) FILTER (y = 1) AS tpr, count(*) FILTER (y <> 1 AND p > t) / count(*) FILTER (y <> 1) AS fpr FROM scored, g GROUP BY 1)"


@query(f"WITH {fx.SCORED}, {_KS} SELECT CAST(k AS INTEGER) AS k, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(abs(fpr - tpr), 6) AS ks FROM kt")
def ks_table(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ks_table(fx.scored(spark, sf)).select("k", *[F.round(c, 6).alias(c) for c in ("threshold", "tpr", "fpr", "ks")])


@query(f"WITH {fx.SCORED}, {_KS} SELECT round(max(abs(fpr - tpr)), 6) AS ks, round(arg_max(threshold, (abs(fpr - tpr), -k)), 6) AS threshold FROM kt")
def ks_value(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ks_value(fx.scored(spark, sf)).select(F.round("ks", 6).alias("ks"), F.round("threshold", 6).alias("threshold"))


_AUC = "r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM scored), a AS (SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r)"


@query(f"WITH {fx.SCORED}, {_AUC} SELECT round(auc, 6) AS auc FROM a")
def auc_value(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(fx.scored(spark, sf)).select(F.round("auc", 6).alias("auc"))


@query(f"WITH {fx.SCORED}, {_AUC} SELECT round((auc - 0.5) / 0.5, 6) AS gini FROM a")
def gini_value(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(fx.scored(spark, sf)).select(F.round("gini", 6).alias("gini"))


@query(f"""WITH {fx.SCORED}, c AS (SELECT count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y = 0 AND p > 0.5) AS fp, count(*) FILTER (y = 1 AND p <= 0.5) AS fn, count(*) FILTER (y = 0 AND p <= 0.5) AS tn,
    avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END) AS ll FROM scored)
  SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS acc, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
    round((2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fn + fp) * (tn + fp)) / (tp + fp + fn + tn), 6) AS weighted_f1, round(ll, 6) AS log_loss FROM c""")
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.binary_metrics(fx.scored(spark, sf))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("""WITH c AS (SELECT label AS y, CAST(vec_id % 10 AS INTEGER) AS q FROM embeddings), k AS (SELECT DISTINCT y AS c FROM c UNION SELECT DISTINCT q FROM c),
  s AS (SELECT k.c, count(*) FILTER (y = k.c) AS t, count(*) FILTER (q = k.c) AS n, count(*) FILTER (y = k.c AND q = k.c) AS h FROM c, k GROUP BY 1)
  SELECT round(sum(h) / sum(t), 6) AS acc, round(sum(t * coalesce(2 * h / nullif(t + n, 0), 0)) / sum(t), 6) AS weighted_f1 FROM s""")
def multiclass_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "embeddings").select(F.col("label").alias("y"), (F.col("vec_id") % 10).cast("int").alias("q"))
    return metrics.multiclass_metrics(c, "y", "q").select(F.round("acc", 6).alias("acc"), F.round("weighted_f1", 6).alias("weighted_f1"))


@query("WITH p AS (SELECT p_retailprice AS y, 900 + 20.0 * p_size AS q FROM part) SELECT round(avg(abs(y - q)), 4) AS mae, round(avg((y - q) * (y - q)), 4) AS mse, round(sum((y - q) * (y - q)), 2) AS sse, round(1 - sum((y - q) * (y - q)) / (var_pop(y) * count(*)), 6) AS r2 FROM p")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part").select(F.col("p_retailprice").alias("y"), (900 + 20.0 * F.col("p_size")).alias("q"))
    return metrics.regression_metrics(p, "y", "q").select(F.round("mae", 4).alias("mae"), F.round("mse", 4).alias("mse"), F.round("sse", 2).alias("sse"), F.round("r2", 6).alias("r2"))


@query(f"WITH {fx.SCORED}, r AS (SELECT id, row_number() OVER w AS k, sum(y) OVER w AS c, count(*) OVER () AS n, sum(y) OVER () AS t FROM scored WINDOW w AS (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)) SELECT id, round(k / n, 6) AS x, round(c / k / (t / n), 6) AS lift FROM r")
def lift_curve(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.lift_curve(fx.scored(spark, sf), "id").select("id", F.round("x", 6).alias("x"), F.round("lift", 6).alias("lift"))


@query(f"WITH {fx.SCORED} SELECT id, p, round(sum(y) OVER (ORDER BY y, id ROWS UNBOUNDED PRECEDING) / sum(y) OVER (), 6) AS share FROM scored")
def lorenz_curve(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.lorenz_curve(fx.scored(spark, sf), "id").withColumn("share", F.round("share", 6))


_CURVE = "c AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1), u AS (SELECT p AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM c WINDOW w AS (ORDER BY p DESC))"


@query(f"WITH {fx.SCORED}, {_CURVE} SELECT threshold, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr FROM u")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_points(fx.scored(spark, sf)).select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"WITH {fx.SCORED}, {_CURVE} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall FROM u")
def pr_points(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pr_points(fx.scored(spark, sf)).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {fx.SCORED} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY 1")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.score_histogram(fx.scored(spark, sf))


@query(f"WITH {fx.SCORED} SELECT min(p) AS low, round(quantile_cont(p, 0.25), 6) AS q25, round(quantile_cont(p, 0.5), 6) AS q50, round(quantile_cont(p, 0.75), 6) AS q75, max(p) AS high FROM scored")
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.box_stats(fx.scored(spark, sf)).withColumns({c: F.round(c, 6) for c in ("q25", "q50", "q75")})


@query(f"WITH {fx.SCORED}, s AS (SELECT y, avg(p) AS m, stddev_pop(p) AS s FROM scored GROUP BY 1), g AS (SELECT k, k / 49 AS x FROM range(50) r(k)) SELECT CAST(k AS INTEGER) AS k, round(any_value(x), 6) AS x, round(sum(exp(-((x - m) / s) * ((x - m) / s) / 2) / (s * sqrt(2 * pi()))), 6) AS density FROM s, g GROUP BY 1")
def bimodal_density(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bimodal(fx.scored(spark, sf)).select("k", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(f"""WITH {fx.VECTORS}, d AS (SELECT a.vec_id, a.label, b.label AS other, sum({_D2.format(a='a.vec', b='b.vec')}) AS s, count(*) AS n FROM vectors a, vectors b GROUP BY 1, 2, 3),
  ab AS (SELECT vec_id, label, max(s / greatest(n - 1, 1)) FILTER (label = other) AS a, min(s / n) FILTER (label <> other) AS b, max(n) FILTER (label = other) AS own FROM d GROUP BY 1, 2)
  SELECT label AS cluster, round(avg(CASE WHEN own <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab GROUP BY 1""")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.silhouette(fx.vectors(spark, sf), "vec", "label").withColumn("silhouette", F.round("silhouette", 6))


# --- trees ---


@query(f"WITH {fx.SCORED}, s AS (SELECT id, y, greatest(least(p, 0.99), 0.01) AS p FROM scored) SELECT id, round(-(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS loss, round(p - y, 6) AS g, round(p * (1 - p), 6) AS h FROM s")
def gradient_hessian(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.scored(spark, sf).withColumn("p", F.greatest(F.least("p", F.lit(0.99)), F.lit(0.01)))
    loss, g, h = losses.cross_entropy(F.col("y"), F.col("p"))
    return s.select("id", F.round(loss, 6).alias("loss"), F.round(g, 6).alias("g"), F.round(h, 6).alias("h"))


@query("""WITH p AS (SELECT p_partkey AS id, p_retailprice / 100 AS y, p_size / 3 AS q FROM part), d AS (SELECT *, q - y AS d FROM p)
  SELECT id, round(d * d, 6) AS squared, round(2 * d, 6) AS squared_g, round(abs(d), 6) AS absolute, round(CASE WHEN abs(d) <= 1 THEN d * d / 2 ELSE abs(d) - 0.5 END, 6) AS huber, round(CASE WHEN abs(d) <= 1 THEN d ELSE sign(d) END, 6) AS huber_g,
    round(abs(d) - ln(abs(d) + 1), 6) AS fair, round(d / (abs(d) + 1), 6) AS fair_g, round(ln(cosh(d)), 6) AS log_cosh, round(tanh(d), 6) AS log_cosh_g FROM d""")
def regression_losses(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_size") / 3).alias("q"))
    out = {}
    for name in ("squared", "absolute", "huber", "fair", "log_cosh"):
        loss, g, _ = losses.LOSSES[name](F.col("y"), F.col("q"))
        out |= {name: loss} | ({f"{name}_g": g} if name != "absolute" else {})
    return p.select("id", *[F.round(c, 6).alias(n) for n, c in out.items()])


_TREE = ("sum_qty", "n_lines")
_GH = "gh AS (SELECT id, y, n_lines, sum_qty, 0.5::DOUBLE - y AS g, 0.25::DOUBLE AS h FROM joined)"
_BINS = "coded AS (SELECT g, h, 'sum_qty' AS feature, CAST(sum_qty > 50 AS INTEGER) + CAST(sum_qty > 100 AS INTEGER) + CAST(sum_qty > 150 AS INTEGER) AS bin FROM gh UNION ALL SELECT g, h, 'n_lines', CAST(n_lines > 2 AS INTEGER) + CAST(n_lines > 4 AS INTEGER) FROM gh), hist AS (SELECT feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM coded GROUP BY 1, 2)"
_TREE_EDGES = {"sum_qty": [50.0, 100.0, 150.0], "n_lines": [2.0, 4.0]}


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    j = fx.joined(spark, sf).select((0.5 - F.col("y")).alias("g"), F.lit(0.25).alias("h"), F.lit(0).alias("node"), *_TREE)
    return transform.apply_bins(j, _TREE_EDGES)


@query(f"WITH {fx.JOINED}, {_GH}, {_BINS} SELECT feature, bin, round(g, 6) AS g, round(h, 6) AS h, n FROM hist")
def tree_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return trees.histogram(_coded(spark, sf), _TREE).select("feature", "bin", F.round("g", 6).alias("g"), F.round("h", 6).alias("h"), "n")


_GAINS = """cum AS (SELECT feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER f AS gt, sum(h) OVER f AS ht, max(bin) OVER f AS last FROM hist WINDOW w AS (PARTITION BY feature ORDER BY bin), f AS (PARTITION BY feature)),
  gains AS (SELECT *, 0.5 * (0.5 * gl * gl / (hl + 0.1) + 0.5 * (gt - gl) * (gt - gl) / (ht - hl + 0.1) - 0.5 * gt * gt / (ht + 0.1)) - 0.1 AS gain FROM cum WHERE bin < last)"""


@query(f"WITH {fx.JOINED}, {_GH}, {_BINS}, {_GAINS} SELECT feature, bin, round(gain, 6) AS gain, CAST(nl AS BIGINT) AS nl FROM gains ORDER BY gain DESC, feature, bin LIMIT 1")
def tree_best_split(spark: SparkSession, sf: str) -> DataFrame:
    best = trees.best_splits(trees.histogram(_coded(spark, sf), _TREE))
    return best.select("feature", "bin", F.round("gain", 6).alias("gain"), "nl")


@query(f"WITH {fx.JOINED}, {_GH}, {_BINS}, {_GAINS}, b AS (SELECT * FROM gains ORDER BY gain DESC, feature, bin LIMIT 1) SELECT round(-gl / (hl + 0.1), 6) AS left_weight, round(-(gt - gl) / (ht - hl + 0.1), 6) AS right_weight FROM b")
def leaf_weights(spark: SparkSession, sf: str) -> DataFrame:
    b = trees.best_splits(trees.histogram(_coded(spark, sf), _TREE))
    left = trees.leaf_weight(F.col("gl"), F.col("hl"))
    right = trees.leaf_weight(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl"))
    return b.select(F.round(left, 6).alias("left_weight"), F.round(right, 6).alias("right_weight"))


@query(f"WITH {fx.JOINED} SELECT id, round(CAST(CASE WHEN sum_qty > 100 THEN CASE WHEN n_lines > 4 THEN -3 ELSE -2 END ELSE -1 END AS DOUBLE) / 2.1, 6) AS value FROM joined")
def tree_predict(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed tree of three leaves as one expression."""
    leaf = lambda k: trees.Node(k, float(k), 2.0, 1)
    right = trees.Node(9, 0, 0, 0, 1, "n_lines", 4.0, 1.0, leaf(2), leaf(3))
    tree = trees.Node(0, 0, 0, 0, 0, "sum_qty", 100.0, 1.0, leaf(1), right)
    return fx.joined(spark, sf).select("id", F.round(trees.value_of(tree, 0.1), 6).alias("value"))


@query(f"""WITH {fx.JOINED}, {_GH}, {_BINS}, {_GAINS}, b AS (SELECT * FROM gains ORDER BY gain DESC, feature, bin LIMIT 1)
  SELECT id, CAST(CASE WHEN (SELECT gain FROM b) <= 1e-7 THEN 0 WHEN CASE WHEN (SELECT feature FROM b) = 'sum_qty' THEN sum_qty > [50, 100, 150][(SELECT bin FROM b) + 1] ELSE n_lines > [2, 4][(SELECT bin FROM b) + 1] END THEN 2 ELSE 1 END AS INTEGER) AS node FROM joined""")
def tree_level_one(spark: SparkSession, sf: str) -> DataFrame:
    j = fx.joined(spark, sf).select("id", (0.5 - F.col("y")).alias("g"), F.lit(0.25).alias("h"), *_TREE)
    tree = trees.build(j, _TREE, _TREE_EDGES, TreeParams(max_depth=1))
    return j.select("id", trees.node_of(tree).alias("node"))


def _boost(spark: SparkSession, sf: str, **params) -> DataFrame:
    j = fx.joined(spark, sf)
    model = trees.BoostedTrees(fx.FEATURES, "y", "id", n_trees=2, params=TreeParams(max_depth=3, reg_gamma=0.0, **params)).fit(j)
    return model.predict(j).select("id", "y", F.round("prediction", 6).alias("prediction"))


@query()
def boost_leaf_wise(spark: SparkSession, sf: str) -> DataFrame:
    return _boost(spark, sf, leaf_wise=True, max_leaves=5, goss=(0.3, 0.3), colsample=0.8)


@query()
def boost_importances(spark: SparkSession, sf: str) -> DataFrame:
    j = fx.joined(spark, sf)
    model = trees.BoostedTrees(fx.FEATURES, "y", "id", n_trees=2, params=TreeParams(max_depth=2, reg_gamma=0.0)).fit(j)
    return model.importances(spark, "gain").withColumn("importance", F.round("importance", 6))


@query(f"""WITH {fx.SCORED}, r AS (SELECT id, round(p - y, 6) AS g, row_number() OVER (ORDER BY abs(round(p - y, 6)) DESC, id) AS rn, count(*) OVER () AS n FROM scored),
  t AS (SELECT *, row_number() OVER (ORDER BY substr(md5(concat(CAST(id AS VARCHAR), '-3')), 1, 15), id) AS hn FROM r WHERE rn > CAST(floor(n * 0.2) AS BIGINT))
  SELECT id, round(g, 6) AS g FROM r WHERE rn <= CAST(floor(n * 0.2) AS BIGINT) UNION ALL SELECT id, round(g * (1 - 0.2) / 0.1, 6) FROM t WHERE hn <= CAST(floor(n * 0.1) AS BIGINT)""")
def goss_sample(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.scored(spark, sf).select("id", F.round(F.col("p") - F.col("y"), 6).alias("g"), F.lit(0.25).alias("h"))
    return trees.goss(s, "id", 0.2, 0.1, seed=3).select("id", F.round("g", 6).alias("g"))


# --- linear models ---


def _regression(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1000).alias("y"), F.lit(1.0).alias("x0"), (F.col("p_size") / 50).alias("x1"))


def _steps_sql(source: str, residue: str, steps: int, rate: float, lam: float) -> str:
    out = "w0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b)"
    for k in range(steps):
        r = residue.format(s="(any_w.a * x0 + any_w.b * x1)")
        out += f", w{k + 1} AS (SELECT any_value(any_w.a) - {rate} * (-avg(({r}) * x0) + {lam} * any_value(any_w.a)) AS a, any_value(any_w.b) - {rate} * (-avg(({r}) * x1) + {lam} * any_value(any_w.b)) AS b FROM data, w{k} any_w)"
    return f"WITH {source}, {out} SELECT round(a, 6) AS w0, round(b, 6) AS w1 FROM w{steps}"


def _weights(spark: SparkSession, model: linear.LinearModel) -> DataFrame:
    return spark.createDataFrame([tuple(round(w, 6) for w in model.weights)], "w0 double, w1 double")


@query(_steps_sql("data AS (SELECT p_retailprice / 1000 AS y, 1.0::DOUBLE AS x0, p_size / 50 AS x1 FROM part)", "y - {s}", 3, 0.2, 0.01))
def linreg_steps(spark: SparkSession, sf: str) -> DataFrame:
    model = linear.LinearModel(["x0", "x1"], "y", epochs=3, learning_rate=0.2, penalty="l2", reg_lambda=0.01)
    return _weights(spark, model.fit(_regression(spark, sf)))


@query(_steps_sql(f"{fx.JOINED}, data AS (SELECT y, 1.0::DOUBLE AS x0, sum_qty / 100 AS x1 FROM joined)", "y - 1 / (1 + exp(-{s}))", 3, 0.5, 0.0))
def logreg_steps(spark: SparkSession, sf: str) -> DataFrame:
    data = fx.joined(spark, sf).select("id", "y", F.lit(1.0).alias("x0"), (F.col("sum_qty") / 100).alias("x1"))
    return _weights(spark, linear.LinearModel(["x0", "x1"], "y", logistic=True, epochs=3, learning_rate=0.5).fit(data))


def _batches_sql(parts: int, rate: float, lam: float) -> str:
    """One epoch of batches in the order of a hash of the ids."""
    out = [fx.JOINED, "data AS (SELECT id, y, 1.0::DOUBLE AS x0, sum_qty / 100 AS x1, row_number() OVER (ORDER BY substr(md5(concat(CAST(id AS VARCHAR), '-0')), 1, 15), id) - 1 AS rn, count(*) OVER () AS n FROM joined)", "w0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS b)"]
    for k in range(parts):
        rest = "(y - 1 / (1 + exp(-(w.a * x0 + w.b * x1))))"
        out.append(f"w{k + 1} AS (SELECT any_value(w.a) - {rate} * (-avg({rest} * x0) + {lam} * sign(any_value(w.a))) AS a, any_value(w.b) - {rate} * (-avg({rest} * x1) + {lam} * sign(any_value(w.b))) AS b FROM data, w{k} w WHERE rn // greatest(1, n // {parts} + 1) = {k})")
    p = "1 / (1 + exp(-(w.a * x0 + w.b * x1)))"
    return f"WITH {', '.join(out)} SELECT id, round({p}, 6) AS probability, CAST({p} > 0.5 AS INTEGER) AS prediction FROM data, w{parts} w"


@query(_batches_sql(3, 0.1, 0.001))
def logreg_batches(spark: SparkSession, sf: str) -> DataFrame:
    data = fx.joined(spark, sf).select("id", "y", F.lit(1.0).alias("x0"), (F.col("sum_qty") / 100).alias("x1"))
    model = linear.LinearModel(["x0", "x1"], "y", logistic=True, epochs=1, batch_size=max(1, data.count() // 3 + 1), penalty="l1", reg_lambda=0.001).fit(data, validate=data)
    return model.predict(data).select("id", F.round("probability", 6).alias("probability"), "prediction")


@query(f"WITH {fx.JOINED} SELECT id, round(600 - 20 * ln(50) / ln(2) + 20 / ln(2) * 0.3) + round_even(sum_qty * 0.01 * (20 / ln(2)), 0) + round_even(n_lines * -0.2 * (20 / ln(2)), 0) AS points FROM joined")
def score_card(spark: SparkSession, sf: str) -> DataFrame:
    return linear.score_card(fx.joined(spark, sf), ["sum_qty", "n_lines"], [0.01, -0.2], 0.3).select("id", "points")


@query(f"WITH {fx.JOINED} SELECT id, round(0.5 * n_lines - 0.01 * sum_qty, 6) AS prediction FROM joined")
def linear_inference(spark: SparkSession, sf: str) -> DataFrame:
    model = linear.LinearModel(["n_lines", "sum_qty"], "y", weights=[0.5, -0.01])
    return model.predict(fx.joined(spark, sf)).select("id", F.round("prediction", 6).alias("prediction"))


# --- clusters ---

_SEEDS = "seeds AS (SELECT label AS c, i, avg(vec[i]) AS m FROM vectors, range(1, 65) r(i) GROUP BY 1, 2), centres AS (SELECT c, list(m ORDER BY i) AS m FROM seeds GROUP BY 1)"
_NEAR = f"near AS (SELECT vec_id, arg_min(c, (round({_D2.format(a='vec', b='m')}, 9), c)) AS cluster, min({_D2.format(a='vec', b='m')}) AS d2 FROM vectors, centres GROUP BY 1)"


def _seeds(spark: SparkSession, sf: str) -> list[list[float]]:
    v = fx.vectors(spark, sf)
    return kmeans.to_lists(kmeans.centroids(v, "vec", "label"), v.agg(F.max("label")).first()[0] + 1)


@query(f"WITH {fx.VECTORS}, {_SEEDS} SELECT c AS cluster, CAST(i - 1 AS INTEGER) AS dim, round(m, 6) AS mean FROM seeds")
def kmeans_seeded_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans.centroids(fx.vectors(spark, sf), "vec", "label").withColumn("mean", F.round("mean", 6))


@query(f"WITH {fx.VECTORS}, {_SEEDS}, {_NEAR} SELECT vec_id, cluster, round(d2, 6) AS d2 FROM near")
def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans.assign(fx.vectors(spark, sf), "vec", _seeds(spark, sf)).select("vec_id", "cluster", F.round("d2", 6).alias("d2"))


@query(f"WITH {fx.VECTORS}, {_SEEDS}, {_NEAR} SELECT cluster, CAST(i - 1 AS INTEGER) AS dim, round(avg(vec[i]), 6) AS mean FROM vectors JOIN near USING (vec_id), range(1, 65) r(i) GROUP BY 1, 2")
def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    near = kmeans.assign(fx.vectors(spark, sf), "vec", _seeds(spark, sf))
    return kmeans.centroids(near, "vec", "cluster").withColumn("mean", F.round("mean", 6))


@query(f"WITH {fx.VECTORS}, {_SEEDS} SELECT vec_id, list(round(sqrt({_D2.format(a='vec', b='m')}), 6) ORDER BY c) AS distances FROM vectors, centres GROUP BY 1")
def kmeans_transform(spark: SparkSession, sf: str) -> DataFrame:
    out = kmeans.transform(fx.vectors(spark, sf), "vec", _seeds(spark, sf))
    return out.select("vec_id", F.transform("distances", lambda d: F.round(d, 6)).alias("distances"))


@query(f"WITH {fx.VECTORS}, {_SEEDS}, {_NEAR}, j AS (SELECT vec, d2, m FROM vectors JOIN near USING (vec_id) JOIN centres ON c = cluster) SELECT round(sum(d2), 4) AS sse, round(sum(sqrt({_D2.format(a='vec[1:32]', b='m[1:32]')}) + sqrt({_D2.format(a='vec[33:64]', b='m[33:64]')})), 4) AS inertia_parts FROM j")
def kmeans_inertia(spark: SparkSession, sf: str) -> DataFrame:
    out = kmeans.inertia_by_parts(fx.vectors(spark, sf), "vec", 32, _seeds(spark, sf))
    return out.select(F.round("sse", 4).alias("sse"), F.round("inertia_parts", 4).alias("inertia_parts"))


def _constrained_sql(iterations: int) -> str:
    """Centres from the labelled half, then rounds of assigning the others and averaging, unrolled."""
    mean = "(SELECT {c} AS c, i, avg(vec[i]) AS x FROM {t}, range(1, 65) r(i) {where} GROUP BY 1, 2)"
    near = "{n} AS (SELECT vec_id, any_value(vec) AS vec, CASE WHEN any_value(seed) >= 0 THEN any_value(seed) ELSE arg_min(c, (round(" + _D2.format(a="vec", b="m") + ", 9), c)) END AS cluster FROM v, {m} GROUP BY 1)"
    out = [fx.VECTORS, "v AS (SELECT vec_id, vec, CASE WHEN substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) < '8' THEN label ELSE -1 END AS seed FROM vectors)"]
    out.append(f"m0 AS (SELECT c, list(x ORDER BY i) AS m FROM {mean.format(c='seed', t='v', where='WHERE seed >= 0')} GROUP BY 1)")
    for k in range(iterations):
        out.append(near.format(n=f"n{k}", m=f"m{k}"))
        out.append(f"m{k + 1} AS (SELECT c, list(x ORDER BY i) AS m FROM {mean.format(c='cluster', t=f'n{k}', where='')} GROUP BY 1)")
    out.append(f"p AS (SELECT vec_id, arg_min(c, (round({_D2.format(a='vec', b='m')}, 9), c)) AS cluster FROM vectors, m{iterations} GROUP BY 1)")
    return f"WITH {', '.join(out)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM p"


@query(_constrained_sql(3))
def kmeans_constrained(spark: SparkSession, sf: str) -> DataFrame:
    """A hashed half of the labels seeds and holds its clusters; the other half is free."""
    v = fx.vectors(spark, sf).withColumn("seed", F.when(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1) < "8", F.col("label")).otherwise(-1))
    model = kmeans.SeededKMeans(10, "vec_id", "vec", "seed", constrained=True, max_iter=3).fit(v)
    return model.predict(v).select("vec_id", "cluster")


@query()
def kmeans_restarts(spark: SparkSession, sf: str) -> DataFrame:
    """The best of four restarts of twelve clusters, of which labels seed ten."""
    v = fx.vectors(spark, sf).withColumn("seed", F.when(F.pmod(F.xxhash64("vec_id"), F.lit(2)) == 0, F.col("label")).otherwise(-1))
    return kmeans.SeededKMeans(12, "vec_id", "vec", "seed", n_init=4, max_iter=4).fit(v).predict(v).select("vec_id", "cluster", F.round("d2", 6).alias("d2"))


@query(f"WITH {fx.VECTORS} SELECT label AS cluster, CAST(i - 1 AS INTEGER) AS dim, round(avg(vec[i]), 6) AS mean FROM vectors, range(1, 65) r(i) GROUP BY 1, 2")
def kmeans_labelled_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans.centroids(fx.vectors(spark, sf), "vec", "label").withColumn("mean", F.round("mean", 6))


# --- federated and split learning ---

_PARAMS = "params AS (SELECT client_id, CAST(count(*) AS BIGINT) AS n, 'layer' || CAST(day % 4 AS VARCHAR) AS name, CAST(0 AS INTEGER) AS idx, round(avg(value), 6) AS value FROM clients GROUP BY 1, 3)"


def _params(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.clients(spark, sf)
    return c.groupBy("client_id", F.concat(F.lit("layer"), (F.col("day") % 4).cast("string")).alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value")).withColumn("idx", F.lit(0))


@query(f"WITH {fx.CLIENTS}, {_PARAMS} SELECT name, idx, round(sum(value * n) / sum(n), 6) AS value FROM params GROUP BY 1, 2")
def fedavg_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return federated.fedavg(_params(spark, sf)).withColumn("value", F.round("value", 6))


@query(f"WITH {fx.CLIENTS}, {_PARAMS} SELECT name, idx, round(avg(value), 8) AS value FROM params GROUP BY 1, 2")
def fedavg_mean(spark: SparkSession, sf: str) -> DataFrame:
    return federated.fedavg(_params(spark, sf), weighted=False).withColumn("value", F.round("value", 8))


@query(f"WITH {fx.CLIENTS}, {_PARAMS}, a AS (SELECT name, idx, sum(value * n) / sum(n) AS shared FROM params GROUP BY 1, 2) SELECT client_id, name, idx, round(CASE WHEN name > 'layer2' THEN value ELSE shared END, 6) AS value FROM params JOIN a USING (name, idx)")
def fed_personalized(spark: SparkSession, sf: str) -> DataFrame:
    p = _params(spark, sf)
    return federated.personalize(p, federated.fedavg(p), 0.25).select("client_id", "name", "idx", F.round("value", 6).alias("value"))


_FED = f"{fx.CLIENTS}, data AS (SELECT client_id, value / 100 AS y, 1.0::DOUBLE AS x0, day / 31 AS x1 FROM clients)"


def _fed(spark: SparkSession, sf: str, **options) -> DataFrame:
    data = fx.clients(spark, sf).select("client_id", (F.col("value") / 100).alias("y"), F.lit(1.0).alias("x0"), (F.col("day") / 31).alias("x1"))
    w = federated.train(data, ["x0", "x1"], "y", **options)
    return spark.createDataFrame([tuple(round(x, 6) for x in w)], "w0 double, w1 double")


@query(f"""WITH {_FED}, g1 AS (SELECT client_id, count(*) AS n, 0.2 * avg(y * x0) AS a, 0.2 * avg(y * x1) AS b FROM data GROUP BY 1), s1 AS (SELECT sum(n * a) / sum(n) AS a, sum(n * b) / sum(n) AS b FROM g1),
  g2 AS (SELECT client_id, count(*) AS n, any_value(s1.a) + 0.2 * avg((y - s1.a * x0 - s1.b * x1) * x0) AS a, any_value(s1.b) + 0.2 * avg((y - s1.a * x0 - s1.b * x1) * x1) AS b FROM data, s1 GROUP BY 1)
  SELECT round(sum(n * a) / sum(n), 6) AS w0, round(sum(n * b) / sum(n), 6) AS w1 FROM g2""")
def fedavg_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return _fed(spark, sf, rounds=2, rate=0.2)


def _local_sql(method: str, rounds: int = 2, steps: int = 2, rate: float = 0.2, mu: float = 0.1) -> str:
    """Rounds of local steps, unrolled: s the shared weights, w those of the clients, k and q the controls of
    the clients and of the server."""
    out = [_FED, "s0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS b)", "k0 AS (SELECT DISTINCT client_id, 0::DOUBLE AS c, 0::DOUBLE AS d FROM data)", "q0 AS (SELECT 0::DOUBLE AS c, 0::DOUBLE AS d)"]
    for r in range(rounds):
        out.append(f"w{r}_0 AS (SELECT k.client_id, s.a, s.b FROM k{r} k, s{r} s)")
        for t in range(steps):
            out.append(f"g{r}_{t} AS (SELECT client_id, any_value(w.a) AS a, any_value(w.b) AS b, count(*) AS n, -avg((y - w.a * x0 - w.b * x1) * x0) AS g, -avg((y - w.a * x0 - w.b * x1) * x1) AS h FROM data JOIN w{r}_{t} w USING (client_id) GROUP BY 1)")
            more = {
                "fedprox": lambda v: f"CASE WHEN g.a = s.a AND g.b = s.b THEN 0 ELSE {mu} * (g.{v} - s.{v}) / (2 * sqrt((g.a - s.a) * (g.a - s.a) + (g.b - s.b) * (g.b - s.b))) END",
                "scaffold": lambda v: f"q.{'c' if v == 'a' else 'd'} - k.{'c' if v == 'a' else 'd'}",
            }[method]
            out.append(f"w{r}_{t + 1} AS (SELECT client_id, n, g.a - {rate} * (g.g + {more('a')}) AS a, g.b - {rate} * (g.h + {more('b')}) AS b FROM g{r}_{t} g JOIN k{r} k USING (client_id), s{r} s, q{r} q)")
        w = f"w{r}_{steps}"
        out.append(f"s{r + 1} AS (SELECT sum(n * a) / sum(n) AS a, sum(n * b) / sum(n) AS b FROM {w})")
        out.append(f"k{r + 1} AS (SELECT client_id, k.c - q.c + (s.a - w.a) / {steps * rate} AS c, k.d - q.d + (s.b - w.b) / {steps * rate} AS d FROM {w} w JOIN k{r} k USING (client_id), s{r} s, q{r} q)")
        out.append(f"q{r + 1} AS (SELECT any_value(q.c) + avg(n.c - o.c) AS c, any_value(q.d) + avg(n.d - o.d) AS d FROM k{r + 1} n JOIN k{r} o USING (client_id), q{r} q)")
    return f"WITH {', '.join(out)} SELECT round(a, 6) AS w0, round(b, 6) AS w1 FROM s{rounds}"


@query(_local_sql("fedprox"))
def fedprox_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return _fed(spark, sf, rounds=2, local_steps=2, rate=0.2, method="fedprox", mu=0.1)


@query(_local_sql("scaffold"))
def scaffold_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return _fed(spark, sf, rounds=2, local_steps=2, rate=0.2, method="scaffold")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount / greatest(1, sqrt(l_discount * l_discount + l_tax * l_tax) / 0.05), 6) AS d, round(l_tax / greatest(1, sqrt(l_discount * l_discount + l_tax * l_tax) / 0.05), 6) AS t FROM lineitem")
def gradient_clip(spark: SparkSession, sf: str) -> DataFrame:
    d, t = federated.clip([F.col("l_discount"), F.col("l_tax")], 0.05)
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(d, 6).alias("d"), F.round(t, 6).alias("t"))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, round(1 / n / sum(1 / n) OVER () * count(*) OVER (), 6) AS weight FROM c")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return neural.class_weights(fx.table(spark, sf, "embeddings"), "label").withColumn("weight", F.round("weight", 6))


@query(f"WITH {fx.VECTORS} SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(vec, lambda x: x * x)))), 6) AS mean_norm FROM vectors GROUP BY 1")
def embedding_norms(spark: SparkSession, sf: str) -> DataFrame:
    return neural.norms_by_label(fx.vectors(spark, sf), "vec", "label").withColumn("mean_norm", F.round("mean_norm", 6))


@query(f"WITH {fx.VECTORS}, {_SEEDS}, q AS (SELECT vec_id, label, list(-round(sqrt({_D2.format(a='vec', b='m')}), 6) ORDER BY c) AS s FROM vectors, centres GROUP BY 1, 2), r AS (SELECT label, (SELECT count(*) FROM range(1, 11) t(i) WHERE s[i] > s[label + 1] OR (s[i] = s[label + 1] AND i < label + 1)) AS above FROM q) SELECT label, count(*) AS n, CAST(sum(CAST(above < 3 AS INTEGER)) AS BIGINT) AS hits FROM r GROUP BY 1")
def topk_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Is a vector's class among the three whose centroids are nearest?"""
    v = kmeans.transform(fx.vectors(spark, sf), "vec", _seeds(spark, sf))
    return neural.top_k_accuracy(v.select("label", F.transform("distances", lambda d: -F.round(d, 6)).alias("scores")), "scores", "label", 3)


@query(f"WITH {fx.VECTORS}, t AS (SELECT *, list_sort(list_transform(vec, lambda x: abs(x)), 'DESC')[16] AS least FROM vectors) SELECT vec_id, list_transform(vec, lambda x: CASE WHEN abs(x) >= least THEN round(x, 6) ELSE 0 END) AS vec FROM t")
def prune_topk(spark: SparkSession, sf: str) -> DataFrame:
    return fx.vectors(spark, sf).select("vec_id", F.transform(neural.prune(F.col("vec"), 0.75), lambda x: F.round(x, 6)).alias("vec"))


@query(f"WITH {fx.VECTORS} SELECT vec_id, list_transform(vec, lambda x: round(round_even(greatest(least(x, 0.2), -0.2) / 0.05, 0) * 0.05, 6) + 0.0) AS vec FROM vectors")
def quantize_gradient(spark: SparkSession, sf: str) -> DataFrame:
    return fx.vectors(spark, sf).select("vec_id", F.transform("vec", lambda x: F.round(neural.quantize(x, 8, 0.2), 6) + 0.0).alias("vec"))


_DCOR = f"""WITH {fx.VECTORS}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, {_D2.format(a='a.vec[1:32]', b='b.vec[1:32]')} AS x, {_D2.format(a='a.vec[33:64]', b='b.vec[33:64]')} AS y FROM vectors a, vectors b),
  c AS (SELECT x - avg(x) OVER (PARTITION BY i) - avg(x) OVER (PARTITION BY j) + avg(x) OVER () AS a, y - avg(y) OVER (PARTITION BY i) - avg(y) OVER (PARTITION BY j) + avg(y) OVER () AS b FROM d)
  SELECT round(sqrt(avg(a * b) / sqrt(avg(a * a) * avg(b * b))), 6) AS dcor FROM c"""


@query(_DCOR)
def distance_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Of both parties' halves of all vectors, a column for each dimension."""
    v = fx.vectors(spark, sf).select(*[F.col("vec")[k].alias(f"v{k}") for k in range(64)])
    return neural.distance_correlation(v, [f"v{k}" for k in range(32)], [f"v{k}" for k in range(32, 64)]).select(F.round("dcor", 6).alias("dcor"))


@query(_DCOR)
def distance_correlation_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a column of vectors."""
    return neural.distance_correlation_vectors(fx.vectors(spark, sf), "vec", 32).select(F.round("dcor", 6).alias("dcor"))


@query()
def split_network(spark: SparkSession, sf: str) -> DataFrame:
    j = transform.scale(fx.joined(spark, sf), fx.FEATURES)
    model = neural.SplitNetwork([fx.FEATURES[:2], fx.FEATURES[2:]], "y", hidden=4, epochs=2).fit(j)
    return model.predict(j.select("id", "y", *fx.FEATURES)).select("id", F.round("probability", 6).alias("probability"))
