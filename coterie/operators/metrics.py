"""Evaluation of scores (columns y and p) as aggregates; curves come as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ordered import quantiles, running


def ks_table(df: DataFrame, y: str = "y", p: str = "p", points: int = 50) -> DataFrame:
    """(k, threshold, tpr, fpr, ks) at `points` even thresholds on [0, 1]; predicted is p > threshold. Rows
    are counted by the number of thresholds below them, then summed over at most points + 1 rows."""
    grid = [k / (points - 1) for k in range(points)]
    below = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t < F.col(p)))
    counts = df.groupBy(below.alias("b")).agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) != 1, 1)).alias("neg"))
    at = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    sums = at.groupBy("k").agg(*[F.sum(F.when(F.col("b") > F.col("k"), F.col(c)).otherwise(0)).alias(f"{c}_above") for c in ("pos", "neg")], F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    tpr, fpr = F.try_divide(F.col("pos_above"), F.col("pos")), F.try_divide(F.col("neg_above"), F.col("neg"))
    return sums.select("k", (F.col("k") / F.lit(points - 1)).alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), F.abs(fpr - tpr).alias("ks"))


def ks_value(df: DataFrame, y: str = "y", p: str = "p", points: int = 50) -> DataFrame:
    """(ks, threshold): the first greatest; both -1 if there is one class only."""
    best = ks_table(df, y, p, points).agg(F.max(F.struct("ks", -F.col("k"))).alias("b"))
    return best.select(F.coalesce("b.ks", F.lit(-1.0)).alias("ks"), F.when(F.col("b.ks").isNull(), -1.0).otherwise(-F.col("b.col2") / F.lit(points - 1)).alias("threshold"))


def score_counts(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(p, pos, neg) per distinct score."""
    return df.groupBy(F.col(p).alias("p")).agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) != 1, 1)).alias("neg"))


def auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(auc, gini): the rank sum with average ranks, over distinct scores."""
    upto = running(score_counts(df, y, p), "p", [], {"negs": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("negs") - F.col("neg") / 2))
    out = upto.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))
    return out.select("auc", ((F.col("auc") - 0.5) / 0.5).alias("gini"))


def roc_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score, predicted being p >= threshold."""
    counts = score_counts(df, y, p)
    n = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    upto = running(counts, "p", [], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    return upto.select(F.col("p").alias("threshold"), F.try_divide("tp", F.lit(n["pos"])).alias("tpr"), F.try_divide("fp", F.lit(n["neg"])).alias("fpr"))


def pr_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, precision, recall) at each distinct score."""
    counts = score_counts(df, y, p)
    n = counts.agg(F.sum("pos").alias("pos")).first()
    upto = running(counts, "p", [], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    return upto.select(F.col("p").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", F.lit(n["pos"])).alias("recall"))


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """(acc, precision, recall, f1, weighted_f1, log_loss)."""
    hit = F.col(p) > threshold
    c = lambda cond: F.count(F.when(cond, 1))
    safe = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    n = df.agg(c((F.col(y) == 1) & hit).alias("tp"), c((F.col(y) != 1) & hit).alias("fp"), c((F.col(y) == 1) & ~hit).alias("fn"), c((F.col(y) != 1) & ~hit).alias("tn"), F.avg(-F.when(F.col(y) == 1, F.log(safe)).otherwise(F.log(1 - safe))).alias("log_loss"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1 = lambda a, b, d: F.coalesce(F.try_divide(2 * a, 2 * a + b + d), F.lit(0.0))
    total = tp + fp + fn + tn
    weighted = (f1(tp, fp, fn) * (tp + fn) + f1(tn, fn, fp) * (tn + fp)) / total
    return n.select(((tp + tn) / total).alias("acc"), F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"), f1(tp, fp, fn).alias("f1"), weighted.alias("weighted_f1"), "log_loss")


def multiclass_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """(acc, weighted_f1) of class predictions."""
    each = df.select(F.explode(F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("q"), (F.col(y) == F.col(pred)).cast("int").alias("h")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("q"), F.lit(0).alias("h")))).alias("e")).select("e.*")
    by = each.groupBy("c").agg(F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum("h").alias("h"))
    return by.agg((F.sum("h") / F.sum("t")).alias("acc"), (F.sum(F.col("t") * F.coalesce(F.try_divide(2 * F.col("h"), F.col("t") + F.col("q")), F.lit(0.0))) / F.sum("t")).alias("weighted_f1"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """(mae, mse, sse, r2)."""
    d = F.col(y) - F.col(p)
    n = df.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sum(d * d).alias("sse"), F.var_pop(y).alias("v"), F.count("*").alias("n"))
    return n.select("mae", "mse", "sse", (1 - F.try_divide(F.col("sse"), F.col("v") * F.col("n"))).alias("r2"))


def lift_curve(df: DataFrame, id_col: str, y: str = "y", p: str = "p") -> DataFrame:
    """(id, x, lift): rows by falling score, ties by id; the share of positives so far over that of all."""
    total = df.agg(F.count("*").alias("n"), F.sum(y).alias("pos")).first()
    upto = running(df.select(F.col(id_col).alias("id"), y, p), p, ["id"], {"k": F.lit(1), "c": F.col(y)}, descending=True)
    return upto.select("id", (F.col("k") / F.lit(total["n"])).alias("x"), (F.col("c") / F.col("k") / F.lit(total["pos"] / total["n"])).alias("lift"))


def lorenz_curve(df: DataFrame, id_col: str, y: str = "y", p: str = "p") -> DataFrame:
    """(id, p, share): rows by label, ties by id; the share of the label's sum so far against the score."""
    total = df.agg(F.sum(y).alias("s")).first()["s"]
    upto = running(df.select(F.col(id_col).alias("id"), F.col(y).cast("double").alias("y"), F.col(p).alias("p")), "y", ["id"], {"c": F.col("y")})
    return upto.select("id", "p", (F.col("c") / F.lit(float(total))).alias("share"))


def score_histogram(df: DataFrame, p: str = "p", bins: int = 10) -> DataFrame:
    return df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, p: str = "p") -> DataFrame:
    ends = df.agg(F.min(p).alias("low"), F.max(p).alias("high"))
    q = ends.join(F.broadcast(quantiles(df, [p], [0.25, 0.5, 0.75])), F.lit(True), "left")  # one row each
    return q.select("low", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "high")


def bimodal(df: DataFrame, y: str = "y", p: str = "p", points: int = 50) -> DataFrame:
    """(k, x, density): the sum of the two classes' normal densities at even points."""
    s = df.groupBy(y).agg(F.avg(p).alias("m"), F.stddev_pop(p).alias("s"), F.count("*").alias("n")).where("s > 0")
    grid = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("k") / F.lit(points - 1))
    z = (F.col("x") - F.col("m")) / F.col("s")
    return grid.groupBy("k", "x").agg(F.sum(F.exp(-z * z / 2) / (F.col("s") * F.sqrt(2 * F.pi()))).alias("density"))


def silhouette(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """(cluster, silhouette): mean silhouette on squared Euclidean distances per cluster. Sums over a
    cluster follow from its count, sum vector and sum of squares, so no pairs of rows are made."""
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    sq = F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda s, v: s + v)
    rows = df.select(F.col(cluster).alias("c"), x.alias("x"), sq.alias("sq"))
    means = rows.select("c", F.posexplode("x").alias("i", "v")).groupBy("c", "i").agg(F.avg("v").alias("m")).groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    stats = rows.groupBy("c").agg(F.count("*").alias("n"), F.avg("sq").alias("msq")).join(means, "c").agg(F.collect_list(F.struct("c", "n", "msq", "m")).alias("all"))
    both = rows.crossJoin(F.broadcast(stats))  # one row: a few numbers per cluster
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    each = F.transform("all", lambda k: F.struct(k["c"].alias("c"), k["n"].alias("n"), (F.col("sq") + k["msq"] - 2 * dot(F.col("x"), k["m"])).alias("d")))
    both = both.withColumn("each", each)
    own = F.filter("each", lambda k: k["c"] == F.col("c"))[0]
    a = own["d"] * own["n"] / F.greatest(own["n"] - 1, F.lit(1))
    b = F.array_min(F.transform(F.filter("each", lambda k: k["c"] != F.col("c")), lambda k: k["d"]))
    s = F.when(own["n"] <= 1, 0.0).otherwise((b - a) / F.greatest(a, b))
    return both.groupBy(F.col("c").alias("cluster")).agg(F.avg(s).alias("silhouette"))


def class_accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(label, n, accuracy) per class."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"))


def attack_success(df: DataFrame, label: str, pred: str, target: int) -> DataFrame:
    """(n, rate): of the rows of other classes, how many the attacked model gives the target class."""
    return df.where(F.col(label) != target).agg(F.count("*").alias("n"), F.avg((F.col(pred) == target).cast("double")).alias("rate"))


def confident_top_k(df: DataFrame, scores: str, label: str, per_class: int) -> DataFrame:
    """(label, n, accuracy) over the rows of each predicted class with the greatest score, per_class of each:
    a bounded list per class, merged from partial lists."""
    best = F.array_max(scores)
    rows = df.select((F.array_position(scores, best) - 1).cast("int").alias("pred"), best.alias("score"), F.col(label).alias("label"), "id")
    rank = F.row_number().over(W.partitionBy("pred").orderBy(F.col("score").desc(), "id"))  # Spark keeps per_class rows a task
    return rows.withColumn("_rn", rank).where(F.col("_rn") <= per_class).groupBy(F.col("pred").alias("label")).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


def residuals(df: DataFrame, id_col: str, y: str, p: str) -> DataFrame:
    """(id, residual): the series behind a residual plot."""
    return df.select(id_col, (F.col(y) - F.col(p)).alias("residual"))
