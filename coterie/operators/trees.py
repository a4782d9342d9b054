"""Histogram-based boosted trees over the columns of all parties.

Features are binned once. A level of a tree is one grouped sum of gradients and hessians by (node, feature,
bin); the best split per node is read off running sums over bins, and the few winning rows reach the
driver. Rows find their node by a nested CASE expression over the raw features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import losses
from ..functions.ordered import row_numbers
from ..shared import discard, stash
from . import metrics
from .select import hash_order
from .transform import all_tree_edges, bin_code


@dataclass
class Node:
    """g and h are sums over the node's rows; with several classes, lists of one sum for each."""

    node: int
    g: float | list[float]
    h: float | list[float]
    n: int
    depth: int = 0
    feature: str | None = None
    threshold: float | None = None
    gain: float | None = None
    left: Node | None = None
    right: Node | None = None


@dataclass(frozen=True)
class TreeParams:
    max_bin: int = 16
    max_depth: int = 4
    max_leaves: int = 31
    reg_lambda: float = 0.1
    reg_gamma: float = 0.1
    min_samples: int = 3
    min_gain: float = 1e-7
    rate: float = 0.3
    leaf_wise: bool = False
    subsample: float = 1.0
    goss: tuple[float, float] | None = None
    colsample: float = 1.0
    seed: int = 0
    #: Of several classes: squares of each bin's gradients are summed in place of squares of sums.
    square_bins: bool = False


def histogram(df: DataFrame, features: Sequence[str], node: str = "node") -> DataFrame:
    """(node, feature, bin, g, h, n) of a table with columns node, g, h and bin codes named as features."""
    long = df.select(node, "g", "h", *features).unpivot([node, "g", "h"], list(features), "feature", "bin")
    return long.groupBy(node, "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def cipher_histogram(df: DataFrame, features: Sequence[str], key, zeros: int = 32, packed: bool = True) -> DataFrame:
    """(feature, bin, g, h, n): the histogram that a party sums over encrypted gradients and hessians, which it
    can't read, as their owner decrypts it. packed: both travel in one cipher."""
    from ..functions import crypto

    quick = key.zeros(zeros, base=8)
    if packed:
        size = df.agg(F.count("*").alias("n"), F.max(F.greatest(F.abs("g"), F.abs("h"))).alias("top")).first()
        bits = crypto.packed_bits(size["n"], size["top"] or 1.0, key)
        sent = df.select(*features, crypto.encrypt_packed([F.col("g"), F.col("h")], key, quick, bits).alias("gh"))
        long = sent.unpivot(["gh"], list(features), "feature", "bin").withColumn("n", F.lit(1))
        sums = crypto.cipher_sum(long, ["feature", "bin"], "gh", key).withColumn("x", crypto.decrypt_packed(F.col("gh"), key, 2, bits))
        out = sums.select("feature", "bin", F.col("x")[0].alias("g"), F.col("x")[1].alias("h"))
    else:
        sent = df.select(*features, *[crypto.encrypt_column(F.col(c).cast("double"), key, quick).alias(c) for c in "gh"])
        long = sent.unpivot(["g", "h"], list(features), "feature", "bin")
        both = [crypto.cipher_sum(long, ["feature", "bin"], c, key) for c in "gh"]
        out = both[0].join(both[1], ["feature", "bin"]).select("feature", "bin", *[crypto.decrypt_column(F.col(c), key).alias(c) for c in "gh"])
    counts = df.select(*features).unpivot([], list(features), "feature", "bin").groupBy("feature", "bin").agg(F.count("*").alias("n"))
    return out.join(counts, ["feature", "bin"])


def class_histogram(df: DataFrame, features: Sequence[str], classes: int) -> DataFrame:
    """(feature, bin, class, g, h, n) of columns g0, h0, g1, h1, ...: one sum per class."""
    long = df.select(*[f"{x}{k}" for k in range(classes) for x in "gh"], *features).unpivot([f"{x}{k}" for k in range(classes) for x in "gh"], list(features), "feature", "bin")
    sums = long.groupBy("feature", "bin").agg(F.count("*").alias("n"), *[F.sum(f"{x}{k}").alias(f"{x}{k}") for k in range(classes) for x in "gh"])
    each = F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"g{k}").alias("g"), F.col(f"h{k}").alias("h")) for k in range(classes)])
    return sums.select("feature", "bin", "n", F.inline(each))


def class_split_gains(hist: DataFrame, lam: float = 0.1, gamma: float = 0.1) -> DataFrame:
    """(feature, bin, gain): structure scores are summed over the classes, gamma counts once."""
    upto, whole = W.partitionBy("feature", "class").orderBy("bin"), W.partitionBy("feature", "class")
    out = hist.select("feature", "bin", "class", *[F.sum(c).over(upto).alias(f"{c}l") for c in "gh"], *[F.sum(c).over(whole).alias(f"{c}t") for c in "gh"], F.max("bin").over(whole).alias("_last"))
    own = gain(F.col("gl"), F.col("hl"), F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl"), lam, 0.0)
    return out.where("bin < _last").groupBy("feature", "bin").agg((F.sum(own) - gamma).alias("gain"))


def class_columns(classes: int) -> list[str]:
    return [f"{x}{k}" for x in "gh" for k in range(classes)]


def vector_histogram(df: DataFrame, features: Sequence[str], classes: int, node: str = "node") -> DataFrame:
    """(node, feature, bin, g0, ..., h0, ..., n) of a table with columns node, g0, ..., h0, ... and bin codes named
    as features: one aggregate carries the gradients and hessians of all classes."""
    own = class_columns(classes)
    long = df.select(node, *own, *features).unpivot([node, *own], list(features), "feature", "bin")
    return long.groupBy(node, "feature", "bin").agg(*[F.sum(c).alias(c) for c in own], F.count("*").alias("n"))


def vector_split_gains(hist: DataFrame, classes: int, lam: float = 0.1, gamma: float = 0.1, square_bins: bool = False, node: str = "node") -> DataFrame:
    """(node, feature, bin, gain, gl, hl, nl, gt, ht, nt) of splitting after each bin but the last; gl, hl, gt
    and ht are arrays over the classes. A gain is the sum of the classes' structure gains less gamma. With
    square_bins a side's score is the sum of its bins' squared gradients over its hessian, unhalved."""
    upto, whole = W.partitionBy(node, "feature").orderBy("bin"), W.partitionBy(node, "feature")
    own = class_columns(classes)
    sums = [F.sum(c).over(w).alias(f"{c}{s}") for c in [*own, "n"] for s, w in (("l", upto), ("t", whole))]
    squares = [F.sum(F.col(f"g{k}") * F.col(f"g{k}")).over(w).alias(f"q{k}{s}") for k in range(classes) for s, w in (("l", upto), ("t", whole))] if square_bins else []
    out = hist.select(node, "feature", "bin", *sums, *squares, F.max("bin").over(whole).alias("_last")).where("bin < _last")

    def score(k: int, of) -> Column:
        if square_bins:
            return of("q", k) / (of("h", k) + lam)
        return 0.5 * of("g", k) * of("g", k) / (of("h", k) + lam)

    left, both = (lambda c, k: F.col(f"{c}{k}l")), (lambda c, k: F.col(f"{c}{k}t"))
    right = lambda c, k: both(c, k) - left(c, k)
    total = sum((score(k, left) + score(k, right) - score(k, both) for k in range(classes)), F.lit(0.0))
    arrays = [F.array(*[f"{c}{k}{s}" for k in range(classes)]).alias(f"{c}{s}") for c in "gh" for s in "lt"]
    return out.select(node, "feature", "bin", (0.5 * total - gamma).alias("gain"), *arrays, "nl", "nt")


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The sibling's histogram: the parent's minus the child's (both without a node column)."""
    joined = parent.join(child.select("feature", "bin", *[F.col(c).alias(f"_{c}") for c in ("g", "h", "n")]), ["feature", "bin"], "left")
    return joined.select("feature", "bin", *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("g", "h", "n")])


def gain(gl: Column, hl: Column, gr: Column, hr: Column, lam: float, gamma: float) -> Column:
    part = lambda g, h: 0.5 * g * g / (h + lam)
    return 0.5 * (part(gl, hl) + part(gr, hr) - part(gl + gr, hl + hr)) - gamma


def split_gains(hist: DataFrame, lam: float = 0.1, gamma: float = 0.1, node: str = "node") -> DataFrame:
    """(node, feature, bin, gain, gl, hl, nl, gt, ht, nt) of splitting after each bin but the last."""
    upto = W.partitionBy(node, "feature").orderBy("bin")
    whole = W.partitionBy(node, "feature")
    out = hist.select(node, "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in ("g", "h", "n")], *[F.sum(c).over(whole).alias(f"{c}t") for c in ("g", "h", "n")], F.max("bin").over(whole).alias("_last"))
    out = out.where("bin < _last").drop("_last")
    return out.withColumn("gain", gain(F.col("gl"), F.col("hl"), F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl"), lam, gamma))


def best_splits(hist: DataFrame, lam: float = 0.1, gamma: float = 0.1, node: str = "node") -> DataFrame:
    """The split of greatest gain per node; the first by feature and bin among equal ones."""
    return _best(split_gains(hist, lam, gamma, node), node)


def _best(gains: DataFrame, node: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(node).orderBy(F.col("gain").desc(), "feature", "bin"))
    return gains.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def best_vector_splits(hist: DataFrame, classes: int, lam: float = 0.1, gamma: float = 0.1, square_bins: bool = False, node: str = "node") -> DataFrame:
    return _best(vector_split_gains(hist, classes, lam, gamma, square_bins, node), node)


def leaf_weight(g: Column | float | list[float], h: Column | float | list[float], lam: float = 0.1) -> Column | float | list[float]:
    """A weight, or with lists one for each class."""
    if isinstance(g, list):
        return [-a / (b + lam) for a, b in zip(g, h, strict=True)]
    return -g / (h + lam)


def goss(df: DataFrame, id_col: str, top: float, other: float, seed: int = 0, classes: int = 0) -> DataFrame:
    """The share `top` of rows with the largest |g| (with several classes, the sum of their |g|), and of the
    rest a random share `other` of all rows whose g and h are raised by (1 - top) / other."""
    n = df.count()
    a, b = int(n * top), int(n * other)
    own = class_columns(classes) if classes else ["g", "h"]
    size = sum((F.abs(c) for c in own[: classes or 1]), F.lit(0.0))
    ranked = row_numbers(df.withColumn("_a", size), "_a", [id_col], "_rn", descending=True).drop("_a")
    first, rest = ranked.where(F.col("_rn") <= a).drop("_rn"), ranked.where(F.col("_rn") > a).drop("_rn")
    rest = row_numbers(rest.withColumn("_h", hash_order(id_col, seed=seed)), "_h", [id_col], "_rn").where(F.col("_rn") <= b).drop("_rn", "_h")
    up = (1 - top) / other if other else 1.0
    return first.unionByName(rest.withColumns({c: F.col(c) * up for c in own}))


def sample_rows(df: DataFrame, id_col: str, share: float, seed: int = 0) -> DataFrame:
    """An exact share of the rows, without replacement, by a hash of the id."""
    k = int(df.count() * share)
    return row_numbers(df.withColumn("_h", hash_order(id_col, seed=seed)), "_h", [id_col], "_rn").where(F.col("_rn") <= k).drop("_rn", "_h")


def value_of(tree: Node, lam: float) -> Column:
    """The tree as one expression over raw features; x > threshold goes right. With several classes, its
    values are arrays."""
    if tree.feature is None:
        w = leaf_weight(tree.g, tree.h, lam)
        return F.array(*[F.lit(float(x)) for x in w]) if isinstance(w, list) else F.lit(float(w))
    return F.when(F.col(tree.feature) > F.lit(tree.threshold), value_of(tree.right, lam)).otherwise(value_of(tree.left, lam))


def node_of(tree: Node) -> Column:
    if tree.feature is None:
        return F.lit(tree.node)
    return F.when(F.col(tree.feature) > F.lit(tree.threshold), node_of(tree.right)).otherwise(node_of(tree.left))


def _split(node: Node, row, edges: dict[str, list[float]]) -> None:
    node.feature, node.threshold, node.gain = row["feature"], edges[row["feature"]][row["bin"]], row["gain"]
    node.left = Node(2 * node.node + 1, row["gl"], row["hl"], row["nl"], node.depth + 1)
    node.right = Node(2 * node.node + 2, _rest(row["gt"], row["gl"]), _rest(row["ht"], row["hl"]), row["nt"] - row["nl"], node.depth + 1)


def _rest(whole: float | list[float], part: float | list[float]) -> float | list[float]:
    return [a - b for a, b in zip(whole, part, strict=True)] if isinstance(whole, list) else whole - part


def build(df: DataFrame, features: Sequence[str], edges: dict[str, list[float]], p: TreeParams, classes: int = 0) -> Node:
    """One tree from a table with raw features and g and h, or with several classes g0, ... and h0, ... A null
    feature goes with the lowest bin, as it does in value_of."""
    own = class_columns(classes) if classes else ["g", "h"]
    coded = df.select(*own, *features, *[F.coalesce(bin_code(F.col(c), edges[c]), F.lit(0)).alias(f"b_{c}") for c in features])
    total = df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in own], F.count("*").alias("n")).first()
    both = ([total[c] for c in own[:classes]], [total[c] for c in own[classes:]]) if classes else (total["g"], total["h"])
    root = Node(0, *both, total["n"])

    def splits(nodes: list[Node]) -> dict:
        at = coded.withColumn("node", node_of(root)).where(F.col("node").isin([x.node for x in nodes]))
        at = at.select("node", *own, *[F.col(f"b_{c}").alias(c) for c in features])
        if classes:
            found = best_vector_splits(vector_histogram(at, features, classes), classes, p.reg_lambda, p.reg_gamma, p.square_bins)
        else:
            found = best_splits(histogram(at, features), p.reg_lambda, p.reg_gamma)
        return {r["node"]: r for r in found.collect()}  # a row per node

    good = lambda x, found: x.node in found and found[x.node]["gain"] > p.min_gain
    can = lambda x: x.depth < p.max_depth and x.n >= p.min_samples
    if p.leaf_wise:
        heap: list = []

        def push(nodes: list[Node]) -> None:
            nodes = [x for x in nodes if can(x)]
            found = splits(nodes) if nodes else {}
            for x in nodes:
                if good(x, found):
                    heappush(heap, (-found[x.node]["gain"], x.node, x, found[x.node]))

        push([root])
        leaves = 1
        while heap and leaves < p.max_leaves:
            _, _, x, row = heappop(heap)
            _split(x, row, edges)
            leaves += 1
            push([x.left, x.right])
        return root
    level = [root]
    while level := [x for x in level if can(x)]:
        found = splits(level)
        level = [x for x in level if good(x, found)]
        for x in level:
            _split(x, found[x.node], edges)
        level = [y for x in level for y in (x.left, x.right)]
    return root


@dataclass
class BoostedTrees:
    """Boosting for binary labels (cross entropy), several classes 0, 1, ... (multi: cross entropy of a softmax
    over one raw score per class, each tree a vector of weights in its leaves) and regression (squared error)."""

    features: Sequence[str]
    label: str
    id_col: str
    task: str = "binary"
    n_trees: int = 5
    params: TreeParams = field(default_factory=TreeParams)
    trees: list[Node] = field(default_factory=list)
    edges: dict[str, list[float]] = field(default_factory=dict)
    classes: int = 0

    def _scores(self, start: Column, trees: list[Node]) -> Column:
        out = start
        for t in trees:
            value = value_of(t, self.params.reg_lambda)
            if self.classes:
                out = F.zip_with(out, value, lambda s, v: s + F.lit(self.params.rate) * v)
            else:
                out = out + F.lit(self.params.rate) * value
        return out

    def raw(self) -> Column:
        """The sum of the trees: a number, or with several classes an array."""
        return self._scores(F.array(*[F.lit(0.0)] * self.classes) if self.classes else F.lit(0.0), self.trees)

    def prediction(self) -> Column:
        """The probability of class 1, the number that regression gives, or the likeliest class (the first of
        equally likely ones)."""
        if self.task == "multi":
            return (F.array_position(self.raw(), F.array_max(self.raw())) - 1).cast("int")
        return losses.sigmoid(self.raw()) if self.task == "binary" else self.raw()

    def fit(self, df: DataFrame) -> BoostedTrees:
        """Every round writes the raw score with the rows, so plans do not grow with the number of trees. The
        rows are written before the first pass, so that what they come from runs once."""
        rows = stash(df.select(*dict.fromkeys([self.id_col, self.label, *self.features])), "rows")
        self.edges = {c: e[:-1] for c, e in all_tree_edges(rows, self.features, self.params.max_bin).items()}
        self.trees = []
        self.resume(rows)
        discard(rows)
        return self

    def _gradients(self) -> dict[str, Column]:
        y, s = F.col("_y"), F.col("_s")
        if self.task == "multi":
            _, g, h = losses.multi_cross_entropy(y, [s[k] for k in range(self.classes)])
            return dict(zip(class_columns(self.classes), [*g, *h], strict=True))
        _, g, h = losses.cross_entropy(y, losses.sigmoid(s)) if self.task == "binary" else losses.squared(y, s)
        return {"g": g, "h": h}

    def resume(self, df: DataFrame) -> BoostedTrees:
        """Goes on from the trees that are there (a saved model's, with its edges) up to n_trees."""
        if len(self.trees) < self.n_trees and vars(df).get("_stashed") is None:
            own = stash(df.select(*dict.fromkeys([self.id_col, self.label, *self.features])), "rows")
            self.resume(own)
            discard(own)
            return self
        if self.task == "multi" and not self.classes:
            self.classes = int(df.agg(F.max(self.label)).first()[0]) + 1
        rows = df.select(self.id_col, F.col(self.label).cast("double").alias("_y"), *self.features)
        rows = rows.withColumn("_s", self.raw())
        for k in range(len(self.trees), self.n_trees):
            p = replace(self.params, seed=self.params.seed + k)
            data = rows.withColumns(self._gradients())
            if p.goss:
                data = stash(goss(data, self.id_col, *p.goss, seed=p.seed, classes=self.classes), "sample")
            elif p.subsample < 1:
                data = stash(sample_rows(data, self.id_col, p.subsample, p.seed), "sample")
            own = list(self.features)
            if p.colsample < 1:
                import random

                own = sorted(random.Random(p.seed).sample(own, max(1, int(len(own) * p.colsample))), key=self.features.index)
            tree = build(data, own, self.edges, p, self.classes)
            self.trees.append(tree)
            before, rows = rows, stash(rows.withColumn("_s", self._scores(F.col("_s"), [tree])), "boost")
            discard(before, data)
        discard(rows)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds prediction, and with several classes the array of their probabilities."""
        if self.task != "multi":
            return df.withColumn("prediction", self.prediction())
        out = df.withColumn("_s", self.raw())
        p = losses.softmax([F.col("_s")[k] for k in range(self.classes)])
        likeliest = F.array_position("_s", F.array_max("_s")) - 1
        return out.withColumns({"prediction": likeliest.cast("int"), "probabilities": F.array(*p)}).drop("_s")

    def score(self, df: DataFrame) -> DataFrame:
        """One row of metrics of the predictions, by the task."""
        out = self.predict(df)
        if self.task == "binary":
            return metrics.binary_metrics(out, self.label, "prediction")
        if self.task == "multi":
            return metrics.multiclass_metrics(out, self.label, "prediction")
        return metrics.regression_metrics(out, self.label, "prediction")

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows: one per node. With several classes, cover is the sum of their hessians, and
        covers and weights hold one number for each."""
        rows = []

        def walk(tree: int, x: Node) -> None:
            w = leaf_weight(x.g, x.h, self.params.reg_lambda)
            own = (float(sum(x.h)), int(x.n), [float(v) for v in x.h], [float(v) for v in w]) if self.classes else (float(x.h), int(x.n), float(w))
            rows.append((tree, x.node, x.depth, x.feature, x.threshold, x.gain, *own))
            if x.feature is not None:
                walk(tree, x.left)
                walk(tree, x.right)

        for k, t in enumerate(self.trees):
            walk(k, t)
        weight = "covers array<double>, weights array<double>" if self.classes else "weight double"
        return spark.createDataFrame(rows, f"tree int, node int, depth int, feature string, threshold double, gain double, cover double, n long, {weight}")

    def importances(self, spark: SparkSession, kind: str = "split") -> DataFrame:
        """(feature, importance): number of splits, mean gain or mean cover."""
        value = {"split": F.count("*").cast("double"), "gain": F.avg("gain"), "cover": F.avg("cover")}[kind]
        return self.table(spark).where("feature is not null").groupBy("feature").agg(value.alias("importance"))

    def text(self) -> str:
        def lines(x: Node, pad: str) -> list[str]:
            if x.feature is None:
                w = leaf_weight(x.g, x.h, self.params.reg_lambda)
                return [f"{pad}leaf {', '.join(f'{v:.6g}' for v in (w if isinstance(w, list) else [w]))} (n={x.n})"]
            return [f"{pad}{x.feature} <= {x.threshold:.6g} (gain {x.gain:.6g})", *lines(x.left, pad + "  "), f"{pad}else", *lines(x.right, pad + "  ")]

        return "\n".join(f"tree {k}\n" + "\n".join(lines(t, "  ")) for k, t in enumerate(self.trees))
