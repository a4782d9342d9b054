"""Supervised and unsupervised evaluation of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import merging
from ..functions.ordered import numbered, quantiles
from .transform import bin_code, width_edges

EMPTY = 1e-7


def long_form(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keep..., feature, value)."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(list(keep), list(features), "feature", "value")


def _coded(edges: dict[str, list[float]], code) -> Column:
    out = F.lit(None).cast("int")
    for c, e in edges.items():
        out = F.when(F.col("feature") == c, code(F.col("value"), e)).otherwise(out)
    return out


def woe(df: DataFrame, features: Sequence[str], label: str, n_bins: int = 3, edges: dict[str, list[float]] | None = None) -> DataFrame:
    """(feature, bin, pos, neg, woe, iv): weight of evidence per bin and its share of the information
    value. With p and q the bin's shares of positives and negatives, woe = ln(p / q), both raised by
    EMPTY if either is 0. One shuffle of (features x bins) sums."""
    edges = edges or width_edges(df, features, n_bins)
    long = long_form(df, [label], features).withColumn("bin", _coded(edges, bin_code))
    sums = long.groupBy("feature", "bin").agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    whole = W.partitionBy("feature")
    p, q = F.col("pos") / F.sum("pos").over(whole), F.col("neg") / F.sum("neg").over(whole)
    either = (F.col("pos") == 0) | (F.col("neg") == 0)
    out = sums.withColumn("_p", p).withColumn("_q", q)
    ratio = F.when(either, F.log((F.col("_p") + EMPTY) / (F.col("_q") + EMPTY))).otherwise(F.log(F.col("_p") / F.when(either, 1.0).otherwise(F.col("_q"))))
    out = out.withColumn("woe", ratio).withColumn("iv", (F.col("_p") - F.col("_q")) * F.col("woe"))
    return out.select("feature", "bin", "pos", "neg", "woe", "iv")


def information_value(df: DataFrame, features: Sequence[str], label: str, n_bins: int = 3) -> DataFrame:
    return woe(df, features, label, n_bins).groupBy("feature").agg(F.sum("iv").alias("iv"))


def woe_encode(df: DataFrame, fitted: dict[str, list[tuple[float | None, float]]]) -> DataFrame:
    """Replaces features by the weight of their bin. fitted: per feature, (right edge, woe) of its bins in
    order, the last edge None."""
    out = {}
    for c, bins in fitted.items():
        value = F.lit(bins[-1][1])
        for edge, w in reversed(bins[:-1]):
            value = F.when(F.col(c) <= F.lit(edge), F.lit(w)).otherwise(value)
        out[c] = value
    return df.withColumns(out)


def fit_woe(df: DataFrame, features: Sequence[str], label: str, n_bins: int = 3) -> dict[str, list[tuple[float | None, float]]]:
    edges = width_edges(df, features, n_bins)
    found = {(r["feature"], r["bin"]): r["woe"] for r in woe(df, features, label, n_bins, edges).collect()}
    return {c: [(e, found.get((c, k), 0.0)) for k, e in enumerate([*edges[c], None])] for c in features}


def crosstab(df: DataFrame, value: str, label: str) -> DataFrame:
    """(value, n0, n1) of a 0/1 label."""
    return df.groupBy(F.col(value).alias("value")).agg(F.count(F.when(F.col(label) == 0, 1)).alias("n0"), F.count(F.when(F.col(label) == 1, 1)).alias("n1"))


def chi_square(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Of a 2 x 2 table; cells that are expected to be 0 are left out."""
    n = a0 + a1 + b0 + b1
    out = F.lit(0.0)
    for own, row, col in ((a0, a0 + a1, a0 + b0), (a1, a0 + a1, a1 + b1), (b0, b0 + b1, a0 + b0), (b1, b0 + b1, a1 + b1)):
        e = row * col / n
        out = out + F.when(e > 0, (own - e) * (own - e) / F.when(e > 0, e).otherwise(1.0)).otherwise(0.0)
    return out


def chi_adjacent(df: DataFrame, value: str, label: str) -> DataFrame:
    """(value, chi): chi-square of each value's counts against those of the next lower value."""
    table = numbered(crosstab(df, value, label), [F.col("value")], "place")
    lower = table.select((F.col("place") + 1).alias("place"), F.col("n0").alias("p0"), F.col("n1").alias("p1"))
    return table.join(lower, "place").select("value", chi_square(F.col("p0"), F.col("p1"), F.col("n0"), F.col("n1")).alias("chi"))


def class_crosstab(df: DataFrame, features: Sequence[str], label: str, classes: Sequence) -> DataFrame:
    """(feature, value, counts): rows of each class for each distinct value, nulls left out."""
    long = long_form(df, [label], features).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    each = [F.count(F.when(F.col(label) == F.lit(c), 1)) for c in classes]
    return long.groupBy("feature", "value").agg(F.array(*each).alias("counts"))


def merged_groups(counts, max_group: int) -> list[int]:
    """Places of the first rows of the groups that are left after merging, again and again, the neighbours of
    least chi-square (the first of equal ones). counts: a row per value in order, a column per class."""
    return merging.greedy(counts, range(len(counts)), max_group)[0]


def _label_classes(df: DataFrame, label: str) -> list:
    return sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())  # a row per class


def chi_merge_all(df: DataFrame, features: Sequence[str], label: str, max_group: int = 5, block: int = merging.BLOCK) -> DataFrame:
    """(feature, grp, low): left edges of each feature's groups. Blocks of a feature's distinct values are merged by
    tasks of their own, until four blocks hold what is left."""
    table = class_crosstab(df, features, label, _label_classes(df, label))
    return merging.merged(table, max_group, block).withColumnRenamed("value", "low")


def chi_merge(df: DataFrame, value: str, label: str, max_group: int = 5) -> DataFrame:
    """(grp, low) of one column."""
    return chi_merge_all(df, [value], label, max_group).drop("feature")


def private_chi_merge(passive: DataFrame, active: DataFrame, id_col: str, features: Sequence[str], label: str, key, max_group: int = 5, zeros: int = 32, block: int = merging.BLOCK) -> DataFrame:
    """chi_merge_all() of a passive party's features by labels that it never sees: the active party sends each
    row's class as one cipher of 0s and a 1, the passive one multiplies the ciphers of each value and sends
    them under numbers of features and places of values, and the active one decrypts, merges and tells the
    places that are left. Values and names stay with the passive party."""
    from ..functions import crypto
    from ..functions.ordered import row_numbers
    from ..shared import stash

    classes = _label_classes(active, label)
    bits = crypto.packed_bits(active.count(), 1.0, key)
    y = [(F.col(label) == F.lit(c)).cast("double") for c in classes]
    sent = crypto.spread(active.where(F.col(label).isNotNull()).select(id_col, label)).select(id_col, crypto.encrypt_packed(y, key, key.zeros(zeros, base=8), bits).alias("c"))
    long = long_form(passive.join(sent, id_col), ["c"], features).where("value is not null")
    sums = stash(crypto.cipher_sum(long.select("feature", "value", "c"), ["feature", "value"], "c", key.public), "values")
    placed = None
    for i, c in enumerate(features):
        own = row_numbers(sums.where(F.col("feature") == c), "value", [], "place").select(F.lit(i).alias("number"), F.col("place").cast("long").alias("place"), "value", "c")
        placed = own if placed is None else placed.unionByName(own)
    placed = stash(placed, "places")

    counts = F.transform(crypto.decrypt_packed(F.col("c"), key, len(classes), bits), lambda x: F.round(x))
    told = placed.select(F.col("number").cast("string").alias("feature"), F.col("place").alias("value"), counts.alias("counts"))
    kept = merging.merged(told, max_group, block).select(F.col("feature").cast("int").alias("number"), "grp", F.col("value").cast("long").alias("place"))
    named = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("number") + 1)
    return kept.join(placed.select("number", "place", "value"), ["number", "place"]).select(named.alias("feature"), "grp", F.col("value").alias("low"))


def chi_bin(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Replaces each feature of groups (feature, grp, low) by the name of its group; nulls stay null."""
    lows: dict[str, list[float]] = {}
    for r in groups.orderBy("feature", "grp").collect():  # max_group rows per feature
        lows.setdefault(r["feature"], []).append(r["low"])
    return df.withColumns({c: F.when(F.col(c).isNotNull(), chi_groups(F.col(c), e)) for c, e in lows.items()})


def chi_groups(column: Column, lows: Sequence[float]) -> Column:
    """group1, group2, ...: left-closed by the groups' left edges; below the first is group1."""
    from functools import reduce
    from operator import add

    k = reduce(add, [(column >= F.lit(e)).cast("int") for e in lows])
    return F.concat(F.lit("group"), F.greatest(k, F.lit(1)).cast("string"))


def label_correlation(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in features])
    return row.unpivot([], list(features), "feature", "corr")


def correlation_matrix(df: DataFrame, features: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, corr) for all pairs, each over the rows that have both, and 0 where that is not defined.
    Spearman: Pearson on average ranks."""
    if method == "spearman":
        return rank_correlation(df, features)
    if method != "pearson":
        raise NotImplementedError(method)
    pairs = [(a, b) for a in features for b in features]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(str(i)) for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias("corr")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(entries))


def rank_correlation(df: DataFrame, features: Sequence[str], ranges: int = 64) -> DataFrame:
    """Spearman's correlation of all pairs, each over the rows that have both features.

    Which rows have both is told by which features a row has, its pattern. So values are counted by (feature,
    value, pattern); a pair's ranks within a feature are running sums over the counts of the patterns that
    hold the pair. Those run inside ranges of each feature (cut at quantiles), with the sums of earlier ranges
    added, for all features and pairs in one long table. Sums of rank products follow from a second pass."""
    from ..shared import stash

    features = list(features)
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    has = sum((F.when(F.col(f"x{i}").isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(len(features))), F.lit(0).cast("long"))
    rows = df.select(*x).select("*", has.alias("pattern"))
    marks = rows.approxQuantile([f"x{i}" for i in range(len(features))], [k / ranges for k in range(1, ranges)], 0.5 / ranges)
    part = F.lit(0)
    for i, m in enumerate(marks):
        cuts = sorted(set(m))
        below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("v"))) if cuts else F.lit(0)
        part = F.when(F.col("i") == i, below).otherwise(part)
    long = rows.select("pattern", F.posexplode(F.array(*[f"x{i}" for i in range(len(features))])).alias("i", "v")).where("v is not null")
    counts = long.groupBy("i", "v", "pattern").agg(F.count("*").alias("n"))
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    # a value's count for each pair that its feature is of
    mates = F.array(*[F.struct(F.lit(i).alias("own"), F.lit(p).alias("pair"), F.lit((1 << a) | (1 << b)).cast("long").alias("mask")) for p, (a, b) in enumerate(pairs) for i in {a, b}])
    by_pair = counts.select("*", F.inline(F.filter(mates, lambda m: (m["own"] == F.col("i")) & (F.col("pattern").bitwiseAND(m["mask"]) == m["mask"]))))
    by_value = stash(by_pair.groupBy("pair", "i", "v").agg(F.sum("n").alias("n")).withColumn("part", part), "ranks")
    sums = by_value.groupBy("pair", "i", "part").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("pair", "i").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = sums.select("pair", "i", "part", F.coalesce(earlier, F.lit(0)).alias("before"))
    upto = F.sum("n").over(W.partitionBy("pair", "i", "part").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = by_value.withColumn("upto", upto).join(F.broadcast(before), ["pair", "i", "part"])  # `ranges` rows for each pair and feature
    ranks = stash(ranked.select("pair", "i", "v", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank")), "ranks")
    # back to the rows: both values of a pair, counted together, then their ranks
    each = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"x{a}").alias("u"), F.col(f"x{b}").alias("w")) for p, (a, b) in enumerate(pairs)])
    both = rows.select(F.inline(each)).where("u is not null and w is not null").groupBy("pair", "a", "b", "u", "w").agg(F.count("*").alias("n"))
    side = lambda v, i, name: ranks.select(F.col("pair"), F.col("i").alias(i), F.col("v").alias(v), F.col("rank").alias(name))
    joined = both.join(side("u", "a", "r"), ["pair", "a", "u"]).join(side("w", "b", "s"), ["pair", "b", "w"])
    n, r, s = F.col("n"), F.col("r"), F.col("s")
    mean = {c: F.sum(n * F.col(c)) / F.sum(n) for c in "rs"}
    found = joined.groupBy("pair").agg(F.sum(n).alias("k"), mean["r"].alias("mr"), mean["s"].alias("ms"), F.sum(n * r * r).alias("rr"), F.sum(n * s * s).alias("ss"), F.sum(n * r * s).alias("rs"))
    k = F.col("k")
    above, below = F.col("rs") - k * F.col("mr") * F.col("ms"), (F.col("rr") - k * F.col("mr") * F.col("mr")) * (F.col("ss") - k * F.col("ms") * F.col("ms"))
    known = found.select("pair", F.when(below > 0, above / F.sqrt(below)).alias("c"))
    spark = df.sparkSession
    names = spark.createDataFrame([(p, *n) for p, (a, b) in enumerate(pairs) for n in {(features[a], features[b]), (features[b], features[a])}], "pair int, a string, b string")  # a row per pair
    return names.join(known, "pair", "left").select("a", "b", F.coalesce("c", F.lit(0.0)).alias("corr"))


def stability_index(base: DataFrame, test: DataFrame, feature: str) -> DataFrame:
    """(psi): population stability of test against base. Bins at the base's linear quantiles (as many as
    min(20, n / 10)), rounded to four places, open at both ends, and one bin for missing values; a share
    that is 0 against a positive one counts as 1 / n of its table."""
    n = base.agg(F.count(feature).alias("n")).first()["n"]
    k = min(20, n // 10)
    if k < 1:
        return base.sparkSession.createDataFrame([(None,)], "psi double")
    q = quantiles(base, [feature], [i / k for i in range(1, k)]).first()["q"] if k > 1 else []
    edges = sorted({round(x, 4) for x in q})
    bucket = F.when(F.col(feature).isNull(), -1).otherwise(bin_code(F.col(feature), edges) if edges else F.lit(0))
    side = lambda df, s: df.select(F.lit(s).alias("side"), F.col(feature).isNotNull().cast("int").alias("has"), bucket.alias("bin"))
    both = side(base, 0).union(side(test, 1)).groupBy("bin").agg(*[F.count(F.when(F.col("side") == s, 1)).alias(f"n{s}") for s in (0, 1)], *[F.sum(F.when(F.col("side") == s, F.col("has")).otherwise(0)).alias(f"h{s}") for s in (0, 1)])
    all_ = W.partitionBy(F.lit(0))  # one row per bin
    share = both.select(*[(F.col(f"n{s}") / F.sum(f"n{s}").over(all_)).alias(f"s{s}") for s in (0, 1)], *[F.sum(f"h{s}").over(all_).alias(f"m{s}") for s in (0, 1)])
    fixed = lambda s, o: F.when((F.col(f"s{s}") == 0) & (F.col(f"s{o}") > 0), 1.0 / F.col(f"m{s}")).otherwise(F.col(f"s{s}"))
    b, t = fixed(0, 1), fixed(1, 0)
    term = F.when((b == 0) & (t == 0), 0.0).otherwise((t - b) * F.log(t / F.when(b == 0, 1.0).otherwise(b)))
    return share.agg(F.sum(term).alias("psi"))


def tree_importance(df: DataFrame, features: Sequence[str], label: str, id_col: str = "id", task: str = "binary", way: str = "gain", trees: int = 10, params=None) -> DataFrame:
    """(feature, importance) of boosted trees fitted to the table, every feature included. way: split, gain or
    cover, as shares of their sum, or shap, the mean absolute contribution to a row's score."""
    from .shap import shap_importance
    from .trees import BoostedTrees, TreeParams

    model = BoostedTrees(list(features), label, id_col, task, trees, params or TreeParams(reg_gamma=0.0)).fit(df)
    if way == "shap":
        return shap_importance(model, df)
    found = {r["feature"]: r["importance"] for r in model.importances(df.sparkSession, way).collect()}  # a row per feature
    total = sum(found.values()) or 1.0
    return df.sparkSession.createDataFrame([(c, float(found.get(c, 0.0) / total)) for c in features], "feature string, importance double")


def importance_ranking(importances: DataFrame) -> DataFrame:
    return importances.withColumn("rank", F.row_number().over(W.orderBy(F.col("importance").desc(), "feature")))


def describe(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: count, mean, sample deviation, quartiles, extremes, distinct values, missing
    rate, range, and the share of the most frequent value."""
    long = long_form(df, [], features)
    top = long.where("value is not null").groupBy("feature", "value").count().groupBy("feature").agg(F.max("count").alias("top_n"))
    stats = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.countDistinct("value").alias("nunique"), F.count("*").alias("_n"),
    )
    quarters = quantiles(df, features, [0.25, 0.5, 0.75]).select(F.col("column").alias("feature"), F.col("q").alias("_q"))
    out = stats.join(top, "feature").join(F.broadcast(quarters), "feature")  # a row per feature
    return out.select(
        "feature", "count", "mean", "std", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max", "nunique",
        (1 - F.col("count") / F.col("_n")).alias("missing_rate"), (F.col("max") - F.col("min")).alias("range"), (F.col("top_n") / F.col("count")).alias("top_share"),
    )


def private_woe(passive: DataFrame, active: DataFrame, id_col: str, features: Sequence[str], label: str, key, n_bins: int = 3, zeros: int = 32) -> DataFrame:
    """woe() between two parties: the active one sends E(y) and E(1 - y) by id, the passive one sums them per
    (feature, bin) without seeing a label, and the active one decrypts a row per bin."""
    from ..functions import crypto

    quick = key.zeros(zeros, base=8)
    y = F.col(label).cast("double")
    bits = crypto.packed_bits(active.count(), 1.0, key)
    sent = active.select(id_col, crypto.encrypt_packed([y, 1 - y], key, quick, bits).alias("c"))
    edges = width_edges(passive, features, n_bins)
    long = long_form(passive.join(sent, id_col), ["c"], features).withColumn("bin", _coded(edges, bin_code))
    sums = crypto.cipher_sum(long.select("feature", "bin", "c"), ["feature", "bin"], "c", key)
    counts = sums.withColumn("n", crypto.decrypt_packed(F.col("c"), key, 2, bits))
    rows = counts.select("feature", "bin", F.round(F.col("n")[0]).cast("long").alias("pos"), F.round(F.col("n")[1]).cast("long").alias("neg"))
    whole = W.partitionBy("feature")
    shares = rows.withColumn("_p", F.col("pos") / F.sum("pos").over(whole)).withColumn("_q", F.col("neg") / F.sum("neg").over(whole))
    raised = F.when((F.col("pos") == 0) | (F.col("neg") == 0), F.lit(EMPTY)).otherwise(0.0)
    out = shares.withColumn("woe", F.log((F.col("_p") + raised) / (F.col("_q") + raised)))
    return out.select("feature", "bin", "pos", "neg", "woe", ((F.col("_p") - F.col("_q")) * F.col("woe")).alias("iv"))


def profile(df: DataFrame, features: Sequence[str], label: str, k: int = 3, importance: str | None = None, id_col: str = "id") -> DataFrame:
    """One row per feature: information value, its share of all, its rank, and the k most frequent values
    (the least of equally frequent ones first) with their shares of the column's rows. importance: adds a
    column of that name's tree importance (split, gain, cover or shap)."""
    iv = information_value(df, features, label)
    counts = long_form(df, [], features).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("rows"))
    # Spark keeps the first k of each task before the window, so a feature's values do not meet
    place = F.row_number().over(W.partitionBy("feature").orderBy(F.col("n").desc(), "value"))
    first = counts.withColumn("place", place).where(F.col("place") <= k).join(F.broadcast(totals), "feature")  # a row per feature
    tops = first.groupBy("feature").agg(*[F.max(F.when(F.col("place") == j, c)).alias(f"{n}{j}") for j in range(1, k + 1) for n, c in (("top", F.col("value")), ("share", F.col("n") / F.col("rows")))])
    all_ = W.partitionBy(F.lit(0))  # one row per feature
    ranked = iv.withColumn("iv_share", F.col("iv") / F.sum("iv").over(all_)).withColumn("iv_rank", F.row_number().over(W.orderBy(F.col("iv").desc(), "feature")))
    out = ranked.join(tops, "feature")
    if importance is None:
        return out
    return out.join(tree_importance(df, features, label, id_col, way=importance).withColumnRenamed("importance", importance), "feature")


def top_features(importances: DataFrame, k: int = 20) -> DataFrame:
    """The k features of greatest importance with their ranks: the table behind a bar chart."""
    return importance_ranking(importances).where(F.col("rank") <= k)


def fill_missing(df: DataFrame, features: Sequence[str], value: float = -1.0) -> DataFrame:
    """Nulls and NaNs as one value of their own."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(value)) for c in features})
