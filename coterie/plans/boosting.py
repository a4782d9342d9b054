"""Queries on boosted trees of several classes, between parties, and on what features contribute to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, private_trees, shap, trees
from ..operators.trees import TreeParams
from . import fixtures as fx
from .exchange import _key
from .modelling import _TREE, _TREE_EDGES, _boost
from .tabular import query

# --- rounds of boosting in SQL ---

#: Bin codes of the trees' features over fixed edges, a row for each id and feature.
_CODES = "codes AS (SELECT id, 'sum_qty' AS feature, CAST(sum_qty > 50 AS INTEGER) + CAST(sum_qty > 100 AS INTEGER) + CAST(sum_qty > 150 AS INTEGER) AS bin FROM joined UNION ALL SELECT id, 'n_lines', CAST(n_lines > 2 AS INTEGER) + CAST(n_lines > 4 AS INTEGER) FROM joined)"


def rounds_sql(classes: int, rounds: int, depth: int, gamma: float, gradients: str, rate: float = 0.3, lam: float = 0.1, codes: str = _CODES) -> list[str]:
    """Level-wise boosting, unrolled: from s0 (id, y, s: the list of raw scores) to the scores s{rounds}. A node's
    children are numbered twice its number plus 1 and 2. gradients: of a row (y, c, s), as "... AS g, ... AS h"."""
    out = [codes]
    for r in range(rounds):
        out.append(f"gh{r} AS (SELECT id, c, {gradients} FROM s{r}, range({classes}) k(c))")
        out.append(f"n{r}_0 AS (SELECT id, 0 AS node FROM s{r})")
        for d in range(depth):
            out.append(f"hist{r}_{d} AS (SELECT node, feature, bin, c, sum(g) AS g, sum(h) AS h, count(*) AS n FROM n{r}_{d} JOIN codes USING (id) JOIN gh{r} USING (id) WHERE node >= {2**d - 1} GROUP BY ALL)")
            out.append(
                f"cum{r}_{d} AS (SELECT node, feature, bin, c, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER f AS gt, sum(h) OVER f AS ht, sum(n) OVER f AS nt, max(bin) OVER f AS last FROM hist{r}_{d}"
                " WINDOW w AS (PARTITION BY node, feature, c ORDER BY bin), f AS (PARTITION BY node, feature, c))"
            )
            part = lambda g, h: f"0.5 * ({g}) * ({g}) / ({h} + {lam})"
            out.append(f"gain{r}_{d} AS (SELECT node, feature, bin, any_value(nt) AS n, 0.5 * sum({part('gl', 'hl')} + {part('gt - gl', 'ht - hl')} - {part('gt', 'ht')}) - {gamma} AS gain FROM cum{r}_{d} WHERE bin < last GROUP BY 1, 2, 3)")
            out.append(f"best{r}_{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) AS rn FROM gain{r}_{d}) WHERE rn = 1 AND gain > 1e-7 AND n >= 3)")
            out.append(f"n{r}_{d + 1} AS (SELECT n.id, CASE WHEN b.node IS NULL THEN n.node ELSE 2 * n.node + 1 + CAST(x.bin > b.bin AS INTEGER) END AS node FROM n{r}_{d} n LEFT JOIN best{r}_{d} b ON n.node = b.node LEFT JOIN codes x ON x.id = n.id AND x.feature = b.feature)")
        out.append(f"leaf{r} AS (SELECT node, c, -sum(g) / (sum(h) + {lam}) AS w FROM n{r}_{depth} JOIN gh{r} USING (id) GROUP BY 1, 2)")
        out.append(f"s{r + 1} AS (SELECT s.id, any_value(s.y) AS y, list(s.s[l.c + 1] + {rate} * l.w ORDER BY l.c) AS s FROM s{r} s JOIN n{r}_{depth} n ON n.id = s.id JOIN leaf{r} l ON l.node = n.node GROUP BY 1)")
    return out


_SOFTMAX = "exp(s[c + 1]) / list_sum(list_transform(s, lambda x: exp(x)))"
_MULTI = ", ".join([fx.JOINED, "s0 AS (SELECT id, CAST(priority - 1 AS INTEGER) % 3 AS y, [0::DOUBLE, 0::DOUBLE, 0::DOUBLE] AS s FROM joined)", *rounds_sql(3, 2, 2, 0.0, f"{_SOFTMAX} - CAST(y = c AS INTEGER) AS g, {_SOFTMAX} * (1 - {_SOFTMAX}) AS h")])


def _three(spark: SparkSession, sf: str) -> DataFrame:
    return fx.joined(spark, sf).withColumn("y", (F.col("priority") - 1).cast("int") % 3)


def _multi_model(df: DataFrame, **params) -> trees.BoostedTrees:
    return trees.BoostedTrees(_TREE, "y", "id", "multi", n_trees=2, params=TreeParams(max_depth=2, reg_gamma=0.0, **params), edges=_TREE_EDGES, classes=3).resume(df)


@query(f"WITH {_MULTI}, p AS (SELECT id, list_transform(s, lambda x: exp(x)) AS e FROM s2) SELECT id, round(e[1] / list_sum(e), 6) AS p0, round(e[2] / list_sum(e), 6) AS p1, round(e[3] / list_sum(e), 6) AS p2 FROM p")
def boost_multi_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds for three classes: each tree has a vector of weights in its leaves."""
    df = _three(spark, sf)
    out = _multi_model(df).predict(df)
    return out.select("id", *[F.round(F.col("probabilities")[k], 6).alias(f"p{k}") for k in range(3)])


@query(f"WITH {_MULTI}, q AS (SELECT y, list_position(s, list_max(s)) - 1 AS q FROM s2), k AS (SELECT DISTINCT y AS c FROM q UNION SELECT DISTINCT q FROM q), s AS (SELECT k.c, count(*) FILTER (y = k.c) AS t, count(*) FILTER (q = k.c) AS n, count(*) FILTER (y = k.c AND q = k.c) AS h FROM q, k GROUP BY 1) SELECT round(sum(h) / sum(t), 6) AS acc, round(sum(t * coalesce(2 * h / nullif(t + n, 0), 0)) / sum(t), 6) AS weighted_f1 FROM s")
def boost_multi_score(spark: SparkSession, sf: str) -> DataFrame:
    df = _three(spark, sf)
    return _multi_model(df).score(df).select(F.round("acc", 6).alias("acc"), F.round("weighted_f1", 6).alias("weighted_f1"))


@query()
def boost_multi_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """Best-first growth on a sample by the size of gradients, every feature binned on its own."""
    df = _three(spark, sf)
    params = TreeParams(max_depth=4, max_leaves=6, leaf_wise=True, goss=(0.3, 0.3), reg_gamma=0.0)
    model = trees.BoostedTrees(fx.FEATURES, "y", "id", "multi", n_trees=2, params=params).fit(df)
    return model.predict(df).select("id", "prediction", F.transform("probabilities", lambda p: F.round(p, 6)).alias("probabilities"))


_BINARY = ", ".join([fx.JOINED, "s0 AS (SELECT id, y, [0::DOUBLE] AS s FROM joined)", *rounds_sql(1, 2, 2, 0.0, "1 / (1 + exp(-s[1])) - y AS g, 1 / (1 + exp(-s[1])) * (1 - 1 / (1 + exp(-s[1]))) AS h")])


def _binary_model(df: DataFrame, depth: int = 2, rounds: int = 2) -> trees.BoostedTrees:
    return trees.BoostedTrees(_TREE, "y", "id", n_trees=rounds, params=TreeParams(max_depth=depth, reg_gamma=0.0), edges=_TREE_EDGES).resume(df)


@query(f"WITH {_BINARY} SELECT id, round(1 / (1 + exp(-s[1])), 6) AS prediction FROM s2")
def boost_fixed_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of binary boosting over given bin edges."""
    df = fx.joined(spark, sf)
    return _binary_model(df).predict(df).select("id", F.round("prediction", 6).alias("prediction"))


#: Bin codes of all features over ends at the places floor((k + 1) * n / 16) of each sorted column, the last left out.
_SORTED_CODES = """ends AS (SELECT DISTINCT feature, value FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS rn, count(*) OVER (PARTITION BY feature) AS n FROM long) WHERE list_contains(list_transform(range(1, 17), lambda k: greatest(1, n * k // 16)), rn)),
  inner_ends AS (SELECT feature, value FROM ends QUALIFY value < max(value) OVER (PARTITION BY feature)),
  codes AS (SELECT l.id, l.feature, CAST(count(e.value) AS INTEGER) AS bin FROM long l LEFT JOIN inner_ends e ON e.feature = l.feature AND e.value < l.value GROUP BY 1, 2)"""
_TWO_ROUNDS = ", ".join([fx.JOINED, fx.LONG, "s0 AS (SELECT id, y, [0::DOUBLE] AS s FROM joined)", *rounds_sql(1, 2, 3, 0.0, "1 / (1 + exp(-s[1])) - y AS g, 1 / (1 + exp(-s[1])) * (1 - 1 / (1 + exp(-s[1]))) AS h", codes=_SORTED_CODES)])


@query(f"WITH {_TWO_ROUNDS} SELECT id, y, round(1 / (1 + exp(-s[1])), 6) AS prediction FROM s2")
def boost_two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds over all features, with bin ends found in the data."""
    return _boost(spark, sf)


# --- between parties ---

_PRIVATE_CODES = _CODES[:-1] + " UNION ALL SELECT id, 'priority', CAST(priority > 2 AS INTEGER) + CAST(priority > 3 AS INTEGER) FROM joined)"
_PRIVATE = ", ".join([fx.JOINED, "s0 AS (SELECT id, y, [0::DOUBLE] AS s FROM joined)", *rounds_sql(1, 1, 2, 0.0, "0.5 - y AS g, 0.25 AS h", codes=_PRIVATE_CODES)])


def _private_model(spark: SparkSession, sf: str, depth: int) -> tuple[private_trees.PrivateBoostedTrees, DataFrame, dict[str, DataFrame]]:
    """Orders and priorities at the party with labels; quantities and line counts at one other each."""
    active, lines = fx.active(spark, sf).select("id", "y", "priority"), fx.passive(spark, sf)
    others = {c: lines.select("id", c) for c in _TREE}
    parties = [private_trees.PassiveParty(c, [c], {c: _TREE_EDGES[c]}) for c in _TREE]
    model = private_trees.PrivateBoostedTrees(["priority"], "y", "id", parties, _key(), n_trees=1, params=TreeParams(max_depth=depth, reg_gamma=0.0), edges={"priority": [2.0, 3.0]})
    return model.fit(active, others), private_trees.matched(active, lines.select("id"), "id", "left_semi"), others


@query(f"WITH {_PRIVATE} SELECT id, round(1 / (1 + exp(-s[1])), 6) AS prediction FROM s1")
def private_boost(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of two levels over three parties: encrypted histograms, and splits that only their owner knows."""
    model, active, others = _private_model(spark, sf, 2)
    return model.predict(active, others).select("id", F.round("prediction", 6).alias("prediction"))


@query(f"WITH {_PRIVATE}, f AS (SELECT feature FROM best0_0) SELECT CASE WHEN node = 0 THEN 'split' ELSE 'leaf' END AS kind, CASE WHEN node = 0 THEN (SELECT nullif(feature, 'priority') FROM f) END AS party, count(*) AS n FROM (SELECT 0 AS node UNION ALL SELECT DISTINCT node FROM n0_1) GROUP BY 1, 2")
def private_boost_table(spark: SparkSession, sf: str) -> DataFrame:
    """What the party with labels keeps of a tree of one level: owners and records, no thresholds of others."""
    model, _, _ = _private_model(spark, sf, 1)
    t = model.table(spark)
    return t.groupBy(F.when(F.col("weight").isNull(), "split").otherwise("leaf").alias("kind"), "party").agg(F.count("*").alias("n"))


# --- contributions ---

#: A tree of one feature gives that feature its whole value less the mean; one of depth 1 is such a tree.
_STUMP = ", ".join([fx.JOINED, "s0 AS (SELECT id, y, [0::DOUBLE] AS s FROM joined)", *rounds_sql(1, 1, 1, 0.0, "0.5 - y AS g, 0.25 AS h")])


@query(f"WITH {_STUMP}, b AS (SELECT avg(s[1]) AS base FROM s1), f AS (SELECT coalesce((SELECT feature FROM best0_0), '') AS feature) SELECT id, round(base, 6) AS base, round(CASE WHEN feature = 'sum_qty' THEN s[1] - base ELSE 0 END, 6) + 0.0 AS sum_qty, round(CASE WHEN feature = 'n_lines' THEN s[1] - base ELSE 0 END, 6) + 0.0 AS n_lines FROM s1, b, f")
def shap_of_a_stump(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.joined(spark, sf)
    rows = shap.contributions(_binary_model(df, 1, 1), df, ["id"])
    return rows.select("id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("base", *_TREE)])


@query(f"WITH {_BINARY} SELECT id, round(s[1], 6) AS raw FROM s2")
def shap_sums_to_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Base and contributions of all features add up to the raw score of each row."""
    df = fx.joined(spark, sf)
    rows = shap.contributions(_binary_model(df), df, ["id"])
    return rows.select("id", F.round(sum((F.col(c) for c in _TREE), F.col("base")), 6).alias("raw"))


@query()
def shap_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All features by their mean absolute contribution."""
    ranked = evaluate.importance_ranking(evaluate.tree_importance(fx.joined(spark, sf), fx.FEATURES, "y", way="shap", trees=3))
    return ranked.withColumn("importance", F.round("importance", 6))
