"""Boosted trees over tables of several parties, of which one holds the labels.

The active party sends each row's gradient and hessian as one cipher. A passive party bins its own features,
multiplies the ciphers of each (node, feature, bin), packs the bins of a feature into as few ciphers as the key
allows and sends those back under numbers in place of names. Of two siblings only the smaller one is summed;
the other is the parent's cipher times an inverse. The active party decrypts, compares the gains of all
parties and tells the winner (feature number, bin); the winner notes the feature and the threshold under a
record number and answers which rows go right. So the active party's tree holds record numbers for splits
of others, and a passive party's records hold nothing of the tree.

Parties are tables: each exchange is a join by id or by record, and what reaches the driver is a row per node.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto, losses
from ..shared import discard, stash
from .transform import all_tree_edges, bin_code
from .trees import TreeParams, histogram, leaf_weight, split_gains


@dataclass
class PassiveParty:
    """A party without labels: its features, their bin edges, and the splits that it noted: record number to
    (feature, threshold)."""

    name: str
    features: Sequence[str]
    edges: dict[str, list[float]] = field(default_factory=dict)
    records: list[tuple[str, float]] = field(default_factory=list)

    def coded(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id, f0, f1, ...): bin codes under numbers; a null goes with the lowest bin."""
        return df.select(id_col, *[F.coalesce(bin_code(F.col(c), self.edges[c]), F.lit(0)).alias(f"f{i}") for i, c in enumerate(self.features)])

    def note(self, number: str, bin_: int) -> int:
        feature = self.features[int(number[1:])]
        self.records.append((feature, self.edges[feature][bin_]))
        return len(self.records) - 1

    def goes_right(self, record: Column) -> Column:
        """Whether a row of the party's own table goes right at a record."""
        out = F.lit(False)
        for k, (feature, threshold) in enumerate(self.records):
            out = F.when(record == k, F.coalesce(F.col(feature) > F.lit(threshold), F.lit(False))).otherwise(out)
        return out

    def answers(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id, right): for each row, what it does at every record."""
        return df.select(id_col, F.array(*[F.coalesce(F.col(c) > F.lit(t), F.lit(False)) for c, t in self.records]).alias("right"))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *r) for k, r in enumerate(self.records)], "record int, feature string, threshold double")


@dataclass
class SharedNode:
    """What the active party knows of a node: feature and threshold of its own splits, party and record of
    those of others."""

    node: int
    n: int
    depth: int = 0
    party: str | None = None
    feature: str | None = None
    threshold: float | None = None
    record: int | None = None
    gain: float | None = None
    weight: float | None = None
    left: SharedNode | None = None
    right: SharedNode | None = None

    def walk(self):
        yield self
        for x in (self.left, self.right):
            if x is not None:
                yield from x.walk()


def matched(a: DataFrame, b: DataFrame, id_col: str, how: str = "inner") -> DataFrame:
    """A join by id of two tables of rows, which never passes one of them through the driver. Spark judges written
    tables by the size of their files, which hold ids in order and a few codes in some bytes a row: of millions of rows
    it would take one for small, gather it and broadcast it."""
    return a.join(b.hint("merge"), id_col, how)


def bin_sums(df: DataFrame, features: Sequence[str], key: crypto.Paillier) -> DataFrame:
    """(node, feature, bin, c, n) of columns node, c (ciphers) and bin codes: what a passive party sums."""
    long = df.select("node", "c", *features).unpivot(["node", "c"], list(features), "feature", "bin")
    counts = long.groupBy("node", "feature", "bin").agg(F.count("*").alias("n"))
    return crypto.cipher_sum(long, ["node", "feature", "bin"], "c", key).join(counts, ["node", "feature", "bin"])


def sibling_sums(parent: DataFrame, child: DataFrame, pairs: Sequence[tuple[int, int, int]], key: crypto.Paillier) -> DataFrame:
    """The sums of the other children. pairs: (parent, summed child, other child); a bin whose rows all went
    to the summed child has no sum."""
    spark = parent.sparkSession
    kin = spark.createDataFrame(list(pairs), "_parent int, _child int, _other int")  # a row per split node
    whole = parent.join(F.broadcast(kin), F.col("node") == F.col("_parent"))
    part = child.select(F.col("node").alias("_child"), "feature", "bin", F.col("c").alias("_c"), F.col("n").alias("_n"))
    both = whole.join(part, ["_child", "feature", "bin"], "left")
    rest = F.when(F.col("_c").isNull(), F.col("c")).otherwise(crypto.cipher_minus(F.col("c"), F.coalesce("_c", F.lit("1")), key))
    out = both.select(F.col("_other").alias("node"), "feature", "bin", rest.alias("c"), (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n"))
    return out.where("n > 0")


def sent_histogram(sums: DataFrame, key: crypto.Paillier, bits: int) -> DataFrame:
    """(node, feature, bin, g, h, n) as the active party reads it: bins side by side in ciphers of at most
    the key's length, g and h in bits each."""
    room = crypto.capacity(key, 2 * bits)
    sent = crypto.pack_ciphers(sums.withColumn("chunk", F.floor(F.col("bin") / room).cast("int")), ["node", "feature", "chunk"], F.col("bin") % room, "c", key.public, 2 * bits)
    counts = sums.groupBy("node", "feature", F.floor(F.col("bin") / room).cast("int").alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("bin") % room).cast("int"), "n"))).alias("ns"))  # at most `room` bins
    read = sent.join(counts, ["node", "feature", "chunk"]).withColumn("x", crypto.decrypt_packed(F.col("c"), key, 2 * room, bits))
    at = read.select("node", "feature", "chunk", "x", F.explode("ns").alias("slot", "n"))
    return at.select("node", "feature", (F.col("chunk") * room + F.col("slot")).alias("bin"), F.get("x", 2 * F.col("slot")).alias("g"), F.get("x", 2 * F.col("slot") + 1).alias("h"), "n")


@dataclass
class PrivateBoostedTrees:
    """Binary labels (cross entropy) or regression (squared error), grown level by level. fit and predict take
    the active party's table and those of the others by name; rows are those whose id all of them have."""

    features: Sequence[str]
    label: str
    id_col: str
    parties: Sequence[PassiveParty]
    key: crypto.Paillier
    task: str = "binary"
    n_trees: int = 5
    params: TreeParams = field(default_factory=TreeParams)
    zeros: int = 32
    edges: dict[str, list[float]] = field(default_factory=dict)
    trees: list[SharedNode] = field(default_factory=list)

    def fit(self, active: DataFrame, others: dict[str, DataFrame]) -> PrivateBoostedTrees:
        p, i = self.params, self.id_col
        # what the tables come from runs once
        given = {x.name: stash(others[x.name].select(*dict.fromkeys([i, *x.features])), "given") for x in self.parties}
        ids = active.select(i)
        for x in self.parties:
            ids = matched(ids, given[x.name].select(i), i, "left_semi")
        ids = stash(ids, "ids")
        rows = stash(matched(active, ids, i, "left_semi").select(i, F.col(self.label).cast("double").alias("_y"), *self.features, F.lit(0.0).alias("_s")), "active")
        own = {x.name: stash(matched(given[x.name], ids, i, "left_semi"), "own") for x in self.parties}
        discard(ids, *given.values())
        self.edges = self.edges or {c: e[:-1] for c, e in all_tree_edges(rows, self.features, p.max_bin).items()}
        for x in self.parties:
            x.edges = x.edges or {c: e[:-1] for c, e in all_tree_edges(own[x.name], x.features, p.max_bin).items()}
        coded = {x.name: stash(x.coded(own[x.name], i), "codes") for x in self.parties}
        for _ in range(self.n_trees):
            loss = losses.cross_entropy(F.col("_y"), losses.sigmoid(F.col("_s"))) if self.task == "binary" else losses.squared(F.col("_y"), F.col("_s"))
            told = rows.select("*", loss[1].alias("g"), loss[2].alias("h"))
            tree, at = self._grow(told, own, coded)
            weights = F.create_map(*[F.lit(v) for x in tree.walk() if x.left is None for v in (x.node, float(x.weight))])
            before, rows = rows, stash(matched(rows, at, i).withColumn("_s", F.col("_s") + F.lit(p.rate) * weights[F.col("node")]).drop("node"), "boost")
            discard(before, at)
            self.trees.append(tree)
        discard(rows, *coded.values(), *own.values())
        return self

    def _grow(self, rows: DataFrame, own: dict[str, DataFrame], coded: dict[str, DataFrame]) -> tuple[SharedNode, DataFrame]:
        """A tree and the node of each row: (id, node)."""
        p, i = self.params, self.id_col
        size = rows.agg(F.count("*").alias("n"), F.max(F.greatest(F.abs("g"), "h")).alias("top")).first()
        bits = crypto.packed_bits(size["n"], size["top"] or 1.0, self.key)
        # ciphers travel as bytes, which take half of what their digits do
        sent = stash(rows.select(i, F.unhex(crypto.encrypt_packed([F.col("g"), F.col("h")], self.key, self.key.zeros(self.zeros, base=8), bits)).alias("c")), "sent")
        held = {x.name: stash(matched(coded[x.name], sent, i), "held") for x in self.parties}
        codes = [F.coalesce(bin_code(F.col(c), self.edges[c]), F.lit(0)).alias(c) for c in self.features]
        plain = rows.select(i, "g", "h", *codes)
        root = SharedNode(0, size["n"])
        at = rows.select(i, F.lit(0).alias("node"))
        level, kin, before = [root], [], {}
        while level := [x for x in level if x.depth < p.max_depth and x.n >= p.min_samples]:
            ids = [x.node for x in level]
            found = split_gains(histogram(matched(plain, at.where(F.col("node").isin(ids)), i).drop(i), self.features), p.reg_lambda, p.reg_gamma).withColumn("party", F.lit(-1)) if self.features else None
            for k, x in enumerate(self.parties):
                # of siblings that both go on, the smaller is summed and the other derived
                pairs = [(a, b, c) for a, b, c in kin if b in ids and c in ids]
                derived = {c for _, _, c in pairs}
                names = [f"f{j}" for j in range(len(x.features))]
                summed = [v for v in ids if v not in derived]
                # all rows are at the root, so that none has to be placed
                direct = held[x.name].withColumn("node", F.lit(0)) if level == [root] else matched(held[x.name], at.where(F.col("node").isin(summed)), i)
                direct = direct.withColumn("c", F.lower(F.hex("c")))
                sums = stash(bin_sums(direct, names, self.key.public), "sums")
                if pairs:
                    summed, sums = sums, stash(sums.unionByName(sibling_sums(before[x.name], sums, pairs, self.key.public)), "sums")
                    discard(summed)
                discard(*[before[x.name]] if x.name in before else [])
                before[x.name] = sums
                gains = split_gains(sent_histogram(sums, self.key, bits), p.reg_lambda, p.reg_gamma).withColumn("party", F.lit(k))
                found = gains if found is None else found.unionByName(gains)
            first = F.struct(-F.col("gain"), "party", "feature", "bin")  # the first party's of equal splits
            best = {r["node"]: r for r in found.groupBy("node").agg(F.min_by(F.struct("gain", "party", "feature", "bin", "nl", "nt"), first).alias("b")).select("node", "b.*").collect()}  # a row per node
            level = [x for x in level if x.node in best and best[x.node]["gain"] > p.min_gain]
            for x in level:
                self._split(x, best[x.node])
            if level:
                placed, at = at, stash(self._route(at, rows, own, level), "nodes")
                discard(placed)
            kin = [(x.node, *sorted((x.left.node, x.right.node), key=lambda v, x=x: (x.left if v == x.left.node else x.right).n)) for x in level]
            level = [y for x in level for y in (x.left, x.right)]
        sums = {r["node"]: r for r in matched(rows, at, i).groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}  # a row per leaf
        for x in root.walk():
            if x.left is None:
                x.weight = leaf_weight(sums[x.node]["g"], sums[x.node]["h"], p.reg_lambda) if x.node in sums else 0.0
        discard(sent, *held.values(), *before.values())
        return root, at

    def _split(self, x: SharedNode, row) -> None:
        x.gain = row["gain"]
        if row["party"] < 0:
            x.feature, x.threshold = row["feature"], self.edges[row["feature"]][row["bin"]]
        else:
            party = self.parties[row["party"]]
            x.party, x.record = party.name, party.note(row["feature"], row["bin"])
        x.left = SharedNode(2 * x.node + 1, row["nl"], x.depth + 1)
        x.right = SharedNode(2 * x.node + 2, row["nt"] - row["nl"], x.depth + 1)

    def _route(self, at: DataFrame, rows: DataFrame, own: dict[str, DataFrame], level: list[SharedNode]) -> DataFrame:
        """The rows' nodes after the splits of a level: each party is asked about the rows at its own records."""
        i, out = self.id_col, []
        moved = lambda right: (2 * F.col("node") + 1 + right.cast("int")).alias("node")
        mine = [x for x in level if x.party is None]
        if mine:
            right = F.lit(False)
            for x in mine:
                right = F.when(F.col("node") == x.node, F.coalesce(F.col(x.feature) > F.lit(x.threshold), F.lit(False))).otherwise(right)
            out.append(matched(at.where(F.col("node").isin([x.node for x in mine])), rows.select(i, *self.features), i).select(i, moved(right)))
        for party in self.parties:
            asked = {x.node: x.record for x in level if x.party == party.name}
            if asked:
                record = F.create_map(*[F.lit(v) for pair in asked.items() for v in pair])[F.col("node")]
                sent = at.where(F.col("node").isin(list(asked))).select(i, "node", record.alias("_record"))
                answer = matched(sent.select(i, "_record"), own[party.name], i).select(i, party.goes_right(F.col("_record")).alias("_right"))
                out.append(matched(sent, answer, i).select(i, moved(F.col("_right"))))
        out.append(at.where(~F.col("node").isin([x.node for x in level])))
        first, *more = out
        for x in more:
            first = first.unionByName(x)
        return first

    def raw(self) -> Column:
        """Over the active party's features and the answers _right_<party>."""

        def value(x: SharedNode) -> Column:
            if x.left is None:
                return F.lit(float(x.weight))
            right = F.col(x.feature) > F.lit(x.threshold) if x.party is None else F.get(F.col(f"_right_{x.party}"), F.lit(x.record))
            return F.when(right, value(x.right)).otherwise(value(x.left))

        return sum((F.lit(self.params.rate) * value(t) for t in self.trees), F.lit(0.0))

    def predict(self, active: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
        """Adds prediction. A party answers for all its records at once, so one join serves all trees; a row
        that a party does not have goes left at its records."""
        out = active
        for x in self.parties:
            out = matched(out, x.answers(others[x.name], self.id_col).withColumnRenamed("right", f"_right_{x.name}"), self.id_col, "left")
        raw = self.raw()
        return out.withColumn("prediction", losses.sigmoid(raw) if self.task == "binary" else raw).drop(*[f"_right_{x.name}" for x in self.parties])

    def table(self, spark: SparkSession) -> DataFrame:
        """The active party's model: one row per node."""
        rows = [(k, x.node, x.depth, x.party, x.record, x.feature, x.threshold, x.gain, int(x.n), x.weight) for k, t in enumerate(self.trees) for x in t.walk()]
        return spark.createDataFrame(rows, "tree int, node int, depth int, party string, record int, feature string, threshold double, gain double, n long, weight double")
