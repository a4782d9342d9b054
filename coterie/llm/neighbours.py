"""Embedding near-duplicates by collision-counting projections (operator 10).

Each vector, scaled to length one, has its place on COUNT_LINES random lines, kept as a byte each. Two vectors
collide on a line if the second lies in the window centred on the first; at cosine c the distance of their
places is normal with deviation sqrt(2 - 2c), so near pairs collide on almost all lines and others on about
half. A pair that collides on the calibrated number of lines (all but RECALL of pairs at the threshold reach
it) is verified in double precision.

The window of one line holds a fixed share of all rows, so sorting whole lines would touch a fixed share of
all pairs. Lines are therefore sorted inside cells: a view is a set of lines cut into intervals, a cell a box
of those; Spark sorts each cell along one of the counting lines (another one in each view), and a row's
candidates are the rows of its window there. Their collisions are counted over all lines from the bytes
alone; vectors travel only for rows of which a pair passed. The number of lines per view follows log(n) and
the number of views follows from the wanted recall at the threshold, the usual balance by which work grows
far slower than all pairs. A cell of more than BLOCK rows is dealt over block pairs, so that a group of a
third of all rows neither meets in one task nor loses a pair. A pair that meets in several views counts in
the first. Blocks hand on link counts and a spanning forest, never the pairs.

Cases: null vectors, zero vectors and vectors with null or non-finite components link with nothing and
are their own component; vectors of different lengths never link; equal rows are vectors of their own
and link with each other; a null vec_id takes part in links, and its component is the least id reachable
(null, and kept, if there is none); a cosine equal to the threshold links; vectors of any length travel
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import stash, table
from .components import components

THRESHOLD = 0.9
#: Share of pairs at the threshold that cells and counts together are to find; closer pairs do better.
RECALL = 0.95
INTERVAL = 2.0
#: Half-width of a window, and of how many steps of a place's byte it consists.
WINDOW, STEPS = 0.9, 8
COUNT_LINES = 24
#: Rows of other vectors that a row meets in a cell, on average, if there were no groups.
CELL_ROWS = 24
BLOCK = 1024
#: Up to so many cells of more than BLOCK rows, their table (12 bytes a row) is broadcast; beyond, it is joined.
BROADCAST_CELLS = 200_000
SEED = 7


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_interval(distance: float, width: float = INTERVAL) -> float:
    """Chance that two places fall into one interval of a randomly shifted grid."""
    r = width / distance
    return 1 - 2 * _phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def calibrate(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """(lines per view, views, least number of window collisions) for n vectors."""
    near = math.sqrt(2 - 2 * threshold)
    p, q = same_interval(near), same_interval(math.sqrt(2))
    hit = 1 - 2 * _phi(-WINDOW / near)
    lines = max(1, math.ceil(math.log(max(n / CELL_ROWS, 1.5)) / -math.log(q)))
    views = max(1, math.ceil(math.log(1 - recall) / math.log(1 - p**lines * hit)))
    missed, least = 0.0, 0
    for k in range(COUNT_LINES + 1):
        missed += math.comb(COUNT_LINES, k) * hit**k * (1 - hit) ** (COUNT_LINES - k)
        if missed > (1 - recall) / 10:
            least = k
            break
    return lines, views, least


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows / np.abs(rows).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


@cache
def _drawn(dim: int, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes and shifts of the views' lines, and the axes of the counting lines."""
    rng = np.random.default_rng([SEED, dim])
    axes, shift = rng.standard_normal((dim, columns)), rng.random(columns) * INTERVAL
    return axes, shift, np.random.default_rng([SEED + 1, dim]).standard_normal((dim, COUNT_LINES))


def _cells(x: np.ndarray, lines: int, views: int) -> np.ndarray:
    """The cell of each unit vector in each view, as numbers that name the view and the length as well."""
    axes, shift, _ = _drawn(x.shape[1], lines * views)
    cell = np.floor((x @ axes + shift) / INTERVAL).astype(np.int64).reshape(len(x), views, lines)
    h = np.broadcast_to((np.arange(views, dtype=np.uint64) << np.uint64(32)) + np.uint64(x.shape[1]), cell.shape[:2])
    for k in range(lines):
        h = (h ^ cell[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(31))
    return h.view(np.int64)


def _places(x: np.ndarray) -> np.ndarray:
    """The place of each unit vector on each counting line, a byte in steps of WINDOW / STEPS."""
    return np.clip(np.floor(x @ _drawn(x.shape[1], 1)[2] * (STEPS / WINDOW)) + 128, 0, 255).astype(np.uint8)


def _codes(df: DataFrame, lines: int, views: int) -> DataFrame:
    """df (node, e): (node, codes, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, codes, places = [], [], []
            by_dim: dict[int, tuple[list, list]] = {}
            for node, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = by_dim.setdefault(len(e), ([], []))
                own[0].append(node)
                own[1].append(e)
            for ids, rows in by_dim.values():
                x = _unit(np.array(rows, np.float64))
                nodes += ids
                codes += list(_cells(x, lines, views))
                places += [r.tobytes() for r in _places(x)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(codes, pa.list_(pa.int64())), pa.array(places, pa.binary())], ["node", "codes", "places"])

    return df.mapInArrow(run, "node long, codes array<long>, places binary")


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a.astype(np.int16) - b) <= STEPS


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut so that rows of equal keys (the first columns) come together."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        n = t.num_rows
        if not n:
            continue
        same = np.ones(n, bool)
        for k in range(keys):
            c = t.column(k).to_numpy()
            same &= c == c[-1]
        cut = n - int(same.sum())
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _survivors(least: int):
    """Of rows (code, bi, bj, half, node, places) sorted by (code, bi, bj, places): those with a partner in
    their window along the sorted line that collides on enough lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            code, bi, bj, half, node = (t.column(k).to_numpy() for k in range(5))
            place = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(-1, COUNT_LINES)
            start = np.r_[True, (code[1:] != code[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]
            group, flag, alive, d = np.cumsum(start), np.zeros(len(code), bool), np.arange(len(code)), 1
            while True:
                alive = alive[alive + d < len(code)]
                # a row whose d-th next row is of another cell or beyond the window has no later partner
                alive = alive[(group[alive] == group[alive + d]) & (place[alive + d, 0].astype(np.int16) - place[alive, 0] <= STEPS)]
                if not len(alive):
                    break
                i = alive[(bi[alive] == bj[alive]) | (half[alive] != half[alive + d])]
                for at in range(0, len(i), 200_000):
                    own = i[at : at + 200_000]
                    own = own[_close(place[own], place[own + d]).sum(1) >= least]
                    flag[own] = flag[own + d] = True
                d += 1
            k = np.flatnonzero(flag)
            yield pa.RecordBatch.from_arrays([pa.array(c[k]) for c in (code, bi, bj, half, node)], ["code", "bi", "bj", "half", "node"])

    return run


def _meet(x: np.ndarray, half: np.ndarray, code: int, across: bool, lines: int, views: int, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the linked pairs whose first meeting is in this cell."""
    near = (x @ x.T >= threshold - 1e-9) & np.triu(np.ones((len(x), len(x)), bool), 1)
    if across:
        near &= half[:, None] != half[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return i, j
    place, cell = _places(x), _cells(x, lines, views)
    view = int(np.flatnonzero(cell[0] == code)[0])
    keep = np.zeros(len(i), bool)
    line = np.arange(view + 1) % COUNT_LINES  # the line along which each view sorts
    for at in range(0, len(i), 50_000):
        a, b = i[at : at + 50_000], j[at : at + 50_000]
        hit = _close(place[a], place[b])
        met = (cell[a, : view + 1] == cell[b, : view + 1]) & hit[:, line]
        keep[at : at + 50_000] = (hit.sum(1) >= least) & met[:, view] & ~met[:, :view].any(1) & (np.einsum("ij,ij->i", x[a], x[b]) >= threshold)
    return i[keep], j[keep]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (k, root) that span the components of the pairs over n places."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def _blocks(lines: int, views: int, threshold: float, least: int):
    """Of rows (code, bi, bj, half, node, copies, e) sorted by (code, bi, bj): link counts and forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            code, bi, bj, half, node, copies = (t.column(k).to_numpy() for k in range(6))
            rows = t.column(6)
            start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            us, vs, ns = [], [], []
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(code)], strict=True):
                if e - s < 2:
                    continue
                # a cell's number names the length of its vectors
                x = _unit(np.array(rows.slice(s, e - s).to_pylist(), np.float64))
                i, j = _meet(x, half[s:e], int(code[s]), bool(bi[s] != bj[s]), lines, views, threshold, least)
                if len(i):
                    own, n = node[s:e], np.zeros(e - s, np.int64)
                    np.add.at(n, i, copies[s:e][j])
                    np.add.at(n, j, copies[s:e][i])
                    has = np.flatnonzero(n)
                    k, root = _forest(i, j, e - s)
                    us += [own[has], own[k]]
                    vs += [own[has], own[root]]
                    ns += [n[has], np.zeros(len(k), np.int64)]
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (us, vs, ns)], ["u", "v", "n"])

    return run


def _nodes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) of every row, node null where the vector links with nothing; and (node, e, vec_id, copies)
    of the distinct vectors. A hash names them; should two share it, another seed is taken."""
    kind = "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    for seed in range(8):
        named = v.withColumn("node", F.when(valid, F.xxhash64(F.lit(seed), "e")))
        nodes = named.where("node is not null").groupBy("node", "e").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
        nodes = stash(nodes, "nodes")
        if not nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            return stash(named.select("vec_id", "node"), "ids"), nodes
    raise RuntimeError("eight hashes of the vectors all have clashes")


def neighbours(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df (vec_id, embedding)."""
    v, nodes = _nodes(df)
    lines, views, least = calibrate(nodes.count(), threshold, recall)
    coded = stash(_codes(nodes.select("node", "e"), lines, views), "codes")
    cells = coded.select("node", F.explode("codes").alias("code"))
    # cells of more than a block: each holds over BLOCK rows, so there are few of them, counted before they are sent
    large = stash(cells.groupBy("code").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("code", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")), "large")
    few = large.count() <= BROADCAST_CELLS
    # each view starts the bytes at a line of its own, along which its cells are sorted
    turned = F.concat(F.expr(f"substring(places, view % {COUNT_LINES} + 1)"), F.expr(f"substring(places, 1, view % {COUNT_LINES})")).alias("places")
    rows = coded.select("node", "places", F.posexplode("codes").alias("view", "code")).select("node", "code", turned)
    rows = rows.join(F.broadcast(large) if few else large, "code", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("half", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["code", "bi", "bj"]
    rows = rows.select("code", F.least("half", "other").alias("bi"), F.greatest("half", "other").alias("bj"), "half", "node", "places")
    passed = rows.repartition(*key).sortWithinPartitions(*key, "places").mapInArrow(_survivors(least), "code long, bi int, bj int, half int, node long")
    passed = stash(passed, "passed").join(nodes.select("node", "copies", "e"), "node").select(*key, "half", "node", "copies", "e")
    found = stash(passed.repartition(*key).sortWithinPartitions(*key).mapInArrow(_blocks(lines, views, threshold, least), "u long, v long, n long"), "found")

    links = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    root = components(found.where("n = 0").select("u", "v"))
    out = nodes.drop("e").join(links, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = out.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = out.join(least_id, "root").select(F.col("node").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("component_id").alias("c"))
    out = v.join(out, v.node == out.k, "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    kept = F.coalesce(F.col("vec_id") == component, component.isNull())
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
