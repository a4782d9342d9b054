"""Neighbours of an ordered table merged by chi-square, least first, as one loop over the whole table would.

Merges far from each other do not touch: until every pair is above a level, a stretch of groups goes its own way
as long as the pairs at its ends stay above that level. So a table is cut into blocks where pairs are far above
it, each block is merged up to the level by a task of its own, and it tells how its end groups changed and when. A
cut whose pair would have come within the level in that course is dropped and its two blocks are merged as one.
Levels rise until one task can merge what is left; it starts from a state that the loop passes through.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, stash
from .ordered import numbered

BLOCK = 50_000  # groups of a block; one task takes four times as many of a feature at the end
WINDOW = 1_000  # last groups of a block, among which it is cut off
_GROUPS = "feature string, block long, value double, counts array<double>, chi double, tail boolean, first array<array<double>>, last array<array<double>>"


def pair_chi(u: tuple, v: tuple) -> float:
    """Chi-square of two rows of counts; cells that are expected to be 0 are left out."""
    p, q = sum(u), sum(v)
    out = 0.0
    for own, size in ((u, p), (v, q)):
        part = 0.0
        for o, x, y in zip(own, u, v, strict=True):
            e = size * (x + y) / (p + q)
            if e > 0:
                part += (o - e) * (o - e) / e
        out += part
    return out


def neighbour_chi(counts: np.ndarray) -> np.ndarray:
    """pair_chi() of each row and the next, with the same rounding."""
    a, b = counts[:-1], counts[1:]
    p, q = a.sum(1), b.sum(1)
    out = np.zeros(len(a))
    with np.errstate(divide="ignore", invalid="ignore"):
        for own, size in ((a, p), (b, q)):
            part = np.zeros(len(a))
            for j in range(counts.shape[1]):
                e = size * (a[:, j] + b[:, j]) / (p + q)
                d = own[:, j] - e
                part += np.where(e > 0, d * d / np.where(e > 0, e, 1), 0)
            out += part
    return out


def greedy(counts, values, max_group: int = 1, level: float = math.inf) -> tuple[list[int], list[tuple], list[tuple], list[tuple]]:
    """Merges, again and again, the neighbours of least chi-square (the first of equal ones), until max_group
    groups are left or every pair is above the level. counts: a row per value in order, a column per class. A heap
    of pairs over a linked list of groups: a pair is out of date once either of its groups has changed.

    Returns the places of the groups' first rows, the groups' counts, and the states of the first and of the last
    group, each after (chi, value) of the highest merge so far."""
    counts = np.asarray(counts, float)
    n = len(counts)
    rows = [tuple(r) for r in counts.tolist()]
    after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    heap = [(x, k, 0, 0) for k, x in enumerate(neighbour_chi(counts).tolist())] if n > 1 else []
    heapq.heapify(heap)
    clock, left = (-1.0, 0), n
    first, last = [(-1.0, 0.0, *rows[0])] if n else [], [(-1.0, 0.0, *rows[-1])] if n else []
    while left > max_group and heap:
        chi, k, own, other = heapq.heappop(heap)
        nxt = after[k] if version[k] == own else n
        if nxt >= n or version[nxt] != other:
            continue
        if chi > level:
            break
        clock, left = max(clock, (chi, k)), left - 1
        rows[k] = tuple(x + y for x, y in zip(rows[k], rows[nxt], strict=True))
        version[k] += 1
        version[nxt] = -1
        after[k] = after[nxt]
        if k == 0:
            first.append((clock[0], float(values[clock[1]]), *rows[k]))
        if after[k] < n:
            before[after[k]] = k
            heapq.heappush(heap, (pair_chi(rows[k], rows[after[k]]), k, version[k], version[after[k]]))
        else:
            last.append((clock[0], float(values[clock[1]]), *rows[k]))
        if before[k] >= 0:
            heapq.heappush(heap, (pair_chi(rows[before[k]], rows[k]), before[k], version[before[k]], version[k]))
    kept = [k for k in range(n) if version[k] >= 0]
    return kept, [rows[k] for k in kept], first, last


def alike(counts: np.ndarray, spare: int) -> np.ndarray:
    """Places of the first rows of the groups that are left once neighbours of equal shares are merged, but for the
    last `spare` such pairs: the loop merges these pairs before all others, from the first on, and they change
    neither each other's chi-square of 0 nor what comes after them."""
    a, b = counts[:-1], counts[1:]
    same = (a * b.sum(1)[:, None] == b * a.sum(1)[:, None]).all(1)
    pairs = np.flatnonzero(same)
    same[pairs[max(0, len(pairs) - spare):]] = False
    return np.flatnonzero(np.concatenate([[True], ~same]))


def crossed(left, right, level: float) -> bool:
    """Whether the pair of the left block's last and the right block's first group comes within the level at any
    time, if each changes as told."""
    state = [tuple(left[0][2:]), tuple(right[0][2:])]
    if pair_chi(*state) <= level:
        return True
    for _, side, counts in heapq.merge(*[[((m[0], m[1]), i, tuple(m[2:])) for m in moves[1:]] for i, moves in enumerate((left, right))], key=lambda m: m[0]):
        state[side] = counts
        if pair_chi(*state) <= level:
            return True
    return False


def _cut(counts: np.ndarray) -> int:
    """How many rows of a window are before its pair of highest chi-square."""
    return int(neighbour_chi(counts).argmax()) + 1 if len(counts) > 1 else len(counts)


def _groups(rows, values, counts, window: int, first=None, last=None):
    import pandas as pd

    n = len(values)
    out = pd.DataFrame({"feature": rows["feature"].iloc[0], "block": rows["block"].iloc[0], "value": values, "counts": [list(map(float, c)) for c in counts]})
    out["chi"] = np.append(neighbour_chi(np.asarray(counts, float)), np.nan)
    out["tail"] = np.arange(n) >= n - window
    out["first"] = [[list(m) for m in first] if first and i == 0 else None for i in range(n)]
    out["last"] = [[list(m) for m in last] if last and i == n - 1 else None for i in range(n)]
    return out


def _advance(rows: DataFrame, unions: dict[str, list[list[int]]], levels: dict[str, float], window: int) -> DataFrame:
    """The groups of each union of blocks once merged up to its feature's level. The window at a union's end goes to
    the next one as well, and both cut it at the same pair."""
    to = [(f, b, u[0], own[k + 1][0] if k + 1 < len(own) and b == u[-1] else None) for f, own in unions.items() for k, u in enumerate(own) for b in u]
    to = rows.sparkSession.createDataFrame(to, "feature string, block long, own long, next long")
    place = lambda block, halo, end: F.struct(F.col(block).alias("block"), F.lit(halo).alias("halo"), F.lit(end).alias("end"))
    ends = F.col("tail") & F.col("next").isNotNull()
    dealt = rows.join(F.broadcast(to), ["feature", "block"]).select("feature", "value", "counts", F.explode(F.when(ends, F.array(place("own", False, True), place("next", True, False))).otherwise(F.array(place("own", False, False)))).alias("to"))

    def step(rows):
        rows = rows.sort_values("value", ignore_index=True)
        counts, values = np.array(rows["counts"].tolist(), float), rows["value"].to_numpy(float)
        halo, end = int(rows["halo"].sum()), int(rows["end"].sum())
        start = _cut(counts[:halo]) if halo else 0
        stop = len(rows) - end + _cut(counts[len(rows) - end:]) if end else len(rows)
        counts, values = counts[start:stop], values[start:stop]
        kept, merged, first, last = greedy(counts, values, 1, levels[rows["feature"].iloc[0]])
        return _groups(rows, values[kept], merged, window, first, last)

    return dealt.select("feature", "value", "counts", "to.*").groupBy("feature", "block").applyInPandas(step, _GROUPS)


def _crossings(groups: DataFrame, unions: dict[str, list[list[int]]], levels: dict[str, float]) -> set[tuple[str, int]]:
    """(feature, first block) of the unions whose cut on the right does not hold."""
    spark = groups.sparkSession
    pairs = [(f, u[0], v[0]) for f, own in unions.items() for u, v in zip(own, own[1:])]
    if not pairs:
        return set()
    pairs = spark.createDataFrame(pairs, "feature string, block long, next long")
    right = groups.where("first is not null").select("feature", F.col("block").alias("next"), "first")
    told = groups.where("last is not null").select("feature", "block", "last").join(F.broadcast(pairs), ["feature", "block"]).join(right, ["feature", "next"])

    def check(batches):
        for b in batches:
            bad = [crossed(x, y, levels[f]) for f, x, y in zip(b["feature"], b["last"], b["first"], strict=True)]
            yield b.loc[np.array(bad, bool), ["feature", "block"]]

    return {tuple(r) for r in told.mapInPandas(check, "feature string, block long").collect()}  # cuts that failed


def _packed(sizes: dict[int, int], block: int) -> list[list[int]]:
    """Consecutive blocks put together up to a block's size."""
    out: list[list[int]] = []
    room = 0
    for b in sorted(sizes):
        if not out or sizes[b] > room:
            out.append([])
            room = block
        out[-1].append(b)
        room -= sizes[b]
    return out


def shrunk(table: DataFrame, max_group: int, block: int = BLOCK) -> DataFrame:
    """(feature, value, counts) like the table, with so many pairs merged already that four blocks hold a
    feature's groups. A feature whose cuts fail at the lowest levels too (each merge sets off the next one, all
    along the table) is left as it is."""
    window, most = max(2, min(WINDOW, block // 4)), 4 * block
    held = stash(table.select("feature", F.col("value").cast("double").alias("value"), F.col("counts").cast("array<double>").alias("counts")), "values")
    large = [r["feature"] for r in held.groupBy("feature").count().where(F.col("count") > most).collect()]  # a row per feature
    if not large:
        return held
    out = held.where(~F.col("feature").isin(large))

    def first_pass(rows):
        rows = rows.sort_values("value", ignore_index=True)
        counts = np.array(rows["counts"].tolist(), float)
        starts = alike(counts, max_group - 1)
        return _groups(rows, rows["value"].to_numpy(float)[starts], np.add.reduceat(counts, starts), window)

    placed = numbered(held.where(F.col("feature").isin(large)), [F.col("feature"), F.col("value")]).withColumn("block", F.floor((F.col("rn") - 1) / block))
    rows = stash(placed.groupBy("feature", "block").applyInPandas(first_pass, _GROUPS), "groups")
    share = dict.fromkeys(large, 0.5)
    while True:
        sizes: dict[str, dict[int, int]] = {}
        for r in rows.groupBy("feature", "block").count().collect():  # a row per block
            sizes.setdefault(r["feature"], {})[r["block"]] = r["count"]
        ready = [f for f in sizes if sum(sizes[f].values()) <= most or share[f] < 0.01]
        out = out.unionByName(rows.where(F.col("feature").isin(ready)).select("feature", "value", "counts"))
        todo = [f for f in sizes if f not in ready]
        if not todo:
            return out
        rows = rows.where(F.col("feature").isin(todo))
        at = [F.percentile_approx("chi", share[f]).alias("x") for f in todo]
        cut = rows.where(~F.isnan("chi")).groupBy("feature").agg(*[x.alias(f"x{i}") for i, x in enumerate(at)]).collect()
        levels = {r["feature"]: r[f"x{todo.index(r['feature'])}"] for r in cut}
        pending, parts = {f: _packed(sizes[f], block) for f in levels}, []
        for f in set(todo) - set(levels):  # a group to a block
            pending[f], levels[f] = _packed(sizes[f], block), 0.0
        while pending:
            source = rows.where(F.col("feature").isin(list(pending)))
            groups = stash(_advance(source, pending, levels, window), "groups")
            left = {r["feature"]: r["count"] for r in groups.groupBy("feature").count().collect()}
            bad = _crossings(groups, pending, levels)
            failed, good = [], []
            for f in list(pending):
                own, whole = pending[f], sum(sizes[f].values())
                joined: list[list[int]] = []
                for i, u in enumerate(own):
                    if i and (f, own[i - 1][0]) in bad:
                        joined[-1] = joined[-1] + u
                    else:
                        joined.append(list(u))
                if len(joined) == len(own) and max_group <= left[f] < whole:
                    good.append(f)
                elif len(joined) == len(own) or max(sum(sizes[f][b] for b in u) for u in joined) > most:
                    failed.append(f)
                else:
                    pending[f] = joined
            if good:
                parts.append(groups.where(F.col("feature").isin(good)))
            else:
                discard(groups)
            for f in failed:
                share[f] /= 5
                parts.append(rows.where(F.col("feature") == f))
            for f in good:
                share[f] = 0.5
            pending = {f: u for f, u in pending.items() if f not in good and f not in failed}
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)


def merged(table: DataFrame, max_group: int, block: int = BLOCK) -> DataFrame:
    """(feature, grp, value): the first value of each of the groups that are left of a table (feature, value,
    counts of each class), a value to a row."""

    def rest(rows):
        import pandas as pd

        rows = rows.sort_values("value", ignore_index=True)
        values = rows["value"].to_numpy(float)
        kept = greedy(rows["counts"].tolist(), values, max_group)[0]
        return pd.DataFrame({"feature": rows["feature"].iloc[0], "grp": range(1, len(kept) + 1), "value": values[kept]})

    return shrunk(table, max_group, block).groupBy("feature").applyInPandas(rest, "feature string, grp int, value double")
