import math

import numpy as np

from coterie.llm import neighbours as nb


def brute(rows):
    valid = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    scaled = [np.array(v, float) / max(map(abs, v)) if ok else None for (_, v), ok in zip(rows, valid)]
    unit = [v if v is None else v / np.linalg.norm(v) for v in scaled]
    n = len(rows)
    link = [[j for j in range(n) if j != i and valid[i] and valid[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for y in link[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        c = min((rows[y][0] for y in seen if rows[y][0] is not None), default=None)
        out.append((rows[i][0], len(link[i]), c, c is None or c == rows[i][0]))
    return out


def make(seed, n, spread):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(n)]
    k = n
    for c in range(12):
        for _ in range(rng.integers(1, 9)):
            rows.append((k, (np.array(rows[c][1]) + spread * rng.standard_normal(64)).tolist()))
            k += 1
    return rows


def test_cases_against_brute_force(spark, monkeypatch):
    rows = make(0, 150, 0.15)
    rows += [(1000, None), (1001, [0.0] * 64), (1002, [None] + [1.0] * 63), (1003, [float("nan")] * 64), (1004, [float("inf")] * 64), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, []), (None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1]), (1008, rows[5][1]), (None, [9.0, -9.0]), (1009, [1e200, 2e200])]
    for block in (1024, 3):
        monkeypatch.setattr(nb, "BLOCK", block)
        df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, n string")
        got = sorted(map(tuple, nb.neighbours(df).collect()), key=str)
        assert got == sorted(brute(rows), key=str)
    assert nb.neighbours(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs at cosine 0.9 to 0.93, the hardest ones."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9001, 0.93)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    got = nb.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) / 800 >= 0.9 and max(r.n_links for r in got) == 1


def test_calibration():
    small, big = nb.calibrate(1_000), nb.calibrate(10_000_000)
    assert small[0] < big[0] and small[1] < big[1] and small[2] == big[2]
    assert abs(nb.same_interval(0.447) - 0.822) < 0.01
