"""Databases read in ranges from in-memory Derby, image augmentation, and PCA of many columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.operators import transform
from coterie.sources import readers

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def derby(spark):
    """A table whose key is skewed, repeated and sometimes null."""
    url = "jdbc:derby:memory:parties;create=true"
    rng = np.random.default_rng(3)
    keys = np.r_[np.full(400, 7), rng.integers(0, 50, 300), rng.integers(10_000_000, 10_000_050, 300), [-900_000_000]]
    rows = [(None if i % 97 == 0 else int(k), float(i) / 4, f"name {i}", i) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "k int, v double, s string, n int").write.jdbc(url, "people", mode="overwrite", properties=DRIVER)
    return readers.Database(spark, url, DRIVER), rows


def test_ranges_are_read_once(spark, derby):
    db, rows = derby
    for parts in (1, 4, 9):
        told = db.predicates("people", "k", parts)
        df = db.read("people", split="k", parts=parts)
        assert df.rdd.getNumPartitions() == len(told) and df.columns == ["k", "v", "s", "n"]
        assert sorted(map(tuple, df.collect()), key=lambda r: r[3]) == rows
    sizes = [r["count"] for r in db.read("people", split="k", parts=8).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    # one key alone holds 400 rows; nothing else comes near it
    heavy = sum(r[0] == 7 for r in rows)
    assert max(sizes) <= heavy + 130 and sorted(sizes)[-2] <= 260 and len(sizes) >= 5


def test_columns_are_chosen_in_the_database(spark, derby):
    db, rows = derby
    out = db.read("people", excluding=["s", "V"], split="v", parts=3)
    assert out.columns == ["k", "n"] and sorted(r.n for r in out.collect()) == list(range(len(rows)))
    assert db.read("people", target=["n", "K"]).columns == ["n", "k"]
    with pytest.raises(ValueError, match="no columns"):
        db.read("people", target=["missing"])
    spark.createDataFrame([(None, "x")], "k int, s string").write.jdbc(db.url, "hollow", mode="overwrite", properties=DRIVER)
    assert db.predicates("hollow", "k", 4) == ['"k" is null'] and db.read("hollow", split="k").count() == 1
    spark.createDataFrame([], "k int, s string").write.jdbc(db.url, "empty", mode="overwrite", properties=DRIVER)
    assert db.read("empty", split="k").count() == 0
    assert db.read('(select "k", "n" from people where "n" < 10) t', split="n", parts=2).count() == 10


def test_augmentation(spark):
    rng = np.random.default_rng(1)
    x = rng.random((40, 2, 5, 4))
    df = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "id long, px array<double>")
    image = lambda d, **o: {r.id: r.px for r in d.select("id", readers.augmented("px", 5, 4, "id", **o).alias("px")).collect()}
    got = image(df.repartition(7), seed=3, epoch=1, pad=2)
    assert got == image(df.coalesce(1), seed=3, epoch=1, pad=2)
    assert got != image(df, seed=3, epoch=2, pad=2) and got != image(df, seed=4, epoch=1, pad=2)
    seen = set()
    for i, v in got.items():
        wide = np.pad(x[i], ((0, 0), (2, 2), (2, 2)))
        views = {(dy, dx, f): (wide[:, dy : dy + 5, dx : dx + 4][:, :, ::-1] if f else wide[:, dy : dy + 5, dx : dx + 4]).ravel().tolist() for dy in range(5) for dx in range(5) for f in (0, 1)}
        seen |= {k for k, w in views.items() if w == v}
        assert v in views.values()
    assert len(seen) > 15 and {f for _, _, f in seen} == {0, 1}
    assert image(df, seed=3, epoch=1, pad=0, flip=False) == {i: v.ravel().tolist() for i, v in enumerate(x)}
    other = readers.overridden(df, "id", "px", spark.createDataFrame([(3, [9.0]), (77, [1.0])], "id long, px array<double>"))
    assert other.columns == ["id", "px"] and {r.id: r.px for r in other.collect()} == {i: [9.0] if i == 3 else v.ravel().tolist() for i, v in enumerate(x)}


def test_pca_of_many_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 6)) @ rng.standard_normal((6, 512)) * 3 + rng.standard_normal((700, 512)) + 1e5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [None] * 512)], "id long, v array<double>").repartition(6)
    p = transform.pca_fit(df, "v", 5)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    var = s**2 / 699
    assert p["n_samples"] == 700 and p["mean"] == pytest.approx(x.mean(0))
    assert np.abs(p["components"]) == pytest.approx(np.abs(vt[:5]), abs=1e-6)
    assert p["explained_variance"] == pytest.approx(var[:5]) and p["noise_variance"] == pytest.approx(var[5:].sum() / 507)
    scores = transform.pca_transform(df.where("id >= 0"), ["id"], "v", p, whiten=True).orderBy("id").collect()
    assert np.abs(np.array([r[1:] for r in scores])) == pytest.approx(np.abs(u[:, :5] * np.sqrt(699)), abs=1e-6)
    assert len(transform.pca_fit(df.limit(0), "v", 2)["mean"]) == 0


@pytest.fixture
def service():
    """A service that gives pages of records, fails each page's first call, and refuses page 9."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            page = asked.get("page", 0)
            seen.append(page)
            code = 404 if page == 9 else 503 if seen.count(page) == 1 else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                rows = [{"id": 10 * page + k, "v": None if k == 3 else f"{asked.get('name', '')}{k}", "more": 1} for k in range(5)]
                self.wfile.write(json.dumps({"data": rows, "page": page}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen
    server.shutdown()


def test_service_in_pages(spark, service):
    url, seen = service
    df = readers.from_api(spark, url, "id long, v string", [{"page": k, "name": "n"} for k in range(4)])
    assert df.rdd.getNumPartitions() == 4
    got = sorted((r.id, r.v) for r in df.collect())
    assert got == [(10 * p + k, None if k == 3 else f"n{k}") for p in range(4) for k in range(5)]
    assert readers.from_api(spark, url, "id long", {"page": 5}).count() == 5
    before = seen.count(9)
    with pytest.raises(Exception, match="404"):
        readers.from_api(spark, url, "id long", {"page": 9}).collect()
    assert seen.count(9) - before >= 1
