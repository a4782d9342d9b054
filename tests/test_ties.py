"""Queries against SQL on values that stand next to a tie."""

import duckdb
import oracle
import pytest

from coterie.plans import registry

#: Prices and priorities whose class scores are next to equal, and one whose loss is next to a rounding tie.
PRICES = [(150000.0, 3), (300000.0, 3), (400000.0, 4), (500000.0, 5), (469011.01, 5), (123.45, 1)]
#: Next to a tie of the ninth digit once scaled.
PIXELS = [-0.07736567407846451, -0.07736562937498093, -0.07736564427614212, 0.5]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    path, con = tmp_path_factory.mktemp("ties"), duckdb.connect()
    orders = ", ".join(f"({i}::BIGINT, {1370 + i}::BIGINT, 'O', {x}::DOUBLE, '{p}-X')" for i, (x, p) in enumerate(PRICES))
    con.execute(f"COPY (SELECT * FROM (VALUES {orders}) t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority)) TO '{path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT 1::BIGINT AS vec_id, list_transform(range(64), lambda i: {PIXELS}[i % 4 + 1])::FLOAT[] AS embedding, 0 AS label) TO '{path}/embeddings.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name,table", [("fed_inference", "orders"), ("image_normalise", "embeddings")])
def test_ties(spark, tables, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    assert oracle.compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], tables) is None
