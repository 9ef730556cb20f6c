"""Every registered engine query against its DuckDB twin at the smallest size; fixed golden values."""

import math
import os

import duckdb
import pytest

from simplexa.functions.distances import distance
from simplexa.operators import neighbors
from simplexa.plans import registry

DATA = "/root/testdata/sf0.001"
GOLDEN = {"euclidean": 4.358898944, "manhattan": 7.0, "chebyshev": 3.0, "minkowski": 3.802952461, "canberra": 2.6, "braycurtis": 0.538461538, "cosine": 0.533430525, "correlation": 1.377964473, "hellinger": 0.618697503}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden(spark, name):
    df = spark.createDataFrame([([1.0, 2.0, 0.0, 4.0], [0.0, 2.0, 3.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(distance(name, "a", "b", 3.0)).first()[0] == pytest.approx(GOLDEN[name], abs=1e-9)


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0], [1.0, 0.0])], "o array<double>, p array<double>, x array<double>")
    for name, both, one in (("cosine", 0, 1), ("hellinger", 0, 1), ("jaccard", 0, 1), ("braycurtis", 0, 1)):
        assert list(df.select(distance(name, "o", "p"), distance(name, "o", "x")).first()) == [both, one]
    with pytest.raises(ValueError, match="unknown"):
        distance("nonsense", "o", "x")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "documents"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = registry.queries()[name](spark, DATA)
    want = con.sql(registry.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(want.columns) == sorted(df.columns)
    expected = sorted(tuple(r[i] for i in at) for r in want.fetchall())
    got = sorted(map(tuple, df.collect()))
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == pytest.approx(b, abs=2e-6)


def test_knn_blocks_and_scale(spark):
    rows = [(i, [float(i % 7), float(i // 7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    whole, cut = (sorted(map(tuple, neighbors.knn(df, 5, block_rows=b).collect())) for b in (1000, 9))
    assert whole == cut and len(whole) == 300
    edges = neighbors.knn(df, 5)
    for r in neighbors.local_scale(edges, 6).collect():
        d = [e[3] for e in whole if e[0] == r.i]
        assert r.rho == min(d)
        assert sum(math.exp(-max(0, x - r.rho) / r.sigma) for x in d) == pytest.approx(math.log2(6), abs=1e-3) or r.sigma <= 1e-3 * sum(d) / 6 + 1e-12
    assert neighbors.knn(df.limit(1), 5).count() == 0
