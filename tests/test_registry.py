"""Queries against their SQL over the smallest tables; the driver does the same at a larger size."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lexmatch.operators import ordering
from lexmatch.plans import registry
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        if (DATA / f"{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(table):
    columns = sorted(table.columns)
    return sorted(repr(x) for x in table[columns].astype(object).where(table[columns].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, db, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["anneal_layout", "anneal_topological_cache", "cache_aware_pipeline"])
def test_search_lowers_the_cost(spark, sf_dir, name):
    for row in registry.QUERIES[name](spark, sf_dir).collect():
        assert row["cost_after"] <= row["cost_before"]


def test_spectral_layout_is_the_order_of_the_fiedler_vector(spark, sf_dir):
    """Against all eigenvectors of the dense Laplacian of the same graph; neighbours in order may swap only where their values are equal."""
    edges = ordering.CompressedRows(registry._automaton(registry.small(spark, sf_dir))).edges.select("src_order", "dst_order", "weight").collect()
    n = 1 + max(max(e["src_order"], e["dst_order"]) for e in edges)
    laplacian = np.zeros((n, n))
    for a, b, w in edges:
        laplacian[[a, b], [a, b]] += max(w, 1)
        laplacian[[a, b], [b, a]] -= max(w, 1)
    values, vectors = np.linalg.eigh(laplacian)
    x = vectors[:, 1]
    x = -x if x[np.flatnonzero(np.abs(x) > 1e-9)[0]] > 0 else x
    got = [r["node_id"] for r in registry.QUERIES["spectral_layout"](spark, sf_dir).orderBy("position").collect()]
    assert values[1] > 1e-6 and sorted(got) == [*range(n)] and (np.diff(x[got]) > -1e-6).all()


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["query", "term", "freq", "distance"] and set(entry.oracle_sql()) <= set(entry.queries())
