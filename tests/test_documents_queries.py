"""Queries over the documents' dictionary against the same step over tables that are made here."""

import pytest

from lexmatch.operators import automaton, layout, ordering
from lexmatch.plans import registry
from lexmatch.plans.stages import written

BASES = "lookup_osa_k3 lookup_pairs_k2 lookup_deletions_k2 lookup_deletions_k3 csr_delta_offsets cache_arrangement_cost arranged_edges undirected_graph coarsened_graph d3_nodes d3_links store_round_trip binary_round_trip codec_sizes".split()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """documents of a few words, none of which is in the names."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(0, "tap taps top tops tap"), (1, "stop zebra zebras")], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def test_all_are_registered_with_their_sql():
    assert set(BASES) <= set(registry.QUERIES) and set(BASES) <= set(registry.ORACLES)


@pytest.mark.parametrize("name", ["store_round_trip", "binary_round_trip"])
def test_words_are_the_documents(spark, small, name):
    found = {x["term"]: x["freq"] for x in registry.QUERIES[name](spark, small).collect()}
    assert found == {"tap": 2, "taps": 1, "top": 1, "tops": 1, "stop": 1, "zebra": 1, "zebras": 1}


def test_graph_is_that_of_the_documents(spark, small):
    rows = ordering.CompressedRows(automaton.Automaton(written(registry.vocabulary(spark, small), "dictionary"), keep=written))
    want = sorted(map(tuple, layout.undirected(rows.edges).collect()))
    assert want and sorted(map(tuple, registry.QUERIES["undirected_graph"](spark, small).collect())) == want


def test_totals_of_three_edits(spark, tmp_path):
    spark.createDataFrame([(0, "tap taps zebra zebras stop")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "taps zebra unheard")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    queries = [x["query"] for x in registry.workload(spark, str(tmp_path)).collect()]
    terms = ["tap", "taps", "zebra", "zebras", "stop"]

    def osa(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rows = {x["k"]: x["total"] for x in registry.QUERIES["lookup_batch_totals"](spark, str(tmp_path)).collect()}
    assert rows == {k: sum(osa(q, t) <= k for q in queries for t in terms) for k in range(4)}
