"""Words, distances and numbers in arrays against one at a time."""

import random
from collections import Counter

import numpy as np
import pytest

from lexmatch.functions import batches, codec
from lexmatch.operators import fuzzy
from lexmatch.plans.stages import spread
from lexmatch.sources import corpus, store
from tests.test_functions import osa, word


@pytest.mark.parametrize("letters,longest,places", [("abcd", 9, 1 << 22), ("abé\0\U0001d4b3Z", 9, 20), ("ab", 80, 1 << 22)])
def test_distances_and_near_pairs(monkeypatch, letters, longest, places):
    monkeypatch.setattr(batches, "PLACES", places)
    monkeypatch.setattr(batches, "PAIRS", 500)
    r = random.Random(longest)
    queries, terms = sorted({word(r, longest, letters) for _ in range(25)} | {""}), [*(word(r, longest, letters) for _ in range(60)), ""]
    want = {(i, j): osa(q, t) for i, q in enumerate(queries) for j, t in enumerate(terms)}
    a, b, (q, t) = batches.Words(queries), batches.Words(terms), np.array([*want]).T
    assert batches.osa(a, b, q, t).tolist() == [*want.values()]
    for k in (1, 2, 3):
        near = {pair: d for pair, d in want.items() if d <= k}
        for found in (batches.near(a, b, k), batches.Keys(a, k).near(b)):
            got = [((int(i), int(j)), int(d)) for x in found for i, j, d in zip(*x)]
            assert dict(got) == near and len(got) == len(near)


@pytest.mark.parametrize("k", [1, 2])
def test_a_large_workload_is_joined_by_keys(spark, monkeypatch, k):
    monkeypatch.setattr(fuzzy, "FEW_KEYS", 0)
    r = random.Random(k)
    terms, queries = sorted({word(r, 12, "abc") for _ in range(150)}), sorted({word(r, 12, "abc") for _ in range(20)} | {""})
    found = fuzzy.lookup(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(t, i) for i, t in enumerate(terms)], corpus.DICTIONARY), k, "deletions")
    assert sorted(map(tuple, found.collect())) == sorted((q, t, i, osa(q, t)) for q in queries for i, t in enumerate(terms) if osa(q, t) <= k)


@pytest.mark.parametrize("strategy", ["pairs", "deletions"])
def test_a_lookup_does_nothing_for_each_occurrence_of_a_word(spark, strategy):
    """A filter on what is made of a term once moved through the count of words, into a fold over the letters of every word of every text."""
    texts = spark.createDataFrame([("one two one",), (None,)], "text string")
    found = fuzzy.lookup(spark.createDataFrame([("oen",)], "query string"), corpus.dictionary(texts), 2, strategy)
    assert [tuple(x) for x in found.collect()] == [("oen", "one", 2, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Generate" not in plan


def test_dictionary_equals_words(spark):
    texts = ["It's éKİa KaSe", "", None, "x" * 10, "ab Cd " * 400_000 + "end", "\0a\0b"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter(x["term"] for x in corpus.words(table).collect())
    assert {x["term"]: x["freq"] for x in corpus.dictionary(table).collect()} == want and want["ab"] == 400_000
    assert corpus.dictionary(table).dtypes == [("term", "string"), ("freq", "bigint")]


def test_a_table_of_many_files_is_read_where_it_is(spark, tmp_path):
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    plan = lambda name: spread(spark.read.parquet(str(tmp_path / name)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan("many") and "Repartition" in plan("one")


def test_many_numbers_are_packed_as_each():
    values = [0, 1, 63, 64, 127, 128, 8191, 8192, 1 << 31, (1 << 63) - 1]
    signed = [*values, *(-x for x in values[1:]), codec.LEAST]
    for given, pack, sign in ((values, codec.pack_unsigned, False), (signed, codec.pack_signed, True)):
        data = codec.pack_many(np.array(given), sign)
        assert data == b"".join(map(pack, given))
        for block in (10, 1 << 20):
            back, at = codec.unpack_many(np.frombuffer(b"??" + data + b"\0", np.uint8), 2, len(given), sign, block)
            assert back.tolist() == given and at == 2 + len(data)
        with pytest.raises(EOFError):
            codec.unpack_many(np.frombuffer(data, np.uint8), 0, len(given) + 1, sign)
    assert codec.pack_many(np.zeros(0, np.int64)) == b""


def test_binary_file_in_pieces(spark, tmp_path):
    """One word "aé", whose first letter's node leads to the end; the driver gets packed pieces, never rows."""
    nodes = spark.createDataFrame([(0, 0, 1, 1, False), (1, 1, 1, 1, False), (2, 2, 0, 1, True)], "order_id bigint, first_edge bigint, degree bigint, reachable bigint, is_terminal boolean")
    edges = spark.createDataFrame([(0, 0, 1, "a"), (1, 1, 2, "é")], "edge_id bigint, src_order bigint, dst_order bigint, label string")
    words = spark.createDataFrame([("aé", 300, 0)], "term string, freq bigint, idx bigint")
    data = b"".join(store.export_pieces(nodes, edges, words))
    assert data == store.file_bytes([0, 1, 2, 2], [1, -2], "aé", [1, 1, 1], [300])
    store.write_file(spark, str(tmp_path / "x.bin"), iter([data[:5], b"", data[5:]]))
    assert [tuple(x) for x in store.import_dictionary(spark, str(tmp_path / "x.bin")).drop("path").collect()] == [("aé", 300, 0)]
    assert [tuple(x) for x in store.import_nodes(spark, str(tmp_path / "x.bin")).drop("path").orderBy("order_id").collect()] == [(0, 0, 1, 1), (1, 1, 1, 1), (2, 2, 0, 1)]
    with pytest.raises(ValueError, match="too large"):
        [*store.export_pieces(nodes, edges, words, limit=50)]
    none = [x.where("false") for x in (nodes, edges, words)]
    assert b"".join(store.export_pieces(*none)) == store.file_bytes([0], [], "", [], [])
