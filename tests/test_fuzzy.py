import random

import pytest

from lexmatch.operators import fuzzy
from lexmatch.plans.registry import SINGLE_EDITS
from lexmatch.sources import corpus
from tests.test_functions import osa, word


def frame(spark, words):
    return spark.createDataFrame([(w,) for w in words], "query string")


@pytest.fixture(scope="module")
def small(spark):
    r = random.Random(3)
    terms = sorted({word(r, 9, "abcd") for _ in range(250)} | {"longerwords", "longerwodrs", "longestwords", "ongerwordsx"})
    return terms, spark.createDataFrame([(t, i) for i, t in enumerate(terms)], corpus.DICTIONARY).cache()


@pytest.mark.parametrize("k", [0, 1, 2, 3])
@pytest.mark.parametrize("strategy", ["deletions", "pairs"])
def test_lookup_equals_brute_force(spark, small, k, strategy):
    terms, held = small
    r = random.Random(k)
    queries = sorted({word(r, 9, "abcd") for _ in range(40)} | {"", "longerwords", "longerwors"})
    got = {(x["query"], x["term"], x["freq"], x["distance"]) for x in fuzzy.lookup(frame(spark, [*queries, "", None]), held, k, strategy).collect()}
    assert got == {(q, t, i, osa(q, t)) for q in queries for i, t in enumerate(terms) if osa(q, t) <= k}


def test_single_edits(spark):
    for term, query, k, expected in SINGLE_EDITS:
        held = fuzzy.FuzzyDictionary(corpus.word_list(spark, [term]))
        assert held.lookup(query, 0).isEmpty()
        assert held.lookup(query, k).isEmpty() is not expected, (term, query)
        held.close()


def test_totals_matches_and_best(spark, small):
    terms, held = small
    words, queries = fuzzy.FuzzyDictionary(held), ["abcd", "zzzzzzzz", "longerword", "abdc"]
    totals = {x["k"]: x["total"] for x in words.totals(frame(spark, queries), (0, 1, 2)).collect()}
    assert totals == {k: sum(osa(q, t) <= k for q in queries for t in terms) for k in (0, 1, 2)}
    near = {q for q in queries if any(osa(q, t) <= 1 for t in terms)}
    assert {x[0] for x in words.matched(frame(spark, queries), 1).collect()} == near
    assert {x[0] for x in words.unmatched(frame(spark, queries), 1).collect()} == set(queries) - near
    for x in words.best(frame(spark, queries), 2).collect():
        assert (x["distance"], -x["freq"], x["term"]) == min((osa(x["query"], t), -i, t) for i, t in enumerate(terms))


def test_empty_sides_and_bad_arguments(spark, small):
    none = spark.createDataFrame([], corpus.DICTIONARY)
    for k in (0, 1, 2):
        assert fuzzy.lookup(frame(spark, ["a"]), none, k).isEmpty()
        assert fuzzy.lookup(frame(spark, []), small[1], k).isEmpty()
    with pytest.raises(ValueError, match="unknown"):
        fuzzy.lookup(frame(spark, ["a"]), none, -1)


def test_corpus_and_workload_lines(spark):
    lines = [("a 1",), ("b 2 3",), ("c",), ("d -1",), ("e x",), ("a 4",), (" 5",), ("f 99999999999999999999",), ("g 007",), (None,), ("",), ("te the 1",), ("x\ty\t2",)]
    raw = spark.createDataFrame(lines, "value string")
    assert {tuple(x) for x in corpus.merged(corpus.corpus_lines(raw)).collect()} == {("a", 5), ("g", 7)}
    assert {tuple(x) for x in corpus.workload_lines(raw).collect()} == {("te", "the", 1), ("x", "y", 2), ("b", "2", 3)}


def test_order_violations(spark):
    rows = [(1, i, w) for i, w in enumerate(["a", "b", "b", "a", "c"])] + [(2, 0, "z"), (2, 1, "")]
    got = {tuple(x) for x in corpus.order_violations(spark.createDataFrame(rows, "list_id int, pos int, term string")).collect()}
    assert got == {(1, 2, "b", "b"), (1, 3, "a", "b"), (2, 1, "", "z")}


def test_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("cat 3\ndog 5\nbad line here\n")
    (tmp_path / "q.txt").write_text("# header\ncta cat 1\n")
    words = fuzzy.FuzzyDictionary(corpus.read_corpus(spark, str(tmp_path / "d.txt")))
    queries = corpus.read_workload(spark, str(tmp_path / "q.txt")).selectExpr("noisy as query")
    assert [tuple(x) for x in words.lookup(queries, 1).collect()] == [("cta", "cat", 3, 1)] and words.word_count == 2
