import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmatch.operators import automaton, fuzzy, layout, ordering
from lexmatch.plans.stages import written
from lexmatch.sources import corpus, export, store
from tests.test_functions import word

DICTIONARIES = {
    "merging": {"tap": 1, "taps": 4, "top": 2, "tops": 8, "a": 0, "at": 1024},
    "one": {"x": 5},
    "random": {word(random.Random(i), 6, "abC") or "c": i * i for i in range(120)},
}


def languages(words):
    found = {}
    for w in words:
        for i in range(len(w) + 1):
            found.setdefault(w[:i], set()).add(w[i:])
    return {p: frozenset(s) for p, s in found.items()}


@pytest.fixture(params=DICTIONARIES, scope="module")
def case(request, spark):
    words = DICTIONARIES[request.param]
    held = written(spark.createDataFrame([*words.items()], corpus.DICTIONARY), "dictionary")
    return words, held, automaton.Automaton(held, keep=written)


def named(words):
    """The state of each prefix, named by its shortest, then first, prefix."""
    right = languages(words)
    name = {}
    for p in sorted(right, key=lambda p: (len(p), p)):
        name.setdefault(right[p], p)
    return {p: name[s] for p, s in right.items()}, right


def test_states_and_edges(case):
    words, _, found = case
    state, right = named(words)
    got = {tuple(x) for x in found.states.select("state", "is_terminal", "reachable", "level").collect()}
    assert got == {(s, "" in right[s], len(right[s]), max(len(p) for p in state if state[p] == s)) for s in set(state.values())}
    weights = {}
    for w, n in words.items():
        for i in range(len(w)):
            step = (state[w[:i]], w[i], state[w[: i + 1]])
            weights[step] = weights.get(step, 0) + n
    assert {(x["src"], x["label"], x["dst"]): x["weight"] for x in found.edges().collect()} == weights
    stats = found.stats().first()
    assert (stats["n_trie_nodes"], stats["n_states"], stats["n_edges"]) == (len(state), len(set(state.values())), len(weights))


def scores(words):
    state, right = named(words)
    own = {}
    for w, n in words.items():
        own[state[w]] = own.get(state[w], 0) + (n.bit_length() - 1 if n else 0)
    return state, own, {s: sum(own[state[s + r]] for r in right[s]) for s in set(state.values())}


def test_word_index_is_depth_first_by_score(spark, case):
    words, held, found = case
    state, own, score = scores(words)
    assert {x["state"]: (x["own_score"], x["score"]) for x in found.scores().collect()} == {s: (own.get(s, 0), score[s]) for s in score}
    order = sorted(words, key=lambda w: [(-score[state[w[: i + 1]]], w[i]) for i in range(len(w))])
    ranks = ordering.word_index(held, found)
    assert {x["term"]: x["idx"] for x in ranks.collect()} == {w: i for i, w in enumerate(order)}
    facade = fuzzy.FuzzyDictionary(held)
    asked = spark.createDataFrame([(w,) for w in [*order, "", "nope"]], "query string")
    assert {x["query"]: x["idx"] for x in facade.get_index(asked).collect()} == {w: i for i, w in enumerate(order)} | {"": -1, "nope": -1}
    back = facade.get_word(spark.createDataFrame([(i,) for i in range(-1, len(order) + 1)], "idx bigint"))
    assert {x["idx"]: x["term"] for x in back.collect()} == dict(enumerate(order))


def breadth_first(words):
    """Kahn's order from the root with a queue, children by label."""
    state, _ = named(words)
    edges = {}
    for p in state:
        if p:
            edges.setdefault(state[p[:-1]], {})[p[-1]] = state[p]
    waiting = {}
    for children in edges.values():
        for s in children.values():
            waiting[s] = waiting.get(s, 0) + 1
    queue = [""]
    for s in queue:
        for _, child in sorted(edges.get(s, {}).items()):
            waiting[child] -= 1
            if not waiting[child]:
                queue.append(child)
    return queue


def test_topological_order_and_compressed_rows(case):
    words, _, found = case
    order = breadth_first(words)
    rows = ordering.CompressedRows(found)
    assert [x["state"] for x in rows.order.orderBy("order_id").collect()] == order
    assert sorted(map(tuple, ordering.topological(found, one_task=0).collect())) == sorted(map(tuple, rows.order.select("state", "level", "order_id").collect()))
    edges, nodes = rows.edges.orderBy("edge_id").collect(), rows.nodes().orderBy("order_id").collect()
    assert [x["edge_id"] for x in edges] == [*range(len(edges))] and all(x["src_order"] < x["dst_order"] for x in edges)
    first = 0
    for n in nodes:
        own = [x for x in edges if x["src_order"] == n["order_id"]]
        assert (n["first_edge"], n["degree"]) == (first, len(own)) and all(x["edge_id"] >= first for x in own)
        first += len(own)
    deltas = ordering.delta_offsets(rows.nodes()).orderBy("order_id").collect()
    assert [sum(x["delta"] for x in deltas[: i + 1]) for i in range(len(deltas))] == [x["first_edge"] for x in nodes]


def test_layout_costs_and_arrange(spark, case):
    _, _, found = case
    rows = ordering.CompressedRows(found)
    edges, n = [tuple(x) for x in rows.edges.select("src_order", "dst_order", "label", "weight").collect()], rows.order.count()
    assert layout.arrangement_cost(rows.edges).first()[0] == sum(abs(a - b) * w for a, b, _, w in edges)
    assert layout.cache_arrangement_cost(rows.edges, 2).first()[0] == sum(w for a, b, _, w in edges if a // 2 != b // 2)
    places = [*range(n)]
    random.Random(5).shuffle(places)
    to = spark.createDataFrame([(p, i) for i, p in enumerate(places)], "position bigint, node_id bigint")
    moved = layout.arrange(rows.edges, layout.checked(to, n))
    assert sorted(map(tuple, moved.collect())) == sorted((places[a], places[b], c, w) for a, b, c, w in edges)
    with pytest.raises(ValueError, match="permutation"):
        layout.checked(to.where("position > 0"), n)
    sums = {}
    for a, b, _, w in edges:
        for key in ((a, b), (b, a)):
            sums[key] = sums.get(key, 0) + w
    assert {(x["a"], x["b"]): x["weight"] for x in layout.undirected(rows.edges).collect()} == sums


def test_searches_never_cost_more(spark):
    held = written(spark.createDataFrame([*DICTIONARIES["random"].items()], corpus.DICTIONARY), "dictionary")
    rows = ordering.CompressedRows(automaton.Automaton(held, keep=written))
    nodes, edges = written(rows.nodes(), "nodes"), rows.edges
    n = nodes.count()
    for kind, cost in (("ordering", layout.arrangement_cost), ("topological", layout.arrangement_cost), ("cache", layout.cache_arrangement_cost), ("topological_cache", layout.cache_arrangement_cost)):
        found = written(layout.annealed(nodes, edges, kind, 2, 0.01, 0.99, 1e-6), "found")
        best = layout.checked(layout.best_arrangement(found), n)
        after = layout.arrange(edges, best)
        row = found.orderBy("cost_after", "seed").first()
        assert row["cost_before"] == cost(edges).first()[0] and row["cost_after"] == cost(after).first()[0] <= row["cost_before"]
        if kind.startswith("topological"):
            assert after.where("src_order >= dst_order").isEmpty()
    assert layout.checked(layout.spectral(nodes, edges), n).count() == n


def test_spectral_order_of_a_path_is_the_path(spark):
    n, r = 12, random.Random(2)
    names = [*range(n)]
    r.shuffle(names)
    edges = spark.createDataFrame([(names[i], names[i + 1], "a", 1) for i in range(n - 1)], "src_order bigint, dst_order bigint, label string, weight bigint")
    nodes = spark.createDataFrame([(i, False) for i in range(n)], "order_id bigint, is_terminal boolean")
    order = [x["node_id"] for x in layout.spectral(nodes, edges).orderBy("position").collect()]
    assert order in (names, names[::-1])


def test_coarsening(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (2, 5)], "src bigint, dst bigint")
    fixed = spark.createDataFrame([(0,), (1,), (2,)], "node bigint")
    # 4 has one parent, so its child 5 moves to 3; then 5 has two parents and stays
    assert {tuple(x) for x in layout.coarsen(edges, fixed, 1).collect()} == {(0, 1), (0, 2), (1, 3), (2, 3), (3, 5), (2, 5)}
    assert {tuple(x) for x in layout.coarsen(edges, fixed, 9).collect()} == {(0, 1), (0, 2)}
    assert [x["n_edges"] for x in layout.shrunk(edges, fixed, range(1, 3)).orderBy("coarse").collect()] == [6, 2]


def test_store_and_export(spark, tmp_path, case):
    words, held, found = case
    rows, ranks = ordering.CompressedRows(found), ordering.word_index(held, found)
    store.save(str(tmp_path / "i"), dictionary=ranks, nodes=rows.nodes(), edges=rows.edges)
    back = store.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, back["dictionary"].collect())) == sorted(map(tuple, ranks.collect()))
    data = store.export_file(rows.nodes(), rows.edges, ranks)
    parsed = store.parse_file(data)
    assert parsed["counts"] == [x["freq"] for x in ranks.orderBy("idx").collect()] and len(parsed["targets"]) == rows.edges.count() == len(parsed["labels"])
    (tmp_path / "f.bin").write_bytes(data)
    store.write_file(spark, str(tmp_path / "g.bin"), data)
    assert (tmp_path / "g.bin").read_bytes() == data
    assert sorted(map(tuple, store.import_dictionary(spark, str(tmp_path / "g.bin")).drop("path").collect())) == sorted(map(tuple, ranks.collect()))
    assert sorted(map(tuple, store.import_nodes(spark, str(tmp_path / "g.bin")).drop("path").collect())) == sorted(map(tuple, rows.nodes().drop("is_terminal").collect()))
    read = store.import_files(spark, str(tmp_path / "f.bin"))
    assert sorted(map(tuple, read.select("edge_id", "order_id", "dst_order", "label").collect())) == sorted(map(tuple, rows.edges.select("edge_id", "src_order", "dst_order", "label").collect()))
    export.write_d3(rows.order, rows.edges, str(tmp_path / "d3"))
    assert spark.read.json(str(tmp_path / "d3/nodes")).count() == rows.order.count()
    assert spark.read.json(str(tmp_path / "d3/links")).count() == rows.edges.select("src_order", "dst_order").distinct().count()


def test_empty_dictionary(spark):
    found = automaton.Automaton(spark.createDataFrame([], corpus.DICTIONARY), keep=written)
    assert found.states.isEmpty() and found.edges().isEmpty() and ordering.word_index(found.dictionary, found).isEmpty() and ordering.topological(found).isEmpty()
    assert found.stats().first()["n_states"] == 0
    assert layout.arrangement_cost(spark.createDataFrame([], "src_order bigint, dst_order bigint, label string, weight bigint")).first()["cost"] == 0


def test_running_sum(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = [x["s"] for x in ordering.running(df, "id", "v", "s").orderBy("id").collect()]
    assert got == [sum(i % 7 for i in range(k)) for k in range(1000)]


@pytest.mark.parametrize("dense", [1000, 1])
def test_fiedler_vector_of_a_weighted_automaton(spark, dense):
    """Weights that are word frequencies: the largest degree dwarfs the gap between the eigenvalues."""
    r = random.Random(5)
    words = [("".join(r.choice("abcde") for _ in range(r.randint(2, 7))), 10 ** r.randint(0, 4)) for _ in range(60)]
    rows = ordering.CompressedRows(automaton.Automaton(spark.createDataFrame(sorted(dict(words).items()), "term string, freq long")))
    edges, n = rows.edges.toPandas(), rows.order.count()
    src, dst, w = (edges[c].to_numpy(np.int64) for c in ("src_order", "dst_order", "weight"))
    laplacian = np.zeros((n, n))
    for i, j, x in zip(src, dst, w):
        laplacian[[i, j], [i, j]] += x
        laplacian[[i, j], [j, i]] -= x
    values, vectors = np.linalg.eigh(laplacian)
    assert n > 40 and w.min() >= 1 and values[2] > 1.01 * values[1] and values[-1] > 1000 * values[1]
    for seed in (1, 2, 3):
        x = layout.fiedler(n, src, dst, w, seed=seed, dense=dense)
        assert abs(x @ vectors[:, 1]) > 1 - 1e-9 and x[np.flatnonzero(np.abs(x) > 1e-9)[0]] < 0


def test_fiedler_vector_fails_loudly_or_tells_parts():
    src = np.arange(2999)
    with pytest.raises(ArithmeticError, match="did not converge"):
        layout.fiedler(3000, src, src + 1, np.ones(2999, np.int64), space=2, rounds=5)
    path = layout.fiedler(3000, src, src + 1, np.ones(2999, np.int64))
    assert (np.diff(path) > 0).all()
    assert (layout.fiedler(5, np.array([0, 2]), np.array([1, 3]), np.array([1, 1])) < 0).tolist() == [True, True, False, False, False]
    assert layout.fiedler(1, src[:0], src[:0], src[:0]).tolist() == [0]


@pytest.mark.parametrize("down", [False, True])
def test_coarsening_in_one_task_and_round_by_round(spark, down):
    r = random.Random(4)
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(75)})
    edges, fixed = spark.createDataFrame([(a * 7, b * 7) for a, b in pairs], "src bigint, dst bigint"), spark.createDataFrame([(0,), (7,), (999,)], "node bigint")
    for degree in (1, 2):
        one, many = (sorted(map(tuple, layout.coarsen(edges, fixed, degree, down, n).collect())) for n in (100, 0))
        assert one == many and 0 < len(one) < len(pairs)
    assert sorted(map(tuple, layout.shrunk(edges, fixed, range(1, 3), down).collect())) == sorted(map(tuple, layout.shrunk(edges, fixed, range(1, 3), down, 0).collect()))
    none = edges.where("false")
    assert layout.coarsen(none, fixed, 1, down).isEmpty() and layout.shrunk(none, fixed, range(1, 2), down).first()["n_nodes"] == 3


def test_words_are_ranked_without_being_sorted(spark, case):
    _, held, found = case
    plan = ordering.word_index(held, found)
    assert sorted(x["idx"] for x in plan.collect()) == [*range(held.count())]
    assert found.scores() is found.scores()


def test_a_topological_search_draws_pairs_at_once_as_one_by_one():
    r = random.Random(8)
    pairs = np.array(sorted({tuple(sorted(r.sample(range(150), 2))) for _ in range(260)}))
    make = lambda: layout.Problem(150, pairs[:, 0], pairs[:, 1], np.arange(len(pairs)) % 9, np.arange(150) % 3 == 0, np.random.default_rng(2), topological=True)
    fast, slow = make(), make()
    slow.kept = False
    for found in (fast, slow):
        layout.anneal(found, *layout.schedule("topological", 3000))
    assert fast.kept and (fast.order == slow.order).all() and (fast.order != np.arange(150)).sum() > 50
    assert fast.random.bit_generator.state == slow.random.bit_generator.state
    assert all(fast.low[a] == min([fast.place[y] for x, y in pairs if x == a], default=150) and fast.high[a] == max([fast.place[x] for x, y in pairs if y == a], default=-1) for a in range(150))
    slow.random = np.random.default_rng(0)
    assert layout.Problem(3, np.array([0, 1]), np.array([1, 2]), np.ones(2, int), np.zeros(3, bool), slow.random, topological=True).move(70)[2] == float("inf")
