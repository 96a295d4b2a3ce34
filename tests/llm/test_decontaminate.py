import random
import re

import pytest

from lexmatch.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    own, hit, seen = plain_words(text), set(), set()
    for name, item in items:
        w = plain_words(item)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    seen.add(name)
    return len(own), len(hit), sorted(seen)


def case(seed, n=60, vocabulary="a b c d É Straße".split()):
    r = random.Random(seed)
    text = lambda k: r.choice(["", " ", "-"]).join([""] * 2) + r.choice([" ", "\n", "--"]).join(r.choice(vocabulary) for _ in range(r.randint(0, k)))
    return [(str(i), text(9)) for i in range(8)] + [("9", None), ("10", "...")], [(i, text(40)) for i in range(n)] + [(n, None), (n + 1, "")]


@pytest.mark.parametrize("window", [1, 2, 3, 5])
@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_equals_brute_force(spark, window, block_bytes):
    items, docs = case(window)
    bench = spark.createDataFrame([*items, *items[:3]], "item_id string, text string")
    table = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id int, text string, n_words int")
    got = d.find(table, bench, window, 0.05, block_bytes).collect()
    assert len(got) == len(docs) and got[0].__fields__[:3] == ["doc_id", "text", "n_words"]
    for x in got:
        n, hit, seen = brute(x["text"], [i for i in items if i[1]], window)
        assert (x["_n_words"], x["_n_hit"], x["_items"], x["_contaminated"]) == (n, hit, seen, hit > 0 and 20 * hit >= n), x


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id int, text string"), spark.createDataFrame([], "item_id int, text string")
    assert [tuple(x)[2:] for x in d.find(docs, none).collect()] == [(2, 0, [], False)]
    assert d.find(docs.where("false"), none).isEmpty()


def test_long_text_and_common_window(spark):
    items = [(str(i), "x y z " * 3 + f"w{i}") for i in range(50)]
    s = d.build(items, 5)
    n, spans, seen = d.search("q " * 50_000 + "x y z x y z " + "q " * 50_000, s)
    assert n == 100_006 and spans == [(50_000, 50_006)] and len(seen) == 50


def test_shares(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "one two three " + "x " * 57), (2, "one two three " + "x " * 58)], "doc_id int, text string")
    assert [x["_contaminated"] for x in d.find(docs, bench).orderBy("doc_id").collect()] == [True, False]


@pytest.mark.parametrize("bits", [4, 16])
def test_a_sieve_lets_every_text_with_a_hit_through(bits):
    for window in (1, 2, 5, 13):
        items, docs = case(window, 200, "a b c d e f g h É Straße".split())
        items = [(i, t) for i, t in items if t]
        tables, own = d.build(items, window), d.sieves([items[:4], items[4:]], window, bits)
        passed = [any(s.passes(d.words(t)) for s in own) for _, t in docs]
        assert all(p or not d.search(t, tables)[1] for p, (_, t) in zip(passed, docs))
        assert bits < 16 or window < 5 or not all(passed)
