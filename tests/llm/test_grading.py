import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexmatch.llm import grading as g
from lexmatch.llm import queries


def corpus(n, seed=0):
    """Texts of one vocabulary; some hold a bad word, some are junk. The grade is 2 less one for each."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(5, 300))]
        bad, junk = r.random() < 0.2, r.random() < 0.2
        if bad:
            words[r.randrange(len(words))] = r.choice(["awful", "nasty", "vile"])
        out.append((i, (" | " if junk else " ").join(words), 2 - bad - junk))
    return out


def test_held_out_accuracy():
    rows = corpus(3000)
    model = g.fit([(g.features(t), y) for _, t, y in rows[:2400]])
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    right = kept = clean = caught = 0
    for _, t, y in rows[2400:]:
        tails = model.tails(g.features(t))
        assert 1 >= tails[0] >= tails[1] >= 0 and 0 <= model.expected(tails) <= 2
        right += round(model.expected(tails)) == y
        clean += y == 2
        kept += y == 2 and tails[-1] >= g.THRESHOLD
        caught += y < 2 and tails[-1] < g.THRESHOLD
    assert right >= 0.93 * 600 and kept >= 0.98 * clean and caught >= 0.95 * (600 - clean)


def test_gradient_lowers_the_loss():
    rows = [(g.features(t), y) for _, t, y in corpus(400)]
    loss = lambda m: -sum(np.log(max(1e-9, np.diff([0, *sorted(1 - x for x in m.tails(p)), 1])[y])) for p, y in rows) / len(rows)
    assert loss(g.fit(rows, 0)) > 2 * loss(g.fit(rows, 5))


def test_features():
    assert len(g.features(None)) == len(g.features("")) == len(g.features(" \n\t")) == 0
    a, b = g.features("Some words here"), g.features("some WORDS here")
    assert set(a) & set(b) and (np.diff(a) > 0).all() and a.dtype == np.int32
    assert len(g.features("é日 " * 100_000)) < 100 and len(g.features("123 456")) > 0


def test_classify(spark):
    rows = corpus(800)
    docs = spark.createDataFrame([(i, t, "x", None) for i, t, _ in rows] + [(None, None, "x", None), (5, "", "x", None), (5, "", "x", None)], "doc_id long, text string, grade string, keep boolean")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (99_999, 0)], "doc_id long, grade int")
    first = g.classify(docs, labels)
    assert first.columns == ["doc_id", "text", "grade", "keep", "_grade", "_tail", "_keep"] and first.count() == 803
    assert sorted(map(str, first.collect())) == sorted(map(str, g.classify(docs.repartition(3), labels).collect()))
    assert all(x["_keep"] == (x["_tail"] >= g.THRESHOLD) for x in first.collect())
    assert len(g.rated(docs, labels, 50)) == 50 or len(g.rated(docs, labels, 50)) == 49  # one labelled id has no text
    none = g.classify(docs, labels.where("false")).collect()
    assert len(none) == 803 and all(x["_keep"] and x["_tail"] == 1 for x in none)
    assert g.classify(docs.where("false"), labels).isEmpty()


def test_one_grade_and_skipped_grades():
    p = g.features("words")
    assert g.fit([(p, 3)]).tails(p) == [] and g.fit([(p, 3)]).expected([]) == 3 and g.fit([]).expected([]) == 0
    model = g.fit([(g.features("low"), 1), (g.features("high"), 5)] * 50)
    assert model.grades == [1, 5] and model.expected(model.tails(g.features("high"))) > 4 > 2 > model.expected(model.tails(g.features("low")))


def test_quality_grade(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert [x["grade"] for x in g.quality_grade(labels).collect()] == [2, 0, 1, None]


def test_a_hot_id_takes_one_place_in_the_sample(spark):
    """A third of the rows share one id: every grade stays in the fit, and bad documents are still rejected."""
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, f"{rows[0][1]} {i % 7}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, rows[0][2])] * 300, "doc_id long, grade int")
    found = g.rated(docs, labels, 300)
    assert len(found) == 300 and {y for _, y in found} == {0, 1, 2}
    assert sum(any((p == g.features(t)).all() for t in (f"{rows[0][1]} {k}" for k in range(7)) if len(p) == len(g.features(t))) for p, _ in found) <= 1
    kept = {x["doc_id"]: x["_keep"] for x in g.classify(docs, labels, 600).where("doc_id > 0").collect()}
    bad = [i for i, _, y in rows[1:] if y < 2]
    assert sum(not kept[i] for i in bad) >= 0.9 * len(bad)


def test_one_grade_warns(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, grade int")
    with pytest.warns(UserWarning, match="one grade"):
        assert all(x["_keep"] for x in g.classify(docs, labels).collect())


def slow_features(text):
    """Places of a text's features by their definition, in plain Python."""
    at = lambda data, start=0: zlib.crc32(data.encode("utf-8", "surrogatepass"), start) % (1 << 20)
    if not text or text.isspace():
        return set()
    parts = re.findall(r"[^\W\d_]+|[^\w\s]{2,}|[|<>{}=*#$%&~^\\]", text)
    lower = [x.lower() for x in parts]
    counts = Counter()
    for w in set(lower):
        counts.update([at(w, 1), *(at(w[:k], 2) for k in range(4, min(7, len(w) - 1) + 1) if len(w) > 4)] if w[0].isalpha() else [at(f"s {w[:4]}"), at(f"s {w[:1]}")])
    out = set(counts) | {(p * 0x9E3779B1 + k) % (1 << 20) for p, c in counts.items() for k in (3, 8) if c >= k}
    n, lines = len(parts) or 1, text.split("\n")
    shares = {
        "repeats": sum(a == b for a, b in zip(lower, lower[1:])) / n, "symbols": 1 - sum(x.isalpha() for x in parts) / n, "capitals": sum(x.isupper() for x in parts) / n,
        "distinct": len(set(lower)) / n, "short lines": sum(len(x) < 20 for x in lines) / len(lines),
    }
    return out | {at(f"{k} {min(10, int(x * 20 + 0.999))}") for k, x in shares.items()}


def test_query_equals_brute_force(spark, sf_dir):
    """Every score of the query from the model's thresholds and weights by the cumulative-link formula, with features made in plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {x["doc_id"]: x["quality"] + 1 - x["toxic"] for x in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    model = g.fit([(np.array(sorted(slow_features(texts[i])), np.int32), y) for i, y in sorted(labels.items()) if i in texts])
    got = queries.op4_grading(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for x in got:
        f = sum(float(model.weights[p]) for p in slow_features(texts[x["doc_id"]]))
        below = [0.0, *(1 / (1 + math.exp(f - t)) for t in model.thresholds), 1.0]  # P(grade <= k)
        expected = sum(y * (b - a) for y, a, b in zip(model.grades, below, below[1:]))
        assert math.isclose(x["expected_grade"], expected, abs_tol=2e-5) and math.isclose(x["tail_probability"], 1 - below[-2], abs_tol=2e-5) and (x["keep"] == (x["tail_probability"] >= 0.7) or abs(x["tail_probability"] - 0.7) < 1e-5)


def test_fit_finds_the_thresholds_of_ratings_drawn_from_the_model():
    """An independent check of the fit: ratings drawn by a known cumulative-link model give back its tails."""
    r = np.random.default_rng(3)
    true_w, true_t = {5: 1.5, 6: -1.5, 7: 0.8}, [-1.0, 1.2]
    rows = []
    for _ in range(8000):
        places = np.array(sorted(p for p in true_w if r.random() < 0.5), np.int32)
        f = sum(true_w[int(p)] for p in places)
        u = r.random()
        rows.append((places, int(sum(u > 1 / (1 + math.exp(f - t)) for t in true_t))))
    model = g.fit(rows)
    for places in ([], [5], [6], [5, 7], [5, 6, 7]):
        f = sum(true_w[p] for p in places)
        want = [1 - 1 / (1 + math.exp(f - t)) for t in true_t]
        assert np.allclose(model.tails(np.array(places, np.int32)), want, atol=0.06)
