import random

import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from lexmatch.llm import near_copies
from tests.llm.test_near_copies import roots


def words_of(text):
    own = text.encode().lower().split() if text else []
    return {b" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def texts():
    """Short and long texts with up to a fifth of their shingles changed and with more, in classes that chain, and one large class."""
    r = random.Random(8)
    out = [None, "", " \n ", "one two", "One two", "one two three"]
    for n in [4, 6, 12, 30, 90, 300] * 8:
        base = [f"w{r.randrange(400)}" for _ in range(n)]
        out.append(" ".join(base))
        for _ in range(r.randrange(5)):
            base = list(base)
            for _ in range(r.randint(1, max(1, n // 25))):
                base[r.randrange(n)] = f"v{r.randrange(10**6)}"
            out.append(" ".join(base))
    large = [f"z{i}" for i in range(120)]
    for i in range(150):
        copy = list(large)
        copy[r.randrange(120)] = f"y{i}"
        out.append(" ".join(copy))
    return out


def test_linked_equals_brute_force():
    sets = [words_of(t) for t in texts()]
    want = roots(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and similar(sets[i], sets[j])])
    own = [near_copies.shingles(t) for t in texts()]
    full = [i for i, x in enumerate(own) if len(x)]
    got = near_copies.linked([own[i] for i in full])
    assert [full[x] for x in got] == [want[i] for i in full] and len(set(want)) < len(sets) - 150


def slow_fingerprints(text):
    """Six fingerprints of a text's words by their definition, with a word's weight the bits of its count."""
    words = text.encode().lower().split() if text else []
    out, mask = [], (1 << 64) - 1
    for family in range(1, 7):
        ones = [0] * 64
        for w in set(words):
            x = xxh64_intdigest(w, 42) + family * 0x9E3779B97F4A7C15 & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            x ^= x >> 31
            for b in range(64):
                ones[b] += (1 if x >> b & 1 else -1) * len(bin(words.count(w))[2:])
        out.append(sum(1 << b for b in range(64) if ones[b] > 0))
    return out if words else []


def brute_classes(texts):
    """The first text of each one's class: links are similar pairs within a group that fingerprints chain."""
    sets, fps = [words_of(t) for t in texts], [slow_fingerprints(t) for t in texts]
    near = lambda i, j: any((a ^ b).bit_count() <= 4 for a in fps[i] for b in fps[j])
    groups = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or near(i, j)])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    proposed = [(i, j) for i, j in pairs if groups[i] == groups[j]]
    return roots(len(texts), proposed), len(proposed), len(pairs)


@pytest.mark.parametrize("block", [near_copies.BLOCK, 900])
def test_classes_equal_brute_force(spark, block):
    rows = [(i, t) for i, t in enumerate(texts())]
    up, proposed, pairs = brute_classes([t for _, t in rows])
    assert proposed >= 0.97 * pairs
    random.Random(1).shuffle(rows)
    got = near_copies.representatives(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert sorted(x["doc_id"] for x in got) == sorted(set(up)) and all(x["text"] == dict(rows)[x["doc_id"]] for x in got)


def test_fingerprints():
    for t in texts()[::5] + ["long text " * 9000 + " ".join(f"w{i}" for i in range(20_000))]:
        if not t or len(t) < 5000:
            assert near_copies.word_fingerprints(t) == slow_fingerprints(t)
        assert len(near_copies.word_fingerprints(t)) == (6 if t and t.strip() else 0)


def test_stage_over_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect())
    sets = [words_of(t) for _, t in rows]
    up = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.dtypes == docs.dtypes and {x["doc_id"] for x in got.collect()} == {rows[i][0] for i in set(up)}


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "A b c d e"), (5, "other words are here now"), (None, "nobody has an id here"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(x) for x in near_copies.representatives(docs).collect()]
    assert len(kept) == 4 and (9, None) in kept and (5, "other words are here now") in kept and (None, "nobody has an id here") in kept
    assert near_copies.representatives(docs.where("false")).isEmpty()


def test_representatives_keep_rows_whole(spark):
    rows = [(3, "x y z w", "row", 1), (2, "x y z w", "c0", 2), (2, "x y z w", "c0", 2), (4, "quite another text", "fp", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, fp int")
    assert sorted(map(tuple, near_copies.representatives(docs).collect())) == [(2, "x y z w", "c0", 2), (4, "quite another text", "fp", 3)]
