import random
from pathlib import Path

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from lexmatch.llm import _common, simhash
from lexmatch.llm.components import components


def roots(n, edges):
    up = [*range(n)]

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("kind", ["random", "path", "star", "cliques"])
def test_components(spark, kind):
    r, n = random.Random(kind), 300
    names = [*range(n)]
    r.shuffle(names)
    edges = {
        "random": [(r.randrange(n), r.randrange(n)) for _ in range(180)],
        "path": [(names[i], names[i + 1]) for i in range(n - 1)],
        "star": [(names[0], x) for x in names[1:]],
        "cliques": [(a, b) for g in range(0, n, 10) for a in range(g, g + 10) for b in range(g, a)],
    }[kind]
    rows = [*edges, *edges[:5], (7, 7), (None, 3)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: x for i, x in enumerate(roots(n, edges)) if i != x}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


@pytest.mark.parametrize("radius", range(7))
def test_masks_cover_every_pair(radius):
    r, family = random.Random(radius), simhash.masks(radius)
    assert len(family) == (2 << radius) - 1
    for _ in range(3000):
        differ = sum(1 << i for i in r.sample(range(64), radius))
        assert any(not differ & m for m in family)
    with pytest.raises(ValueError, match="radius"):
        simhash.masks(7)


def slow_fingerprint(text, words=4):
    own = text.encode().lower().split() if text else []
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    h = [xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def texts():
    r = random.Random(4)
    base = [" ".join(r.choice("the of And river Stone é blue ran x y z".split()) for _ in range(r.choice([0, 1, 3, 5, 40, 400]))) for _ in range(60)]
    out = []
    for t in base:
        out.append(t)
        words = t.split()
        for _ in range(r.randint(0, 3)):
            if words:
                copy = list(words)
                copy[r.randrange(len(copy))] = "changed"
                out.append("\t".join(copy) if r.random() < 0.3 else " ".join(copy))
    return [*out, None, "", " \n ", *[base[-1]] * 30, "long " * 70_000]


@pytest.mark.parametrize("bucket", [4096, 1])
def test_clusters_equal_brute_force(spark, bucket):
    rows = [(i, t, 0) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    f = [slow_fingerprint(t) for _, t, _ in rows]
    for radius in (2, 4):
        want = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= radius])
        got = {x["doc_id"]: (x["fp"] % (1 << 64), x["component_id"]) for x in simhash.cluster(docs, radius=radius, bucket=bucket).collect()}
        assert got == {i: (f[i], want[i]) for i in range(len(rows))}


def test_a_dense_ball_is_one_class(spark):
    """Many different fingerprints near one: every bucket of its tables is over the limit."""
    r = random.Random(1)
    centre = r.getrandbits(64)
    ball = {centre} | {centre ^ sum(1 << i for i in r.sample(range(64), r.randint(1, 4))) for _ in range(900)}
    far = {r.getrandbits(64) for _ in range(100)}
    values = [x - (1 << 64) if x >> 63 else x for x in ball | far]
    got = components(simhash.links(spark.createDataFrame([(x,) for x in values], "fp long"), 4, 64)).collect()
    assert len({x["root"] for x in got}) == 1 and len(got) == len(ball) - 1


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "A b c d e"), (5, "other words are here now"), (None, "nobody has an id here"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"] or 0, x["component_id"] or 0) for x in simhash.cluster(docs).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5), (5, 5), (9, 9)]
    none = docs.where("false")
    assert simhash.cluster(none).isEmpty()


def test_forest_connects_what_pairs_do():
    r = np.random.default_rng(0)
    values = np.unique(r.integers(0, 1 << 12, 300).astype(np.uint64))
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 2]
    at = {int(x): i for i, x in enumerate(values)}
    edges = [(at[int(x)], at[int(y)]) for a, b in simhash._forest(values, 2) for x, y in zip(a, b)]
    assert len(edges) < len(values) and roots(len(values), edges) == roots(len(values), pairs)


@pytest.mark.parametrize("limit", [None, 9])
def test_files_follow_rows_not_partitions(spark, monkeypatch, limit):
    """Small tables at many partitions: on a local disk each file starts processes, which share an executor's memory until they run."""
    if limit:
        monkeypatch.setattr(_common, "FILE_ROWS", limit)
    write, files = _common.materialize, {}

    def counted(df, label):
        found, path = write(df, label)
        files[label] = max(files.get(label, 0), len(list(Path(path.removeprefix("file://")).glob("part-*"))))
        return found, path

    monkeypatch.setattr(_common, "materialize", counted)
    settings = {"spark.sql.shuffle.partitions": "41", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = [(i, t) for i, t in enumerate(texts())]
        f = [slow_fingerprint(t) for _, t in rows]
        want = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
        got = {x["doc_id"]: x["component_id"] for x in simhash.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == dict(enumerate(want))
    if limit:
        assert all(1 < files[k] <= -(-len(rows) // limit) for k in ("values", "classes"))
    else:
        assert {files[k] for k in ("values", "edges", "hooks", "classes")} == {1}
