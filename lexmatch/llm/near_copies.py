"""Near-copies: the covering tables of SimHash propose, the Jaccard similarity of five-word shingles decides.

Edits change few words, so a text's fingerprints here are of its words, weighted by the bits of their counts: two texts of similarity
0.8 then differ in about 4 of 64 bits. There are FAMILIES fingerprints with different seeds; a pair is proposed if any of them are
within simhash's radius, which the covering tables find without exception. Proposed texts form groups, and within each group all sets
of shingles are compared: two texts are linked if the shingles in both are at least 0.8 of those in either. Nothing below that is
linked, and a group is not a link.

A group of any size is compared in blocks of bounded size, each pair of blocks in a task of its own that gives a spanning forest of
its links. So memory is bounded, and a group's tasks can run on all machines; its texts are sent once for each of its blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmatch.llm import _common, simhash
from lexmatch.llm.components import components

WORDS, SEED, FAMILIES = 5, 42, 6
LEAST = (4, 5)  #: similarity that links, as a fraction
BLOCK = 1 << 18  #: shingles of a block of a group, 2 MB
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_CHUNK = 1 << 13


def _words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles' XXH64 values, sorted. No words: none. Fewer than `words`: one shingle."""
    from xxhash import xxh64_intdigest

    own = _words(text)
    n = max(1, len(own) - words + 1) if own else 0
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(own[i : i + words]), SEED) for i in range(n)), np.uint64, n))


def word_fingerprints(text: str | None) -> list[int]:
    """FAMILIES fingerprints: a bit is set if the words that have it hold over half of the weight. No words: none."""
    from xxhash import xxh64_intdigest

    counts = Counter(_words(text))
    if not counts:
        return []
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in counts), np.uint64, len(counts))
    weights = np.fromiter((n.bit_length() for n in counts.values()), np.int64, len(counts))
    out = []
    for family in range(1, FAMILIES + 1):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _CHUNK):
            x = hashes[at : at + _CHUNK] + np.uint64(family * 0x9E3779B97F4A7C15 % (1 << 64))  # another hash of a word by each family
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            bits = np.unpackbits((x ^ x >> np.uint64(31)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += weights[at : at + _CHUNK] @ bits
        out.append(int.from_bytes(np.packbits(2 * ones > weights.sum()).tobytes(), "big"))
    return out


def linked(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> np.ndarray:
    """For each set the number of the first one of its component, over all pairs whose similarity is `least` or more.

    Sets this similar share one of their rarest shingles, as many as may be missing and one more. Each search goes from one set outward;
    those it has found leave the lists, so a large class is not compared pair by pair.
    """
    num, den = least
    sizes = np.array([len(x) for x in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    own = [np.sort(x) for x in np.split(rank[inverse], np.cumsum(sizes)[:-1])]
    rare = [x[: len(x) - -(-num * len(x) // den) + 1] for x in own]
    shingle, holder = np.concatenate(rare), np.repeat(np.arange(len(sets)), [len(x) for x in rare])
    by = np.argsort(shingle, kind="stable")
    shingle, holder = shingle[by], holder[by]
    first, alive, marked, gone = np.arange(len(sets)), np.ones(len(sets), bool), np.zeros(len(counts), bool), 0
    for i in range(len(sets)):
        if not alive[i]:
            continue
        alive[i], front = False, [i]
        gone += len(rare[i])
        while front:
            if 2 * gone > len(holder):
                kept = alive[holder]
                shingle, holder, gone = shingle[kept], holder[kept], 0
            x = front.pop()
            starts, ends = np.searchsorted(shingle, rare[x]), np.searchsorted(shingle, rare[x], "right")
            near = [holder[a:b] for a, b in zip(starts, ends) if a < b]
            if not near:
                continue
            near = np.unique(np.concatenate(near))
            near = near[alive[near] & (num * sizes[near] <= den * sizes[x]) & (num * sizes[x] <= den * sizes[near])]
            marked[own[x]] = True
            for y in near:
                both = np.count_nonzero(marked[own[y]])
                if den * both >= num * (sizes[x] + sizes[y] - both):
                    first[y], alive[y] = i, False
                    gone += len(rare[y])
                    front.append(y)
            marked[own[x]] = False
    return first


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        keys, sizes, fps = [], [], []
        for x in batch.column(3):
            text = x.as_py()
            values = shingles(text)
            keys.append(xxh3_128_digest(values.tobytes()))
            sizes.append(len(values))
            fps.append(np.array(word_fingerprints(text), np.uint64).view(np.int64))
        made = [*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(made, names=["row", "doc_id", "key", "same", "n", "fps"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = pa.array([shingles(x.as_py()).view(np.int64) for x in batch.column(4)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], values], names=["root", "item", "blocks", "block", "own"])


def _forest(group: pa.Table) -> pa.Table:
    item, own = group["item"].to_numpy(), group["own"].combine_chunks()
    flat, at = own.flatten().to_numpy().view(np.uint64), np.cumsum(own.value_lengths().to_numpy())
    first = linked(np.split(flat, at[:-1]))
    some = np.flatnonzero(first != np.arange(len(first)))
    return pa.table({"a": item[some], "b": item[first[some]]})


def groups(items: DataFrame) -> DataFrame:
    """(item, root): proposed groups of items (item long, fps array<long>), by fingerprints that are equal or within simhash's radius."""
    of, path = _common.materialize(items.select("item", F.explode("fps").alias("fp")), "item-fingerprints")
    values, at = _common.materialize(of.groupBy("fp").agg(F.count("*").alias("n")), "values")
    near, _ = _common.materialize(simhash.links(values.select("fp")), "near")
    # fingerprints and items are nodes of one graph; a chance clash of their numbers could only propose more
    active = near.select(F.col("a").alias("fp")).union(near.select("b")).union(values.where("n > 1").select("fp")).distinct()
    edges = of.join(active.hint("merge"), "fp").select(F.col("item").alias("a"), F.col("fp").alias("b")).unionByName(near)
    found, _ = _common.materialize(components(edges).withColumnRenamed("node", "item"), "groups")
    for done in (path, at):
        _common.discard(items.sparkSession, done)
    return found.unionByName(found.select(F.col("root").alias("item"), "root").distinct())


def confirmed(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all links among items of a group; members: (root, item, n shingles, text)."""
    sizes, _ = _common.materialize(members.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("texts")).where("texts > 1"), "sizes")  # so a large group can be split in the join
    blocks = F.ceil(F.col("total") / block).cast("int")
    dealt = members.join(sizes.hint("merge"), "root").select("root", "item", blocks.alias("blocks"), F.pmod(F.xxhash64("item"), blocks).cast("int").alias("block"), "text")
    sets = dealt.mapInArrow(_sets, "root long, item long, blocks int, block int, own array<long>")
    # a block meets each other one once; a block alone meets itself
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
    pairs = sets.select("root", "item", "block", F.explode(others).alias("other"), "own")
    pairs = pairs.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "item", "own")
    # dealt by all three, as a group's tasks would else stay together where its root was joined
    return pairs.repartition("root", "i", "j").groupBy("root", "i", "j").applyInArrow(lambda group: _forest(group.select(["item", "own"])), "a long, b long")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row of docs, with all its columns, for each class of linked rows: that with the smallest id.

    Texts with the same set of shingles are one item before the tables; null, empty and wordless texts are copies of each other. Rows
    that share the smallest id give the one with the smallest digest of its text, and of exact repeats one row stays. A null id comes
    after all others. docs is written first with a number for each row, so all readers see the same numbers.
    """
    spark = docs.sparkSession
    named = [F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(docs.columns)]
    held, _ = _common.materialize(docs.select(F.monotonically_increasing_id().alias("row"), *named), "rows")
    text = F.coalesce(F.col(f"c{docs.columns.index(text_col)}").cast("string"), F.lit(""))
    own = held.select("row", F.col(f"c{docs.columns.index(id_col)}").cast("long").alias("doc_id"), F.md5(text).alias("key"), text.alias("text"))
    # an item's first row: least over the item, then over the class; both sums are partial before they move
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "row", "n", "fps")
    made = own.mapInArrow(_sketches, "row long, doc_id long, key string, same binary, n long, fps array<long>")
    items, of_items = _common.materialize(made.groupBy("same").agg(F.min(order).alias("best")).select("best", F.col("best.row").alias("item")), "items")
    found = groups(items.select("item", "best.fps"))
    # sort-merge joins at every size: broadcasts would only do for few rows, and so make small inputs look cheaper than they scale
    members = items.select("item", "best.n").join(found.hint("merge"), "item")
    members, of_members = _common.materialize(held.select(F.col("row").alias("item"), text.alias("text")).join(members.hint("merge"), "item").select("root", "item", "n", "text"), "members")
    edges, of_edges = _common.materialize(confirmed(members, block), "edges")
    roots = components(edges).withColumnRenamed("node", "item")
    best = items.select("item", F.struct("best.last", "best.doc_id", "best.key", "best.row").alias("best")).join(roots.hint("merge"), "item", "left").groupBy(F.coalesce("root", "item").alias("root")).agg(F.min("best").alias("best"))
    chosen, _ = _common.materialize(best.select(F.col("best.row").alias("row")), "chosen")
    for done in (of_items, of_members, of_edges):
        _common.discard(spark, done)
    kept = held.join(chosen.hint("merge"), "row", "left_semi")
    return kept.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)])
