"""SimHash fingerprints of word shingles and their exact links within a Hamming radius by covering locality-sensitive hashing.

Each of a fingerprint's 64 bits gets one of the non-zero vectors of radius + 1 bits, in the order of a maximal-length shift register. For every non-zero vector v there is a
table whose mask holds the bits whose vector has an odd product with v. Bits in which two fingerprints differ, radius at most, span
less than the whole space, so some v is orthogonal to all of their vectors: in its table the masked fingerprints are equal. All
2^(radius+1) - 1 tables together thus lose no pair.

Copies collapse to one fingerprint before the tables. Within a bucket only a spanning forest of the links is made, never all pairs.
Buckets of over `bucket` fingerprints are dealt anew by a second family of masks over the bits that are still free. Then about 15
bits are left, so no bucket there can have more than some ten thousand different fingerprints; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmatch.llm import _common
from lexmatch.llm.components import components

WORDS, RADIUS, SEED, BUCKET = 4, 4, 42, 4096
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_CHUNK = 1 << 16
#: Primitive polynomials over GF(2) of degree 1 to 7, whose powers of x run through all non-zero vectors.
_PRIMITIVE = (0b11, 0b111, 0b1011, 0b10011, 0b100101, 0b1000011, 0b10000011)
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("over", pa.int32())])


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits: one is set if over half of the shingles' XXH64 values have it. No words: zero. Fewer than `words`: one shingle."""
    from xxhash import xxh64_intdigest

    own = text.encode().translate(_LOWER).split() if text else []
    if not own:
        return 0
    n, ones = max(1, len(own) - words + 1), np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        some = [xxh64_intdigest(b" ".join(own[i : i + words]), seed) for i in range(at, min(n, at + _CHUNK))]
        bits = np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def masks(radius: int, bits: int = (1 << 64) - 1) -> list[int]:
    """Masks over the given bits of which each pair of values that differs in at most `radius` of them has one where it agrees."""
    size, family, vectors, x = radius + 1, [], {}, 1
    if radius not in range(len(_PRIMITIVE)):
        raise ValueError(f"radius {radius} is not in 0 to {len(_PRIMITIVE) - 1}")
    for p in (i for i in range(64) if bits >> i & 1):
        vectors[p] = x
        x <<= 1
        x ^= _PRIMITIVE[radius] if x >> size else 0
    for v in range(1, 1 << size):
        family.append(sum(1 << p for p, x in vectors.items() if (x & v).bit_count() & 1))
    return family


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """docs' columns (renamed c0, c1, ... in their order) without the text, and the column fp (long: the 64 bits)."""
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if i != at]
    plain = docs.select(*[F.col(f"`{docs.columns[i]}`").alias(f"c{i}") for i in kept], F.col(f"`{text_col}`").cast("string").alias("t"))
    fields = ", ".join([f"c{i} {docs.dtypes[i][1]}" for i in kept] + ["fp long"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), words, seed) for x in batch.column(len(kept))), np.uint64, batch.num_rows)
            arrays = [*batch.columns[:-1], pa.array(made.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "fp"])

    return plain.mapInArrow(make, fields)


def _forest(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the values' links within the radius, each search from one value outward."""
    rest = values
    while len(rest) > 1:
        root, rest, front = rest[0], rest[1:], rest[:1]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for x in front:
                near |= np.bitwise_count(rest ^ x) <= radius
            front, rest = rest[near], rest[~near]
            if len(front):
                yield np.full(len(front), root), front


def _search(radius: int, limit: int | None):
    """For mapInArrow: rows (k1, k2, .., fp) sorted by the keys before fp give forest edges; rows of buckets over `limit` come back."""

    def flush(chunk: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        return list(_forest(np.unique(np.concatenate(chunk)), radius))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, count, over = None, [], 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:-1]])
            fps = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
            a, b, out = [], [], []

            def close() -> None:
                if over:
                    out.extend((x, last[0]) for x in held)
                elif count == 2:
                    x, y = np.concatenate(held)
                    if 0 < int(x ^ y).bit_count() <= radius:
                        a.append(np.array([x]))
                        b.append(np.array([y]))
                elif count > 2:
                    for x, y in flush(held):
                        a.append(x)
                        b.append(y)

            alone = (ends - starts == 1)  # nearly all buckets; only a batch's first and last can go on in another batch
            for i in [0, *(np.flatnonzero(~alone[1:-1]) + 1).tolist(), *([len(starts) - 1] if len(starts) > 1 else [])]:
                s, e = starts[i], ends[i]
                key = tuple(keys[:, s].tolist())
                if key != last:
                    close()
                    last, held, count, over = key, [], 0, False
                held.append(fps[s:e])
                count += e - s
                if limit is not None and count > limit:
                    over = True
                if over:
                    out.extend((x, key[0]) for x in held)
                    held = []
            if a or out:
                ones = [np.concatenate(a), np.concatenate(b)] if a else [np.zeros(0, np.uint64)] * 2
                back = [x for x, _ in out]
                first = np.concatenate([ones[0], *back]).view(np.int64)
                second = np.concatenate([ones[1], *back]).view(np.int64)
                table = np.concatenate([np.full(len(ones[0]), -1, np.int32), *[np.full(len(x), t, np.int32) for x, t in out]])
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(table, pa.int32())], schema=_LINKS)
        if count > 1 and not over:
            for x, y in flush(held):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.full(len(x), -1, np.int32))], schema=_LINKS)

    return find


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(values: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the different values of column fp as do all pairs within the radius; each edge is such a chain."""
    family = masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("k1"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k2")) for i, m in enumerate(family)]))
    rows = values.select("fp", tables.alias("k")).select("k.k1", "k.k2", "fp")
    rows = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    found, _ = _common.materialize(rows.mapInArrow(_search(radius, bucket), "a long, b long, over int"), "links")
    edges, over = found.where("over < 0").select("a", "b"), found.where("over >= 0").select(F.col("over").alias("k1"), F.col("a").alias("fp"))
    if over.isEmpty():
        return edges
    whole = (1 << 64) - 1
    second = F.array(*[F.array(*[F.lit(_signed(x)) for x in masks(radius, whole ^ m)]) for m in family])
    firsts = F.array(*[F.lit(_signed(m)) for m in family])
    rows = over.select("k1", "fp", firsts[F.col("k1")].alias("m"), F.posexplode(second[F.col("k1")]).alias("k2", "n"))
    rows = rows.select("k1", "k2", F.expr("fp & m").alias("k3"), F.expr("fp & n").alias("k4"), "fp")
    rows = rows.repartition("k1", "k2", "k3", "k4").sortWithinPartitions("k1", "k2", "k3", "k4", "fp")
    more, _ = _common.materialize(rows.mapInArrow(_search(radius, None), "a long, b long, over int"), "links")
    return edges.unionByName(more.select("a", "b"))


def cluster(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id (the smallest id reachable over links, its own included).

    Null and empty texts have fingerprint zero and are linked as any other. Rows with a null id are linked too, and get the smallest
    id of their component; it is null where no row of it has an id. Rows that share an id keep their own fingerprints. Other
    columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made, _ = _common.materialize(fingerprints(own, words, seed).select(F.col("c0").alias("doc_id"), "fp"), "fingerprints")
    rows = made.count()
    values, _ = _common.materialize(_common.few(made.groupBy("fp").agg(F.min("doc_id").alias("first")), rows), "values")
    near = links(values.select("fp"), radius, bucket)
    roots = components(near, near.count()).withColumnRenamed("node", "fp")
    named = values.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    mapping, _ = _common.materialize(_common.few(named.join(least, "root").select("fp", "component_id"), rows), "classes")
    return made.join(mapping, "fp").select("doc_id", "fp", "component_id")
