"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of `window` consecutive words of the benchmark's items; an item of fewer words is one window. The
alphabet is words: a shift table of blocks of two words says how far the search may skip (up to window - 1 words at once); a shift
of zero leads to the bucket of the windows with this last block and these first words, and comparing all words confirms an
occurrence. Windows of one length share tables; lengths below two use blocks of one word. A window is kept as its place in its
item, so the tables take a few hundred bytes a window, whatever its length.

A benchmark whose tables a task can't hold is searched for in blocks. Then a sieve comes first: the same search over hashed tables of
the whole benchmark, a byte of shift and a byte of bucket to a slot, which can only let too many texts through. All texts are read
once; only those with a possible occurrence go on to the blocks' tables, one block after another.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmatch.llm import _common

WINDOW = 13
#: Bytes of item text whose tables a task holds; a larger benchmark is searched for in blocks of about so much each, after the sieve.
BLOCK_BYTES = 4 << 20
_FIRST = 3
#: ASCII letters to lower case; all other ASCII but digits to space. Bytes from 0x80 on stay, so words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.
_TABLE = bytes(ord(" ") if i < 128 and not chr(i).isalnum() else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text, as UTF-8; none for null."""
    return text.encode().translate(_TABLE).split() if text else []


class WuManber:
    """Search for windows of one length. add() items, then occurrences() in any number of documents."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.longest = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[int, list[tuple[int, int] | tuple[int, int, set[str]]]] = {}
        self.items: list[tuple[str, list[bytes]]] = []

    def _end(self, at: list[bytes], end: int) -> bytes:
        return at[end] if self.block == 1 else at[end - 1] + b" " + at[end]

    def _bucket(self, at: list[bytes], first: int) -> int:
        last = first + self.length
        return hash((*at[first : min(first + _FIRST, last)], at[last - self.block], at[last - 1]))

    def add(self, item: str, text: list[bytes]) -> None:
        """Adds all windows of an item. A block's shift is its distance from the end of the first window that holds it."""
        number, length, shift = len(self.items), self.length, self.shift
        self.items.append((item, text))
        for end in range(self.block - 1, len(text)):
            key, far = self._end(text, end), max(0, length - 1 - end)
            if far < shift.get(key, self.longest):
                shift[key] = far
        for first in range(len(text) - length + 1):
            bucket = self.buckets.setdefault(self._bucket(text, first), [])
            for i, (other, at, *names) in enumerate(bucket):
                if self.items[other][1][at : at + length] == text[first : first + length]:
                    if names:
                        names[0].add(item)
                    elif self.items[other][0] != item:
                        bucket[i] = (other, at, {self.items[other][0], item})
                    break
            else:
                bucket.append((number, first))

    def occurrences(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(first word, items) of each place where a window occurs."""
        length, longest, shift, n = self.length, self.longest, self.shift.get, len(text)
        pairs, end = self.block == 2, length - 1
        while end < n:
            if far := shift(text[end - 1] + b" " + text[end] if pairs else text[end], longest):
                end += far
                continue
            first = end - length + 1
            for other, at, *names in self.buckets.get(self._bucket(text, first), ()):
                item, own = self.items[other]
                if own[at : at + length] == text[first : end + 1]:
                    yield first, names[0] if names else {item}
                    break
            end += 1


class Sieve:
    """WuManber's search over hashed tables of a fixed size: tells texts in which no window of one length can occur."""

    def __init__(self, length: int, bits: int) -> None:
        self.length, self.block, self.mask = length, min(2, length), (1 << bits) - 1
        self.shift, self.full = bytearray([length - self.block + 1]) * (1 << bits), bytearray(1 << bits)

    def _slot(self, at: list[bytes], end: int) -> int:
        return zlib.crc32(at[end] if self.block == 1 else at[end - 1] + b" " + at[end]) & self.mask

    def _bucket(self, at: list[bytes], first: int) -> int:
        last = first + self.length
        return zlib.crc32(b" ".join((*at[first : min(first + _FIRST, last)], at[last - self.block], at[last - 1]))) & self.mask

    def add(self, text: list[bytes]) -> None:
        for end in range(self.block - 1, len(text)):
            slot = self._slot(text, end)
            self.shift[slot] = min(self.shift[slot], max(0, self.length - 1 - end))
        for first in range(len(text) - self.length + 1):
            self.full[self._bucket(text, first)] = 1

    def passes(self, text: list[bytes]) -> bool:
        end, n = self.length - 1, len(text)
        while end < n:
            far = self.shift[self._slot(text, end)]
            if not far and self.full[self._bucket(text, end - self.length + 1)]:
                return True
            end += far or 1
        return False


def sieves(blocks: Iterable[list[tuple[str, str]]], window: int, bits: int) -> list[Sieve]:
    """A sieve of 2^bits slots for the full length, and of less for those of short items, which are few."""
    found: dict[int, Sieve] = {}
    for block in blocks:
        for _, text in block:
            own = words(text)
            if own:
                length = min(window, len(own))
                found.setdefault(length, Sieve(length, bits if length == window else min(bits, 20))).add(own)
    return [found[k] for k in sorted(found)]


def build(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """A searcher for each window length that the items (id, text) have."""
    found: dict[int, WuManber] = {}
    same: dict[bytes, bytes] = {}  # one object for equal words
    for item, text in items:
        own = [same.setdefault(x, x) for x in words(text)]
        if own:
            length = min(window, len(own))
            found.setdefault(length, WuManber(length)).add(item, own)
    return [found[k] for k in sorted(found)]


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(text: str | None, searchers: list[WuManber]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit spans of words (disjoint, ascending, end exclusive) and the items that occur."""
    own, spans, items = words(text), [], set()
    for s in searchers:
        for first, these in s.occurrences(own):
            spans.append((first, first + s.length))
            items |= these
    return len(own), _union(spans), items


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in lists of about block_bytes. Items stream to the driver one Spark partition at a time; one list is held."""
    held, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).distinct()
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


_built: dict[str, list[WuManber]] = {}


def _tables(name: str, block: Callable[[], list[tuple[str, str]]], window: int) -> list[WuManber]:
    """The tables of a named block. A Python worker holds those of its last one, so its next tasks don't build them again."""
    if name not in _built:
        _built.clear()
        _built[name] = build(block(), window)
    return _built[name]


_FOUND = "n_words long, spans array<struct<a:long,b:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _scan(rows: DataFrame, at: int, block: list[tuple[str, str]], window: int, hits_only: bool) -> DataFrame:
    """rows with _FOUND's columns from one block of items; hits_only: without the text, and only rows with hits."""
    sent, name = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex  # about block_bytes
    kept = [i for i in range(len(rows.columns)) if not hits_only or i != at]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tables(name, lambda: sent.value, window)
        for batch in batches:
            found = [search(x.as_py(), own) for x in batch.column(at)]
            if hits_only:
                some = [i for i, x in enumerate(found) if x[1]]
                batch, found = batch.take(pa.array(some, pa.int64())), [found[i] for i in some]
            made = [pa.array([x[0] for x in found], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x[1]] for x in found], _SPANS), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string()))]
            names = [batch.schema.names[i] for i in kept]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *made], names=[*names, "n_words", "spans", "items"])

    return rows.mapInArrow(scan, ", ".join([*[f"{rows.columns[i]} {rows.dtypes[i][1]}" for i in kept], _FOUND]))


def _sieved(rows: DataFrame, at: int, own: list[Sieve]) -> DataFrame:
    """rows with n_words, and whether a window may occur."""
    sent = rows.sparkSession.sparkContext.broadcast(own)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, passes = [], []
            for x in batch.column(at):
                found = words(x.as_py())
                sizes.append(len(found))
                passes.append(any(s.passes(found) for s in sent.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(passes, pa.bool_())], names=[*batch.schema.names, "n_words", "passes"])

    return rows.mapInArrow(scan, ", ".join(f"{name} {kind}" for name, kind in rows.dtypes) + ", n_words long, passes boolean")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = 0.05, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", names: Sequence[str] = ("_n_words", "_n_hit", "_items", "_contaminated")) -> DataFrame:
    """docs with the columns `names`: words, words hit, sorted ids of occurring items, and whether it is contaminated; the input's columns stay.

    A document is contaminated if hits are some and at least min_share of its words. Null and empty texts have no words and no
    hits. Items with null id or text are ignored; repeated items count once; an empty benchmark hits nothing. Every word of
    every text is searched. A benchmark of up to block_bytes takes a single narrow pass without a shuffle. Of a larger one the
    driver and a task hold one block at a time, and the sieve: each block is searched for in a pass of its own over the texts that
    the sieve lets through, and its hits are joined. A caller whose columns may clash with `names` gives others.
    """
    plain = docs.select(*[F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(docs.columns)])
    at = docs.columns.index(text_col)
    parts = blocks(benchmark, item_id, item_text, block_bytes)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        out = _scan(plain, at, first, window, False)
    else:
        size = benchmark.agg(F.sum(F.octet_length(F.col(item_text).cast("string")))).first()[0]
        # a slot for each word at least, up to 2^26: 128 MB at any size of the benchmark
        sieved = _sieved(plain.withColumn("row", F.monotonically_increasing_id()), at, sieves(chain([first, second], parts), window, min(26, max(16, (size // 4).bit_length()))))
        base, _ = _common.materialize(sieved, "sieved")
        left, _ = _common.materialize(base.where("passes").select("row", f"c{at}"), "texts")
        hits = None
        for block in blocks(benchmark, item_id, item_text, block_bytes):
            more, _ = _common.materialize(_scan(left, 1, block, window, True), "hits")
            hits = more if hits is None else hits.unionByName(more)
        gathered = hits.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row for each block at most
        joined = base.join(gathered, "row", "left")
        out = joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<a:long,b:long>>"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"))
    out = out.withColumn("n_hit", F.aggregate("spans", start, step, lambda s: s["n"]))
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * (1 / min_share) >= F.col("n_words"))
    made = (F.col("n_words"), F.col("n_hit"), F.col("items"), bad)
    return out.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)], *[x.alias(name) for x, name in zip(made, names, strict=True)])


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for the query of find(): words, windows by length, and places of equal windows, all by joins."""
    words = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with docs as (select row_number() over () as r, doc_id, {words("text")} as w from documents),
items as (select distinct cast(item_id as varchar) as item, {words("text")} as w from benchmark where item_id is not null and text is not null),
sized as (select item, w, least({window}, len(w)) as n from items where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as k from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from sized)),
lengths as (select distinct n from windows),
places as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as k from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths where len(w) >= n)),
hits as (select r, n, i, item from places join windows using (n, k)),
hit_words as (select r, count(distinct p) as n_hit from (select distinct r, unnest(range(i, i + n)) as p from (select distinct r, n, i from hits)) group by r),
hit_items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit_words using (r) left join hit_items using (r)
"""
