"""Simple-8b word-aligned coding of token ids, and a file format of blocks built on it.

A 64-bit word holds a 4-bit selector above 60 data bits. Selectors 0 to 13 pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or
1 values of equal width; selector 15 is an escape, after which the next word is one raw 64-bit value. Encoding chooses the
longest run that fits at each position; encoding and decoding are vectorised over all words of a block.

A block replaces ids by their rank in the block's own frequency order (its dictionary comes first in the payload), since small
numbers pack more to a word. Blocks are self-contained: each has its documents' ids, token counts and place in its file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmatch.llm import _common, tokens

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // c for c in COUNTS)
ESCAPE = 15
_SHORT = np.concatenate([np.full(max(1, 1 << i >> 1), i, np.uint8) for i in range(17)])  # bit lengths of 16-bit values
BLOCK_TOKENS = 1 << 17
BLOCKS_SCHEMA = "file_no int, block_no int, first_token long, doc_ids array<long>, n_tokens array<long>, payload binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each unsigned 64-bit value, exactly."""
    if len(values) and values.max() < 1 << 16:
        return _SHORT[values.astype(np.uint16)]
    out = np.zeros(len(values), np.uint8)
    for shift in (0, 16, 32, 48):
        part = ((values >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        np.copyto(out, _SHORT[part] + np.uint8(shift), where=part > 0)
    return out


def encode(values: np.ndarray) -> np.ndarray:
    """Words of the values (unsigned 64-bit); empty for no values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    bits = _bits(values)
    run = np.where(bits > 60, ESCAPE, 13).astype(np.uint8)  # selector at each position
    wide = {1: bits}  # wide[k][i]: the most bits among k values from i
    last = 1
    for selector in range(12, -1, -1):
        k = COUNTS[selector]
        if k > n:
            break
        top = wide[last]
        step = min(last, k - last)  # max over k values is the max over two overlapping spans
        while last < k:
            step = min(last, k - last)
            top = np.maximum(top[: len(top) - step], top[step:])
            last += step
        wide = {last: top}
        fits = top <= WIDTHS[selector]
        if not fits.any() and WIDTHS[selector] < 8:
            break
        run[: len(fits)][fits] = selector
    taken = np.array([*COUNTS, 0, 1], np.int64)[run].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += taken[i]
    at = np.array(at, np.int64)
    selectors = run[at]
    place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(selectors == ESCAPE)[:-1]))
    words = np.zeros(len(at) + int((selectors == ESCAPE).sum()), np.uint64)
    for selector in np.unique(selectors):
        mine = selectors == selector
        start, to = at[mine], place[mine]
        if selector == ESCAPE:
            words[to] = np.uint64(ESCAPE) << np.uint64(60)
            words[to + 1] = values[start]
            continue
        k, width = COUNTS[selector], WIDTHS[selector]
        shifts = np.arange(k, dtype=np.uint64) * np.uint64(width)
        packed = np.bitwise_or.reduce(values[start[:, None] + np.arange(k)] << shifts, axis=1)
        words[to] = packed | (np.uint64(selector) << np.uint64(60))
    return words


def decode(words: np.ndarray) -> np.ndarray:
    """Values of the words that encode() made."""
    words = np.ascontiguousarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selectors == ESCAPE).any():  # an escape's next word is data, whatever its top bits are
        marks, i = np.flatnonzero(selectors == ESCAPE).tolist(), -1
        for x in marks:
            if x != i:
                i = x + 1
                raw[i] = True
    counts = np.array([*COUNTS, 0, 0], np.int64)[selectors]
    counts[raw] = 1
    starts = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(starts[-1], np.uint64)
    out[starts[:-1][raw]] = words[raw]
    for selector in np.unique(selectors[~raw]):
        if selector == ESCAPE:
            continue
        mine = (selectors == selector) & ~raw
        k, width = COUNTS[selector], WIDTHS[selector]
        shifts = np.arange(k, dtype=np.uint64) * np.uint64(width)
        out[starts[:-1][mine][:, None] + np.arange(k)] = (words[mine][:, None] >> shifts) & np.uint64((1 << width) - 1)
    return out


_HEAD = struct.Struct("<4sIII")


def pack_block(ids: np.ndarray) -> bytes:
    """Payload of a block: head, dictionary (ids by falling frequency) and words of the ranks, all coded by encode()."""
    ids = np.asarray(ids)
    if len(ids) and int(ids.max()) < 1 << 20:
        counts = np.bincount(ids := ids.astype(np.int32))
        seen = np.flatnonzero(counts)
        order = seen[np.argsort(-counts[seen], kind="stable")]
        rank = np.zeros(len(counts), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        ranks, names = rank[ids], order.astype(np.uint64)
    else:
        seen, inverse, counts = np.unique(ids.astype(np.uint64), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.zeros(len(seen), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        ranks, names = rank[inverse], seen[order]
    names, words = encode(names), encode(ranks)
    body = names.astype("<u8").tobytes() + words.astype("<u8").tobytes()
    return _HEAD.pack(b"S8B1", len(names), len(words), zlib.crc32(body)) + body


def unpack_block(payload: bytes) -> np.ndarray:
    """Ids of a block; raises ValueError if the payload is damaged."""
    magic, n_names, n_words, crc = _HEAD.unpack_from(payload)
    body = memoryview(payload)[_HEAD.size :]
    if magic != b"S8B1" or len(body) != 8 * (n_names + n_words) or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    words = np.frombuffer(body, "<u8")
    return decode(words[n_names:]) if not n_names else decode(words[:n_names])[decode(words[n_names:]).astype(np.int64)]


def write_ids(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes every text, appends end_id and writes blocks in ascending document order; returns the files' folder.

    A null text counts as empty. Null ids come first. Rows of one id keep the input's order, so each row has its own place and
    a third of all rows may share an id: the rows are dealt out by (id, input position). Other columns are ignored. An empty
    table gives a folder without blocks. Blocks hold whole documents, about BLOCK_TOKENS ids each; a longer document has its own.
    Writing goes through Spark's committer, so a lost executor only repeats its tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    tail = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        names = pa.schema([("file_no", pa.int32()), ("block_no", pa.int32()), ("first_token", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary())])
        file_no, block_no, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            payload = pack_block(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array(x, kind.type) for x, kind in zip(([file_no], [block_no], [first], [doc_ids], [counts], [payload]), names)], schema=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encoder.encode(text.as_py()) + tail
                doc_ids.append(doc_id)
                counts.append(len(data) // 4)
                parts.append(data)
                held += counts[-1]
                if held >= BLOCK_TOKENS:
                    yield close()
                    block_no, first = block_no + 1, first + held
                    doc_ids, counts, parts, held = [], [], [], 0
        if doc_ids:
            yield close()

    return _common.materialize(rows.mapInArrow(blocks, BLOCKS_SCHEMA), "s8b")[1]


def read_blocks(spark, path: str) -> DataFrame:
    """The blocks of a folder, each with `start`: the ids before it in all files.

    One row per file, of which there are as many as shuffle partitions at most, decides the files' starts; it goes to the blocks, which stay.
    """
    blocks = spark.read.schema(BLOCKS_SCHEMA).parquet(path)
    tokens = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda x, y: x + y)
    files = blocks.select("file_no", tokens.alias("n")).groupBy("file_no").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("file_no", F.coalesce(before, F.lit(0)).alias("file_start"))
    return blocks.join(F.broadcast(starts), "file_no").withColumn("start", F.col("file_start") + F.col("first_token"))


def read_ids(spark, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids, decoded from the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, start, part in _documents(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "start": pa.array([start], pa.int64()), "n_tokens": pa.array([len(part)], pa.int64()), "ids": pa.array([part.astype(np.int64)], pa.list_(pa.int64()))})

    return read_blocks(spark, path).select("doc_ids", "n_tokens", "payload", "start").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids array<long>")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    for batch in batches:
        for doc_ids, counts, payload, start in zip(*(batch.column(i) for i in range(4))):
            ids, at, start = unpack_block(payload.as_py()), 0, start.as_py()
            for doc_id, n in zip(doc_ids.as_py(), counts.as_py()):
                yield doc_id, start + at, ids[at : at + n]
                at += n


def digest_ids(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 of its little-endian unsigned 32-bit ids."""
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in _documents(iter([batch]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    return read_blocks(spark, path).select("doc_ids", "n_tokens", "payload", "start").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
