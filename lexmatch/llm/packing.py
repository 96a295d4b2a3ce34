"""Bounded-space online packing of documents into sequences of a fixed number of tokens.

Each partition keeps a fixed number of open windows. A document fills whole sequences of its own as far as it goes; what remains
is placed best-fit, into the open window with the least room that holds it. When none holds it, the fullest window is emitted
(a piece is cut to fill it if its room is at least `min_cut`, so that padding stays small) and a new one is opened. Windows that
are open at a partition's end are merged once, in groups of `fan_in` partitions, so no task ever gets more than
fan_in * windows * (size - 1) tokens; each group leaves one sequence that isn't full. A task holds the open windows and one document at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmatch.llm import _common, tokens

SIZE, WINDOWS, MIN_CUT, FAN_IN = 1024, 64, 16, 8
PIECES = pa.schema([("doc_id", pa.int64()), *[(x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
OPEN = pa.schema([*PIECES, ("part", pa.int64()), ("ids", pa.binary())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Best-fit into open windows. add() and close() return emitted sequences as lists of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int = SIZE, windows: int = WINDOWS, min_cut: int = MIN_CUT) -> None:
        self.size, self.windows, self.min_cut = size, windows, min_cut
        self.open: list[list] = []  # [room, pieces]

    def add(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> list[list]:
        out, n, at, full = [], len(ids) // 4, 0, self.size
        while n - at >= full:
            out.append([(doc_id, start + at, ids[4 * at : 4 * (at + full)], doc_tokens)])
            at += full
        while at < n:
            rest = n - at
            best = min((w for w in self.open if w[0] >= rest), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.windows:
                self.open.append(best := [full, []])
            if best is None:
                best = min(self.open, key=lambda w: w[0])
                if (room := best[0]) >= self.min_cut:
                    best[1].append((doc_id, start + at, ids[4 * at : 4 * (at + room)], doc_tokens))
                    at += room
                out.append(best[1])
                self.open.remove(best)
                continue
            best[1].append((doc_id, start + at, ids[4 * at :], doc_tokens))
            best[0] -= rest
            at = n
            if not best[0]:
                out.append(best[1])
                self.open.remove(best)
        return out

    def close(self) -> list[list]:
        """Joins what the open windows hold, cut freely, so that only the last sequence needs padding."""
        out, now, room = [], [], self.size
        for piece in (x for w in self.open for x in w[1]):
            doc_id, start, ids, doc_tokens = piece
            while ids:
                head, ids = ids[: 4 * room], ids[4 * room :]
                now.append((doc_id, start, head, doc_tokens))
                start, room = start + len(head) // 4, room - len(head) // 4
                if not room:
                    out.append(now)
                    now, room = [], self.size
        self.open = []
        return out + [now] * bool(now)


def _rows(sequences: Iterator[list], first: int) -> Iterator[tuple]:
    for i, pieces in enumerate(sequences):
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, first + i, at
            at += len(ids) // 4


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for x in rows:
        held.append(x)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def pack(docs: DataFrame, size: int = SIZE, windows: int = WINDOWS, min_cut: int = MIN_CUT, fan_in: int = FAN_IN, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and end_id; a null text counts as empty, so its document is end_id alone. Null and repeated ids
    are kept: every input row is packed. Other columns are ignored; an empty table gives no rows. The only rows that move between
    tasks are those of open windows. The first pass is written once in the shared folder, so that both readers see the same cuts.
    A size, number of windows or fan-in below one raises ValueError.
    """
    if min(size, windows, fan_in) < 1:
        raise ValueError(f"size {size}, windows {windows} and fan_in {fan_in} are one at least")
    tail = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, part = tokens.encoder(tokenizer), Packer(size, windows, min_cut), TaskContext.get().partitionId()

        def sequences() -> Iterator[list]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encoder.encode(text.as_py()) + tail
                    yield from packer.add(doc_id, 0, ids, len(ids) // 4)

        done = ((*x, None, None) for x in _rows(sequences(), part << 32))
        yield from _batches(done, OPEN)
        yield from _batches(_open(packer, part), OPEN, 512)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made, _ = _common.materialize(rows.mapInArrow(first, f"{_DDL}, part long, ids binary"), "pack")
    done, waiting = made.where("part is null").select(*PIECES.names), made.where("part is not null")
    n = (waiting.agg(F.max("part").alias("m")).first()["m"] or 0) + 1
    merged = _merge(waiting, -(-n // fan_in), Packer(size, windows, min_cut))
    return done.unionByName(merged)


def _open(packer: Packer, part: int) -> Iterator[tuple]:
    for window in packer.open:
        for doc_id, start, ids, doc_tokens in window[1]:
            yield doc_id, start, len(ids) // 4, 0, doc_tokens, 0, 0, part, ids


def _merge(waiting: DataFrame, groups: int, packer: Packer) -> DataFrame:
    """Packs the open windows' pieces of each group of partitions again, longest first, and joins what stays open."""
    size, windows, min_cut = packer.size, packer.windows, packer.min_cut

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        own = Packer(size, windows, min_cut)
        pieces = sorted(zip(*(group.column(x).to_pylist() for x in ("doc_id", "start", "ids", "doc_tokens"))), key=lambda x: (-len(x[2]), x[0] is None, x[0] or 0, x[1], x[2]))
        rows = [*_rows((s for x in pieces for s in own.add(*x)), (1 << 56) | (key[0].as_py() << 32))]
        rows += _rows(own.close(), (2 << 56) | (key[0].as_py() << 32))
        return pa.Table.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(PIECES)], schema=PIECES)

    grouped = waiting.withColumn("part", F.expr(f"part % {groups}"))
    return grouped.groupBy("part").applyInArrow(merge, _DDL)
