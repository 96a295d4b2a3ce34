"""Saving and loading an index: Parquet tables, and the single-file binary format for exchange."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmatch.functions import codec
from lexmatch.plans.stages import written

TABLES = ("dictionary", "nodes", "edges")
#: Bytes that one binary file may have, as Spark reads a file as one value; larger indexes are Parquet only.
FILE_BYTES = (1 << 31) - (1 << 20)


def save(path: str, **tables: DataFrame) -> None:
    """Writes dictionary (term, freq, idx), nodes and edges under path, in place of what is there."""
    if not path:
        raise ValueError("a path is needed")
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"{name} is not one of {TABLES}")
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def file_bytes(first_edges: list[int], targets: list[int], labels: str, reachable: list[int], counts: list[int], root: int = 0) -> bytes:
    """An index file: a size, the root, offsets as differences, targets (negative: the target ends a word), labels, word counts below nodes, frequencies."""
    sizes = 4 * len(first_edges) + 4 * len(targets) + 2 * len(labels) + 2 * len(reachable) + 8 * len(counts)
    return codec.pack_unsigned(sizes) + codec.pack_signed(root) + codec.pack_ascending_array(first_edges) + codec.pack_signed_array(targets) + codec.pack_text(labels) + codec.pack_unsigned_array(reachable) + codec.pack_unsigned_array(counts)


def parse_file(data: bytes) -> dict:
    at = codec.Cursor(data)
    return {"size": at.unsigned(), "root": at.signed(), "first_edges": at.ascending_array(), "targets": at.signed_array(), "labels": at.text(), "reachable": at.unsigned_array(), "counts": at.unsigned_array()}


def export_pieces(nodes: DataFrame, edges: DataFrame, dictionary: DataFrame, limit: int = FILE_BYTES) -> Iterator[bytes]:
    """The binary file of an index, as file_bytes() makes it, in pieces of some kilobytes in their order.

    The numbers are put in order and packed by the executors; the driver holds one partition of packed pieces at a time. An index whose
    file would be over `limit` bytes is refused. Offsets as differences are the nodes' degrees.
    """
    ends = nodes.where("is_terminal").select(F.col("order_id").alias("dst_order"), F.lit(-1).alias("sign"))
    target = edges.join(ends, "dst_order", "left").select("edge_id", F.col("dst_order") * F.coalesce("sign", F.lit(1)), "label")
    row = lambda df, part, at, value, label: df.select(F.lit(part).alias("part"), F.col(at).alias("at"), F.col(value).cast("bigint").alias("value"), label.alias("label"))
    none, target = F.lit(None).cast("string"), target.toDF("edge_id", "target", "label")
    # a target and its label stand in two parts of the file, so edges come twice
    rows = row(nodes, 0, "order_id", "degree", none).unionByName(row(target, 1, "edge_id", "target", none)).unionByName(row(target, 2, "edge_id", "target", F.col("label")))
    rows = rows.unionByName(row(nodes, 3, "order_id", "reachable", none)).unionByName(row(dictionary, 4, "idx", "freq", none))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, values = batch["part"].to_numpy(), batch["value"].to_numpy()
            for part in np.unique(parts):
                first, end = np.searchsorted(parts, part), np.searchsorted(parts, part, "right")
                letters = batch["label"].slice(int(first), int(end - first)).to_pylist() if part == 2 else []
                data = "".join(letters).encode() if part == 2 else codec.pack_many(values[first:end], signed=part == 1)
                yield pa.RecordBatch.from_pydict({"part": [int(part)], "at": [batch["at"][int(first)].as_py()], "n": [int(end - first)], "units": [sum(1 + (x > "\uffff") for x in letters)], "data": [data]}, schema)

    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("units", pa.int64()), ("data", pa.binary())])
    placed = rows.repartitionByRange("part", "at").sortWithinPartitions("part", "at")
    pieces = written(placed.mapInArrow(pack, "part int, at bigint, n bigint, units bigint, data binary"), "pieces")
    sums = {r["part"]: r for r in pieces.groupBy("part").agg(*[F.sum(x).alias(x) for x in ("n", "units")], F.sum(F.length("data")).alias("size")).collect()}  # five rows at most
    n, m, words = (sums[i]["n"] if i in sums else 0 for i in (0, 1, 4))
    if sum(r["size"] for r in sums.values()) + 100 > limit:
        raise ValueError("the index is too large for one file")
    heads = [codec.pack_unsigned(4 * (n + 1) + 4 * m + 2 * m + 2 * n + 8 * words) + codec.pack_signed(0) + codec.pack_unsigned(n + 1) + codec.pack_unsigned(0), codec.pack_unsigned(m)]
    heads += [codec.pack_unsigned(sums[2]["size"] if m else 0) + codec.pack_unsigned(sums[2]["units"] if m else 0), codec.pack_unsigned(n), codec.pack_unsigned(words)]
    for part, head in enumerate(heads):
        yield head
        if part in sums:
            for r in pieces.where(F.col("part") == part).select("at", "data").orderBy("at").toLocalIterator():
                yield bytes(r["data"])


def export_file(nodes: DataFrame, edges: DataFrame, dictionary: DataFrame) -> bytes:
    """export_pieces() as one value in the driver, for small indexes; write_file() takes the pieces of large ones."""
    return b"".join(export_pieces(nodes, edges, dictionary))


def write_file(spark: SparkSession, path: str, data: bytes | Iterable[bytes]) -> None:
    """Writes one file, in place of what is there, to any store that Spark reaches. Data may come in pieces."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out, held = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True), bytearray()
    try:
        for piece in [data] if isinstance(data, bytes) else data:
            held += piece
            for i in range(0, len(held) - len(held) % (1 << 20), 1 << 20):
                out.write(bytes(held[i : i + (1 << 20)]))
            del held[: len(held) - len(held) % (1 << 20)]
        out.write(bytes(held))
    finally:
        out.close()


def parse_arrays(data: bytes | memoryview) -> dict:
    """parse_file() with arrays, and labels as code points."""
    held, at = np.frombuffer(data, np.uint8), codec.Cursor(data)
    found: dict = {"size": at.unsigned(), "root": at.signed()}

    def numbers(signed: bool = False) -> np.ndarray:
        n = at.unsigned()
        values, at.at = codec.unpack_many(held, at.at, n, signed)
        return values

    found["first_edges"] = np.cumsum(numbers())
    found["targets"] = numbers(signed=True)
    found["labels"] = np.frombuffer(at.text().encode("utf-32-le"), np.uint32)
    found["reachable"], found["counts"] = numbers(), numbers()
    return found


def _ends(found: dict) -> np.ndarray:
    return np.append(found["first_edges"][1:], len(found["targets"]))


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, order_id, edge_id, dst_order, is_terminal, label) of every edge in binary files; each file is read in one task."""

    def rows(found: dict) -> Iterator[dict]:
        owners = np.repeat(np.arange(len(found["first_edges"])), _ends(found) - found["first_edges"])
        for i in range(0, len(owners), SLICE):
            target, letters = found["targets"][i : i + SLICE], found["labels"][i : i + SLICE].tobytes().decode("utf-32-le")
            yield {"order_id": owners[i : i + SLICE], "edge_id": np.arange(i, i + len(target)), "dst_order": np.abs(target), "is_terminal": target < 0, "label": [*letters]}

    return _read_files(spark, path, rows, "order_id bigint, edge_id bigint, dst_order bigint, is_terminal boolean, label string")


def import_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(path, order_id, first_edge, degree, reachable) of every node in binary files."""

    def rows(found: dict) -> Iterator[dict]:
        n = len(found["reachable"])
        degree = _ends(found)[:n] - found["first_edges"][:n]
        for i in range(0, n, SLICE):
            own = slice(i, min(n, i + SLICE))
            yield {"order_id": np.arange(own.start, own.stop), "first_edge": found["first_edges"][own], "degree": degree[own], "reachable": found["reachable"][own]}

    return _read_files(spark, path, rows, "order_id bigint, first_edge bigint, degree bigint, reachable bigint")


def import_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(path, term, freq, idx): the words of binary files with their frequencies, ready for lookups.

    A word's place is that in depth-first order, a word before its extensions, which is the order of the frequencies in the file. Nodes' word
    counts give it without a walk in that order: a slice of paths goes on by a letter at once.
    """

    def rows(found: dict) -> Iterator[dict]:
        first, ends, targets, counts, below, n = found["first_edges"], _ends(found), found["targets"], found["counts"], found["reachable"], 0
        # paths of equal length: the node that each ends in, the place of the first word beyond, and the letters
        todo = [(np.array([found["root"]]), np.zeros(1, np.int64), np.zeros((1, 0), np.uint32))] if len(below) else []
        while todo:
            node, place, letters = todo.pop()
            if len(node) > SLICE:
                todo += [(node[own], place[own], letters[own]) for own in (slice(i, i + SLICE) for i in range(0, len(node), SLICE))]
                continue
            degree = ends[node] - first[node]
            parent, before = np.repeat(np.arange(len(node)), degree), np.cumsum(degree) - degree
            edge = first[node][parent] + np.arange(len(parent)) - before[parent]
            target, ending = np.abs(targets[edge]), targets[edge] < 0
            sums = np.cumsum(below[target]) - below[target]
            place = place[parent] + sums - sums[np.minimum(before, max(0, len(edge) - 1))][parent] if len(edge) else place[:0]
            letters = np.concatenate([letters[parent], found["labels"][edge][:, None]], axis=1)
            at, width = place[ending], letters.shape[1]
            if len(at) and at.max() >= len(counts):
                raise ValueError(f"a word has place {at.max()} of {len(counts)} frequencies")
            text, n = letters[ending].tobytes().decode("utf-32-le"), n + len(at)
            if len(at):
                yield {"term": [text[i : i + width] for i in range(0, len(text), width)], "freq": counts[at], "idx": at}
            more = ends[target] > first[target]
            if more.any():
                todo.append((target[more], (place + ending)[more], letters[more]))
        if n != len(counts):
            raise ValueError(f"the file has {n} words and {len(counts)} frequencies")

    return _read_files(spark, path, rows, "term string, freq bigint, idx bigint")


#: Rows that are made at once.
SLICE = 50_000


def _read_files(spark: SparkSession, path: str, rows: Callable[[dict], Iterator[dict]], fields: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"]):
                for made in rows(parse_arrays(memoryview(data.as_buffer()).cast("B"))):
                    n = len(next(iter(made.values())))
                    yield pa.RecordBatch.from_pydict({"path": pa.array([name] * n, pa.string()), **{k: pa.array(v) for k, v in made.items()}})

    raw = spark.read.format("binaryFile").load(path).select("path", F.col("content"))
    return raw.mapInArrow(read, f"path string, {fields}")
