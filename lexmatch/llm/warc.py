"""WARC files: reading, writing, and derivatives of response records.

A response gives two records that refer to it and name each other: metadata (JSON of its WARC and HTTP headers, digests, title and
links) and conversion (its plain text). Identifiers are made from the response's, so a repeated run makes the same ones.

Files are read and written by Spark's text source with a record separator in place of the line's, so records stream one at a time,
plain files split, and any store that Spark reaches will do. What the separator cuts is put together again by Content-Length.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmatch.llm.html import Reader

VERSION = "WARC/1.1"
_END = "\r\n\r\n"
RECORD = "headers map<string,string>, block binary"
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.IGNORECASE)


def _to_maps(rows: list[dict[str, str]]) -> pa.Array:
    """Headers as a column of maps; from flat keys and values, as rows of pairs take Arrow many times as long."""
    offsets, keys, values = [0], [], []
    for row in rows:
        keys.extend(row)
        values.extend(row.values())
        offsets.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def _from_maps(column: pa.MapArray) -> list[dict[str, str | None]]:
    """The maps of a column; a null one is empty."""
    keys, values, offsets = column.keys.to_pylist(), column.items.to_pylist(), column.offsets.to_pylist()
    return [dict(zip(keys[a:b], values[a:b])) for a, b in zip(offsets, offsets[1:])]


def digest(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def urn(*parts: str | None) -> str:
    """A record identifier that depends on the parts alone."""
    x = bytearray(hashlib.sha256("\x00".join(p or "" for p in parts).encode("utf-8", "surrogatepass")).digest()[:16])
    x[6], x[8] = x[6] & 0x0F | 0x80, x[8] & 0x3F | 0x80
    h = x.hex()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records (key, headers, block) of pages; a null page is an empty payload.

    A record's id is made from the page's id, address and digest and from the row's place in the input, so that no two rows share one,
    repeated rows and rows without id and address included; it is the same each time the same files are read in the same splits.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), F.monotonically_increasing_id().alias("place"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers, blocks = [], []
            for key, url, page, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                payload = (page.as_py() or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                whole = digest(payload)
                own = {"WARC-Type": "response", "WARC-Record-ID": urn("response", str(key), url, whole, str(place)), "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": whole, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
                headers.append({**own, "WARC-Target-URI": clean(url)} if url else own)
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), _to_maps(headers), pa.array(blocks, pa.binary())], names=["key", "headers", "block"])

    return rows.mapInArrow(make, f"key long, {RECORD}")


def clean(value: str) -> str:
    """A header's value on one line."""
    return " ".join(value.split())


def http_parts(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (lower-case names, repeats joined by a comma) and payload of an HTTP response; all of it is payload if it isn't one."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    at = block.find(b"\r\n\r\n")
    gap = 4
    if at < 0:
        at, gap = block.find(b"\n\n"), 2
    if at < 0:
        at, gap = len(block), 0
    first, *lines = block[:at].decode("utf-8", "replace").splitlines() or [""]
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            found[name] = f"{found[name]}, {value.strip()}" if name in found else value.strip()
    return first, found, block[at + gap :]


def unchunked(body: bytes) -> bytes:
    """The content of a chunked body. Where it is broken or cut off, what follows is taken as it is."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            out.append(body[at:])
            break
        n = int(size, 16)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        at += 2 * (body[at : at + 2] == b"\r\n")
    return b"".join(out)


def decoded(http: dict[str, str], body: bytes) -> bytes:
    """A body without its transfer and content codings (chunked, gzip, deflate). What isn't coded as said, or otherwise, stays as it is."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for coding in reversed([x.strip().lower() for x in http.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip", "deflate"):
            for bits in (47, -15):  # with a header of either kind, or bare
                reader = zlib.decompressobj(bits)
                try:
                    made = [reader.decompress(body)]
                    while reader.eof and reader.unused_data[:2] == b"\x1f\x8b":  # further members
                        rest, reader = reader.unused_data, zlib.decompressobj(47)
                        made.append(reader.decompress(rest))
                    body = b"".join(made)
                    break
                except zlib.error:
                    continue
    return body


def page_text(payload: bytes, content_type: str) -> tuple[str, str | None, list[str]]:
    """Plain text, title and links: of a page one block a line, of other text types the text itself, nothing of the rest."""
    kind = content_type.partition(";")[0].strip().lower()
    named = _CHARSET.search(content_type) or _CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        text = payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    if kind in ("", "text/html", "application/xhtml+xml"):
        page = Reader(text)
        return "\n".join(b.text for b in page.blocks), page.title, page.links
    return text if kind.startswith("text/") else "", None, []


def derivatives(headers: dict[str, str], block: bytes, tool: str = "lexmatch", place: str = "") -> list[tuple[dict[str, str], bytes]]:
    """The metadata and conversion records (headers, block) of a response. place: tells records apart that have no id."""
    own = {k.lower(): v for k, v in headers.items()}
    status, http, payload = http_parts(block)
    body = decoded(http, payload)
    text, title, links = page_text(body, http.get("content-type", "text/html" if body[:1] == b"<" else "text/plain"))
    source, whole = own.get("warc-record-id", ""), own.get("warc-block-digest") or digest(block)
    ids = {kind: urn(kind, *((source, own.get("warc-target-uri")) if source else (whole, place))) for kind in ("metadata", "conversion")}
    info = {
        "container": tool, "source": dict(sorted(headers.items())), "status": status, "http": http, "payload_bytes": len(payload), "decoded_bytes": len(body),
        "payload_digest": own.get("warc-payload-digest") or digest(payload), "block_digest": whole, "title": title, "links": links, "text_chars": len(text),
    }
    blocks = {"metadata": json.dumps(info, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"), "conversion": text.encode("utf-8", "replace")}
    kinds = {"metadata": "application/json", "conversion": "text/plain; charset=utf-8"}
    out = []
    for kind, data in blocks.items():
        other = ids["conversion" if kind == "metadata" else "metadata"]
        made = {"WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Refers-To": source, "WARC-Concurrent-To": other, "WARC-Date": own.get("warc-date", ""), "Content-Type": kinds[kind], "WARC-Block-Digest": digest(data), "X-Source-Payload-Digest": info["payload_digest"], "Content-Length": str(len(data))}
        if own.get("warc-target-uri"):
            made["WARC-Target-URI"] = own["warc-target-uri"]
        out.append(({k: v for k, v in made.items() if v}, data))
    return out


def derive(records: DataFrame) -> DataFrame:
    """(key, headers, block) of the two derivatives of each response in records (key, headers, block); other record types are passed over.

    A narrow pass. Records with null headers count as responses without any; a null block is empty. Extra columns are ignored.
    """
    rows = records.select("key", "headers", "block", F.monotonically_increasing_id().alias("place"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, headers, blocks = [], [], []
            for key, own, block, place in zip(batch.column(0).to_pylist(), _from_maps(batch.column(1)), batch.column(2), batch.column(3).to_pylist()):
                given = {k: v or "" for k, v in own.items()}
                if next((v for k, v in given.items() if k.lower() == "warc-type"), "response") != "response":
                    continue
                for head, data in derivatives(given, block.as_py() or b"", place=str(place)):
                    keys.append(key)
                    headers.append(head)
                    blocks.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), _to_maps(headers), pa.array(blocks, pa.binary())], names=["key", "headers", "block"])

    return rows.mapInArrow(make, f"key {dict(rows.dtypes)['key']}, {RECORD}")


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes records (headers, block) as WARC files. A null or missing block is empty. Header lines keep the map's order."""
    lines = F.array_join(F.transform(F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\r\n")
    record = F.concat(F.lit(f"{VERSION}\r\n").cast("binary"), lines.cast("binary"), F.lit(_END).cast("binary"), F.coalesce("block", F.lit(b"")))
    # A string is only a carrier of bytes here: the text writer writes them as they are.
    records.select(record.cast("string").alias("value")).write.option("lineSep", _END).option("compression", compression).text(path)


class _Frames:
    """Puts a file's pieces between separators together to records. piece() and end() give (headers, block, whole)."""

    def __init__(self, version: str) -> None:
        self.prefix, self.gap = f"{version}\r\n".encode(), f"{_END}{version}\r\n".encode()
        self.held: list[bytes] = []  # pieces of a record that goes on beyond its first piece
        self.size = self.want = 0

    def _head(self, piece: bytes) -> tuple[dict[str, str], int, int | None]:
        """A record's headers, where its block begins, and how long that should be."""
        end = piece.find(b"\r\n\r\n")
        end = len(piece) if end < 0 else end
        pairs, n = {}, None
        for line in piece[:end].decode("utf-8", "replace").split("\r\n"):
            name, _, value = line.partition(":")
            if name := name.strip():
                pairs[name] = value = value.strip()
                if len(name) == 14 and name.lower() == "content-length":
                    n = int(value) if len(value) < 16 and value.isascii() and value.isdigit() else None
        return pairs, end + 4, n

    def _record(self, data: bytes, head: tuple[dict[str, str], int, int | None] | None = None) -> Iterator[tuple[dict[str, str], bytes, bool]]:
        pairs, at, n = head or self._head(data)
        if pairs:
            yield pairs, data[at:] if n is None else data[at : at + n], n is not None and len(data) >= at + n

    def piece(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
        if self.held:
            self.held.append(piece)
            self.size += len(self.gap) + len(piece)
            if self.size < self.want:
                return
            whole = self.gap.join(self.held)
            if not whole[self.want :].strip(b"\r\n"):
                self.held = []
                yield from self._record(whole)
                return
            self.held.pop()
            yield from self.end()  # the length ends within a record, so it is wrong
        else:
            piece = piece.removeprefix(self.prefix)
        head = self._head(piece)
        _, at, n = head
        if n and len(piece) < at + n:
            self.held, self.size, self.want = [piece], len(piece), at + n
        else:
            yield from self._record(piece, head)

    def end(self) -> Iterator[tuple[dict[str, str], bytes, bool]]:
        """What is held is not whole; the pieces after its first one are records of their own."""
        held, self.held = self.held, []
        for x in held:
            yield from self._record(x)


def read(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """(headers, block, whole) of the records in WARC files of one version, plain or gzip.

    A block has the length that its header says, even if it holds what separates records. whole is false if a block is shorter, as where
    a file is cut off or a length is wrong; records after it are still read. Header names keep their case; of repeated names the last
    counts. Files without records give no rows. Gzip files are never split; of plain files, which are, only a block that holds a
    separator and lies across the border of two splits comes in pieces, the first of them not whole. A task holds one record, or what
    follows one whose length is far too great, at most a file's rest.
    """
    raw = spark.read.option("lineSep", f"{_END}{version}\r\n").text(path)
    raw = raw.select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("split"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple[dict[str, str], bytes, bool]]) -> pa.RecordBatch:
            made = [_to_maps([h for h, _, _ in found]), pa.array([b for _, b, _ in found], pa.binary()), pa.array([w for _, _, w in found], pa.bool_())]
            return pa.RecordBatch.from_arrays(made, names=["headers", "block", "whole"])

        frames, split = _Frames(version), None
        for batch in batches:
            found = []
            for x, at in zip(batch.column(0), batch.column(1).to_pylist()):
                if at != split:
                    found.extend(frames.end())
                    split = at
                found.extend(frames.piece(x.as_py() or b""))
            yield rows(found)
        yield rows([*frames.end()])

    return raw.mapInArrow(parse, f"{RECORD}, whole boolean")


def columns(records: DataFrame) -> DataFrame:
    """A record's common headers as columns, with the block's length and digest as computed from its bytes."""
    get = lambda name, alias: F.col("headers")[name].alias(alias)
    names = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("X-Source-Payload-Digest", "source_payload_digest")]
    kept = [x for x in records.columns if x not in ("headers", "block")]
    read_digest = F.concat(F.lit("sha256:"), F.sha2("block", 256)).alias("read_digest")
    return records.select(*kept, *[get(*x) for x in names], F.octet_length("block").cast("long").alias("content_length"), read_digest)
