"""Interleaved document sequences with media columns.

HTML becomes an ordered list of text and media entries; a media entry carries its reference, alternative text and caption. Payloads
are kept apart, in a store keyed by the digest of their bytes, as lossless 8-bit greyscale PNG. A join on the digest resolves the
references; positions come from the sequence, so entries without a payload keep their place.

The heavy columns never move between tasks: payloads are written where the source is read, features are computed where the store is
read, and only digests and features meet in the join. A digest that a third of all entries share is a plain skewed join key, whose
partitions Spark can split.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmatch.llm import _common
from lexmatch.llm.html import Reader

UNIT, WIDTH = 576, 576
MEDIA_TAGS = frozenset({"img", "video", "audio", "source", "embed"})
_PNG = b"\x89PNG\r\n\x1a\n"
_REMEMBERED, _SLICE = 50_000, 256
ENTRY = "struct<pos:int,kind:string,text:string,ref:string,digest:string,caption:string>"
_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image whose samples are the payload's bytes in rows of WIDTH; its length must be a positive multiple of that."""
    height, rest = divmod(len(payload), WIDTH)
    if rest or not height:
        raise ValueError("a payload is a positive number of whole rows")
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The payload of an image that to_png() made; raises ValueError for a damaged one."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, size = 8, b"", None
    while at + 12 <= len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(media) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image")
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].tobytes()


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT or UNIT * (not data))


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit average hash over 8 by 8 equal spans of them."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    spans = samples[: len(samples) // 64 * 64].reshape(64, -1).mean(axis=1)
    bits = np.packbits(spans > spans.mean()).tobytes().hex()
    return f"{samples.mean():.4f}:{samples.std():.4f}:{-(share * np.log2(share)).sum() + 0.0:.4f}:{bits}"


def sequence(page: str | None) -> list[dict]:
    """Entries of a page in order. A caption is the text of the same figure's figcaption; it isn't an entry of its own."""
    reader = Reader(page, MEDIA_TAGS)
    figure, titled = [-1] * len(reader.elements), [False] * len(reader.elements)  # nearest figure, and whether in a figcaption
    for e in reader.elements:
        up = e.parent.order
        figure[e.order] = e.order if e.name == "figure" else figure[up] if up >= 0 else -1
        titled[e.order] = e.name == "figcaption" or up >= 0 and titled[up]
    at = lambda b: (figure[b.at.order], titled[b.at.order]) if b.at.order >= 0 else (-1, False)
    captions: dict[int, list[str]] = {}
    for b in reader.blocks:
        own, title = at(b)
        if b.media is None and own >= 0 and title:
            captions.setdefault(own, []).append(b.text)
    out: list[dict] = []
    for b in reader.blocks:
        own, title = at(b)
        if b.media is not None:
            given = b.media.attributes()
            ref = given.get("src") or given.get("data-src") or ""
            out.append({"kind": "media", "text": given.get("alt") or None, "ref": ref, "digest": digest_of(ref), "caption": " ".join(captions.get(own, [])) or given.get("title") or None})
        elif not (own in captions and title):
            out.append({"kind": "text", "text": b.text, "ref": None, "digest": None, "caption": None})
    return [{"pos": i, **x} for i, x in enumerate(out)]


def digest_of(ref: str) -> str | None:
    """SHA-256 named by a sha256: reference, or of a data: reference's bytes; none for other references and broken ones."""
    if m := re.fullmatch(r"sha256:([0-9A-Fa-f]{64})", ref):
        return m[1].lower()
    data = inline_payload(ref)
    return hashlib.sha256(data).hexdigest() if data is not None else None


def inline_payload(ref: str) -> bytes | None:
    if not ref[:5].lower() == "data:" or "," not in ref:
        return None
    head, body = ref.split(",", 1)
    try:
        return base64.b64decode(urllib.parse.unquote(body), validate=False) if head.lower().endswith(";base64") else urllib.parse.unquote_to_bytes(body)
    except ValueError:
        return None


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, entries): one row per page, entries in page order. Null, empty and broken pages give what can be read, perhaps nothing."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    entries = pa.list_(pa.struct([("pos", pa.int32()), *[(x, pa.string()) for x in ("kind", "text", "ref", "digest", "caption")]]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):  # the entries of a few pages at a time
                part = batch.slice(at, _SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sequence(x.as_py()) for x in part.column(1)], entries)], names=["id", "entries"])

    return rows.mapInArrow(read, f"id {dict(rows.dtypes)['id']}, entries array<{ENTRY}>")


def store(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Writes payloads (binary) padded as PNG to the shared folder: (digest of the padded payload, media). Nulls count as empty.

    A narrow pass. A task leaves out payloads that it has just stored, so hot copies are kept once or twice a task; readers of the
    store need one row of a digest.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        for batch in batches:
            digests, media = [], []
            for x in batch.column(0):
                payload = padded(x.as_py() or b"")
                key = hashlib.sha256(payload)
                if key.digest() in seen:
                    continue
                if len(seen) >= _REMEMBERED:
                    seen.clear()
                seen[key.digest()] = None
                digests.append(key.hexdigest())
                media.append(to_png(payload))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    rows = payloads.select(F.col(payload_col).cast("binary").alias("payload"))
    return _common.materialize(rows.mapInArrow(make, "digest string, media binary"), "media")[0]


def described(stored: DataFrame) -> DataFrame:
    """Per digest, from the stored bytes: payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes, media_sha256, feature."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                media = x.as_py()
                payload = from_png(media)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in _FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    found = stored.mapInArrow(read, _FEATURES)
    return found.groupBy("digest").agg(*[F.min(x).alias(x) for x in found.columns[1:]])


def resolve(documents: DataFrame, payloads: DataFrame) -> DataFrame:
    """documents (id, entries) as one row per entry, with payloads' columns joined by digest; unresolved entries keep theirs null.

    Entries stay aligned by (id, pos). Pages without entries have no rows. Entries without a digest, as all text, pass the join by.
    """
    entries = documents.select("id", F.explode("entries").alias("x")).select("id", "x.*")
    rest = entries.where("digest is null").select("*", *[F.lit(None).cast(kind).alias(x) for x, kind in payloads.dtypes if x != "digest"])
    return entries.where("digest is not null").join(payloads, "digest", "left").unionByName(rest)


def _page(text: Column, figure: Column) -> Column:
    """A page of the text's lines as paragraphs, with the figure after the first half of them."""
    plain = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(plain, "\n", -1)
    half = F.ceil(F.size(lines) / 2).cast("int")
    wrapped = lambda some: F.when(F.size(some) == 0, F.lit("")).otherwise(F.concat(F.lit("<p>"), F.array_join(some, "</p><p>"), F.lit("</p>")))
    return F.concat(F.lit("<article>"), wrapped(F.slice(lines, 1, half)), figure, wrapped(F.slice(lines, half + 1, F.size(lines))), F.lit("</article>"))


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document as an interleaved page: its lines as text entries and, after half of them, a media entry whose payload is its text.

    One row per row of docs: doc_id, n_bytes, described()'s columns, pos and caption (the id) of the media entry, n_texts and
    texts_sha256 (of the text entries, joined by newlines). Null and empty texts have no text entry and an empty payload; ids may be null or
    repeated; other columns are ignored.
    """
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    data = F.encode("text", "UTF-8")
    size = F.octet_length("text")
    fill = F.when(size == 0, F.lit(UNIT)).otherwise((UNIT - size % UNIT) % UNIT)
    digest = F.sha2(F.concat(data, F.unhex(F.repeat(F.lit("FF"), fill))), 256)
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    pages = held.select(F.struct("doc_id", size.cast("long").alias("n_bytes")).alias("page_id"), _page(F.col("text"), figure).alias("html"))
    texts = F.transform(F.filter("entries", lambda x: x["kind"] == "text"), lambda x: x["text"])
    whole = F.struct("id.doc_id", "id.n_bytes", F.size(texts).cast("long").alias("n_texts"), F.sha2(F.array_join(texts, "\n"), 256).alias("texts_sha256"))
    found = sequences(pages).select(whole.alias("id"), F.filter("entries", lambda x: x["kind"] == "media").alias("entries"))
    found, _ = _common.materialize(found, "entries")  # short rows, which the join reads twice; pages are read once
    features, _ = _common.materialize(described(store(held.select(data.alias("data")), "data")), "features")  # so the join reads plain tables, and hot digests can be split
    return resolve(found, features).select("id.doc_id", "id.n_bytes", *[x.split()[0] for x in _FEATURES.split(", ")[1:]], F.col("pos").cast("long").alias("pos"), "caption", "id.n_texts", "id.texts_sha256")
