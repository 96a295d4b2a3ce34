import gzip
import hashlib
import json
import random
import time
import zlib
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmatch.llm import media, queries, sharding, warc

PAGES = [(1, "http://a.example/x?y", "<html><title>T &amp; t</title><body><p>One</p><p>two <b>three</b></p><a href='/l'>L</a></body></html>"), (2, None, None), (3, "http://b.example", ""), (3, "http://b.example", ""), (None, "http://é.example\nx", "<p>" + "long é " * 50_000)]


def pages(spark):
    return spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, block string")


def test_derivatives_link_to_their_response(spark):
    source = {x["headers"]["WARC-Record-ID"]: x for x in warc.responses(pages(spark)).collect()}
    found = warc.derive(warc.responses(pages(spark)).withColumn("more", F.lit(1))).collect()
    assert len(found) == 2 * len(PAGES)
    for x in found:
        h = x["headers"]
        own = source[h["WARC-Refers-To"]]
        status, http, payload = warc.http_parts(own["block"])
        assert status == "HTTP/1.1 200 OK" and http["content-type"].startswith("text/html") and h["X-Source-Payload-Digest"] == own["headers"]["WARC-Payload-Digest"] == warc.digest(bytes(payload))
        assert h["WARC-Block-Digest"] == warc.digest(bytes(x["block"])) and int(h["Content-Length"]) == len(x["block"]) and h["WARC-Record-ID"] != h["WARC-Concurrent-To"]
        if h["WARC-Type"] == "metadata":
            assert json.loads(x["block"])["source"] == own["headers"]
    one = {x["headers"]["WARC-Type"]: bytes(x["block"]) for x in found if x["key"] == 1}
    assert one["conversion"].decode() == "One\ntwo three\nL"
    assert json.loads(one["metadata"])["title"] == "T & t" and json.loads(one["metadata"])["links"] == ["/l"]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_round_trip(spark, tmp_path, compression):
    made = warc.derive(warc.responses(pages(spark))).repartition(3)
    extra = spark.createDataFrame([({"WARC-Type": "response", "Content-Length": "6"}, bytes([255, 0, 13, 10, 13, 10])), ({"WARC-Type": "metadata", "Content-Length": "0"}, None)], "headers map<string,string>, block binary")
    both = made.select("headers", "block").unionByName(extra)
    warc.write(both, str(tmp_path / "w"), compression)
    back = warc.read(spark, str(tmp_path / "w"))
    key = lambda x: (sorted(x["headers"].items()), bytes(x["block"] or b""))
    assert sorted(map(key, back.collect())) == sorted(map(key, both.collect())) and back.where("not whole").isEmpty()


def test_reads_records_that_others_wrote(spark, tmp_path):
    record = lambda kind, block: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    response = b"HTTP/1.0 404 Not Found\nContent-Type: text/plain; charset=latin-1\nA: 1\nA: 2\n\ncaf\xe9"
    data = [record("warcinfo", b"software: x\r\n"), record("response", response)]
    Path(tmp_path / "a.warc").write_bytes(b"".join(data))
    Path(tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))  # a member for each record
    got = warc.read(spark, str(tmp_path))
    assert sorted(x["headers"]["WARC-Type"] for x in got.collect()) == ["response", "response", "warcinfo", "warcinfo"] and all(x["whole"] for x in got.collect())
    made = [x for x in warc.derive(got.withColumn("key", F.lit(0).cast("long"))).collect()]
    assert len(made) == 4 and {bytes(x["block"]).decode() for x in made if x["headers"]["WARC-Type"] == "conversion"} == {"café"}
    info = json.loads(next(x["block"] for x in made if x["headers"]["WARC-Type"] == "metadata"))
    assert info["http"]["a"] == "1, 2" and info["status"].endswith("Not Found")
    Path(tmp_path / "a.warc").write_bytes(b"".join(data)[:-20])
    assert warc.read(spark, str(tmp_path / "a.warc")).where("not whole").count() == 1


def record(kind, block, size=None):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Length: {len(block) if size is None else size}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_blocks_that_hold_separators_stay_whole(spark, tmp_path, packed):
    nested = record("response", b"inner") + record("response", b"inner two")
    blocks = [b"one", nested, b"two\r\n\r\nWARC/1.1\r\n", b"\r\n\r\nWARC/1.1\r\n", b"", b"\r\n\r\n", nested * 3]
    data = b"".join(record("response", x) for x in blocks)
    for i in range(2):
        Path(tmp_path / f"{i}.warc{'.gz' * packed}").write_bytes(gzip.compress(data) if packed else data)
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted(bytes(x["block"]) for x in got) == sorted(blocks * 2) and all(x["whole"] for x in got)


def test_wrong_lengths_do_not_swallow_what_follows(spark, tmp_path):
    data = [record("response", b"first"), record("response", b"short", 9), record("response", b"third"), record("response", b"far", 10**9), record("response", b"fifth"), record("response", b"last")[:-6]]
    Path(tmp_path / "a.warc").write_bytes(b"".join(data))
    got = [(bytes(x["block"]), x["whole"]) for x in warc.read(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([(b"first", True), (b"short", False), (b"third", True), (b"far", False), (b"fifth", True), (b"la", False)])


def test_round_trip_of_a_page_that_holds_a_separator(spark, tmp_path):
    rows = [(1, "u", "<p>a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb</p>")] * 3
    made = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc.write(made, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(back) == 3 and all(x["whole"] and warc.digest(bytes(x["block"])) == x["headers"]["WARC-Block-Digest"] for x in back)


def test_no_two_records_share_an_id(spark):
    rows = [(None, None, "a"), (None, None, "b"), (1, "u", "c"), (1, "u", "c"), (None, None, None), (None, None, None)]
    made = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    named = [x["headers"]["WARC-Record-ID"] for x in made.collect()]
    derived = [x["headers"]["WARC-Record-ID"] for x in warc.derive(made).collect()]
    assert len(set(named)) == 6 and len(set(derived)) == 12
    bare = spark.createDataFrame([(1, None, b"x"), (1, None, b"x"), (2, {"WARC-Type": "response"}, None)], "key long, headers map<string,string>, block binary")
    assert len({x["headers"]["WARC-Record-ID"] for x in warc.derive(bare).collect()}) == 6


def test_codings_are_taken_off():
    page = b"<title>T</title><p>some text" + b" more" * 50
    chunked = b"".join(f"{len(page[i : i + 40]):x};ext=1\r\n".encode() + page[i : i + 40] + b"\r\n" for i in range(0, len(page), 40)) + b"0\r\n\r\n"
    assert warc.unchunked(chunked) == page and warc.unchunked(b"zz\r\nbroken") == b"zz\r\nbroken" and warc.unchunked(b"5\r\nab") == b"ab" and warc.unchunked(b"") == b""
    deflated = zlib.compress(page)[2:-4]
    for head, body in (("Transfer-Encoding: chunked", chunked), ("Content-Encoding: gzip", gzip.compress(page[:99]) + gzip.compress(page[99:])), ("Content-Encoding: deflate", zlib.compress(page)), ("Content-Encoding: deflate", deflated), ("Content-Encoding: gzip", page), ("Content-Encoding: br", page)):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{head}\r\n\r\n".encode() + body
        (_, info), (_, text) = warc.derivatives({"WARC-Record-ID": "x"}, block)
        assert text.decode() == "some text" + " more" * 50 and json.loads(info)["title"] == "T" and json.loads(info)["payload_bytes"] == len(body), head
    cut = f"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Encoding: gzip\r\n\r\n".encode() + gzip.compress(b"abc" * 1000)[:-9]
    assert warc.derivatives({}, cut)[1][1].startswith(b"abc")


def test_long_odd_pages_take_time_by_their_length():
    for piece in (b"<a ", b"<title>", b"<a href='", b"<a href=x>y", b"&amp"):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + piece * (1_000_000 // len(piece))
        began = time.process_time()
        warc.derivatives({}, block)
        assert time.process_time() - began < 10


class Plain(HTMLParser):
    """Title, links and text of a page by the standard library's parser, a line for each run between block tags."""

    def __init__(self, page):
        super().__init__()
        self.lines, self.title, self.links, self.inside = [""], None, [], ""
        self.feed(page)
        self.close()
        self.text = "\n".join(x for x in (" ".join(line.split()) for line in self.lines) if x)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.inside = tag
        if tag == "a":
            self.links.append(dict(attrs)["href"])
        if tag == "br":
            self.lines[-1] += " "
        elif tag not in ("a", "b"):
            self.lines.append("")

    def handle_endtag(self, tag):
        self.inside = ""
        if tag not in ("a", "b"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside == "title":
            self.title = " ".join(data.split())
        elif not self.inside:
            self.lines[-1] += data


def test_query_equals_a_plain_writer(spark, sf_dir):
    """Every record of the query against one made without the operator: block lengths and digests, links between records, source headers."""
    pages = {x["page_id"]: x for x in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op7_warc(spark, sf_dir).collect()
    assert len(got) == 2 * len(pages) and all(x["whole"] for x in got)
    by = {(x["page_id"], x["record_type"]): x for x in got}
    sha = lambda data: f"sha256:{hashlib.sha256(data).hexdigest()}"
    for i, page in pages.items():
        info, text = by[i, "metadata"], by[i, "conversion"]
        want = Plain(page["html"]).text.encode()
        assert text["read_digest"] == text["block_digest"] == sha(want) and text["content_length"] == len(want), i
        assert info["read_digest"] == info["block_digest"] and info["refers_to"] == text["refers_to"] and info["concurrent_to"] == text["record_id"] and text["concurrent_to"] == info["record_id"]
        assert text["source_payload_digest"] == info["source_payload_digest"] == sha(page["html"].encode()) and text["target_uri"] == page["url"]
    assert len({x["refers_to"] for x in got}) == len(pages) and len({x["record_id"] for x in got}) == len(got)
    for x in warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))).where("headers['WARC-Type'] = 'metadata'").collect():
        plain, info = Plain(pages[x["key"]]["html"]), json.loads(x["block"])
        assert info["title"] == plain.title and info["links"] == plain.links and info["http"]["content-type"] == "text/html; charset=utf-8" and info["source"]["WARC-Payload-Digest"] == sha(pages[x["key"]]["html"].encode())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses(none)).isEmpty() and media.sequences(none).isEmpty()
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert media.documents_as_media(docs).isEmpty() and sharding.assign(docs).isEmpty()


def test_png_round_trip():
    r = random.Random(0)
    for n in (576, 576 * 7):
        data = r.randbytes(n)
        image = media.to_png(data)
        assert media.from_png(image) == data
        with pytest.raises(ValueError, match="damaged"):
            media.from_png(image[:60] + bytes([image[60] ^ 1]) + image[61:])
    for n in (0, 575):
        with pytest.raises(ValueError, match="whole rows"):
            media.to_png(bytes(n))
    assert [len(media.padded(b"x" * n)) for n in (0, 1, 576, 577)] == [576, 576, 576, 1152]


def lines_around(text):
    """Text entries before and after the figure: the lines that aren't blank, white space reduced; the first half goes before."""
    lines = text.split("\n")
    half = -(-len(lines) // 2)
    return [[y for y in (" ".join(x.split()) for x in some) if y] for some in (lines[:half], lines[half:])]


def media_row(doc_id, text):
    raw = (text or "").encode()
    payload = media.padded(raw)
    image = media.to_png(payload)
    before, after = lines_around(text or "")
    return (
        doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(payload),
        len(before), None if doc_id is None else str(doc_id), len(before) + len(after), hashlib.sha256("\n".join(before + after).encode()).hexdigest(),
    )


def test_documents_as_media(spark):
    texts = [None, "", "é" * 288, "a" * 576, "b" * 577, "same", "same", "same", "x" * 200_000, "one\ntwo <b>&amp; three\n\n &lt;four \t five\nsix", "\n\n", "a\r\nb\n</p><img src=x>\n", "line\n" * 20_000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "same", "z"), (5, "same", "z")], "doc_id long, text string, digest string")
    got = [tuple(x) for x in media.documents_as_media(docs.repartition(4)).collect()]
    want = [media_row(i, t) for i, t in [*enumerate(texts), (None, "same"), (5, "same")]]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_media_query_equals_brute_force(spark, sf_dir):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(x) for x in queries.op8_media(spark, sf_dir).collect()]
    assert sorted(map(repr, got)) == sorted(repr(media_row(*x)) for x in rows)


def test_sequences_stay_aligned(spark):
    data = b"\x01\x02"
    inline = "data:application/octet-stream;base64,AQI="
    page = f"<p>First <img src='{inline}' alt='A'> then</p><figure><img src='sha256:{'ab' * 32}'><figcaption>The <i>cap</i></figcaption></figure><p>Last</p><img src='http://x/y.png' title='t'>"
    found = media.sequences(spark.createDataFrame([(1, page, 0), (2, None, 0), (None, "<p>t", 0)], "page_id long, html string, kind int"))
    rows = [tuple(e) for e in found.where("id = 1").first()["entries"]]
    digest = hashlib.sha256(data).hexdigest()
    assert [(e[0], e[1], e[2], e[4], e[5]) for e in rows] == [(0, "text", "First", None, None), (1, "media", "A", digest, None), (2, "text", "then", None, None), (3, "media", None, "ab" * 32, "The cap"), (4, "text", "Last", None, None), (5, "media", None, None, "t")]
    payloads = spark.createDataFrame([(digest, 7)], "digest string, size int")
    got = sorted((x["id"] or 0, x["pos"], x["size"]) for x in media.resolve(found, payloads).collect())
    assert got == [(0, 0, None), (1, 0, None), (1, 1, 7), (1, 2, None), (1, 3, None), (1, 4, None), (1, 5, None)]
    assert media.digest_of("data:,a%20b") == hashlib.sha256(b"a b").hexdigest() and media.digest_of("data:nothing") is None


def brute_shards(records, limit):
    """Splits oversized buckets one after another on the next bit of each record's address."""
    done, todo = {}, [("", records)]
    while todo:
        name, rows = todo.pop()
        if sum(n for _, n in rows) <= limit or len(rows) <= 1:
            done |= {name: rows} if rows else {}
            continue
        for bit in "01":
            todo.append((name + bit, [x for x in rows if x[0].startswith(name + bit)]))
    return done


def address(x):
    return f"{int(hashlib.md5(x.encode()).hexdigest()[:15], 16):060b}"


@pytest.mark.parametrize("limit", [100, 700, 5000, 10**9])
def test_shards_equal_splitting_one_by_one(spark, limit):
    r = random.Random(limit)
    rows = [(i, "é" * r.randint(0, 90), "s") for i in range(300)] + [(None, None, "s"), (1000, "big" * 1000, "s")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, shard string"), limit).collect()
    records = [(address("null" if i is None else str(i)), len((t or "").encode()) + 8) for i, t, _ in rows]
    want = brute_shards(records, limit)
    where = {a: name for name, xs in want.items() for a, _ in xs}
    assert len(got) == len(rows) and all(x["shard"] == where[address("null" if x["doc_id"] is None else str(x["doc_id"]))] and x["depth"] == len(x["shard"]) for x in got)


def test_a_hot_id_and_exact_repeats_still_split(spark):
    rows = [(7, f"text {i % 40} " + "w" * 50) for i in range(400)] + [(8, "same" * 20)] * 200 + [(i, "x") for i in range(100, 150)] + [(9, None)] * 100
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 600)
    assert found.count() == len(rows)
    for x in sharding.directory(found).collect():
        assert x["n_bytes"] <= 600 or x["n_docs"] == 1
    shards = sorted(x["shard"] for x in sharding.directory(found).collect())
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 100, "k") for i in range(60)], "doc_id long, text string, g string")
    sharding.write(docs, str(tmp_path / "s"), 1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(tuple, back.select("doc_id", "text", "g").collect())) == sorted(map(tuple, docs.collect())) and back.groupBy("_shard").count().where("count > 9").isEmpty()


def test_feature_is_of_the_samples():
    a = media.feature(bytes([0] * 288 + [255] * 288))
    assert a.startswith("127.5000:127.5000:1.0000:00000000ffffffff") and media.feature(bytes(576)) == "0.0000:0.0000:0.0000:0000000000000000"
    assert np.isclose(float(media.feature(bytes(range(256)) * 9).split(":")[2]), 8)
