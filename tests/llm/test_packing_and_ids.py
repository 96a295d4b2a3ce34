import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmatch.llm import packing, simple8b, tokens

TEXTS = [
    "Hello world, it's 2024!  Two  spaces\n\n new\tlines \r\n end ", "", None, " ", "a", "naïve café Straße Ærø ǅ ß’s “quotes” — dash", "日本語 text 混ざる", "x" * 3000, "word " * 4000, "don't can't 'll we've I'M",
    "a b c\u0085d", "tail space ", "﻿bom", "emoji 👩‍👩‍👧 done", "numbers 1234567 12.5e-3", "<|endoftext|> inside", "ends with newline\n", "  lead", "a  b", "é" * 50,
]


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@pytest.mark.parametrize("text", TEXTS)
def test_word_encoder_equals_library(text):
    assert np.frombuffer(tokens.encoder().encode(text), "<u4").tolist() == ids(text)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab Z'sé\n\t.,1ß日  - "), max_size=40))
def test_word_encoder_equals_library_on_any_text(text):
    assert np.frombuffer(tokens.encoder().encode(text), "<u4").tolist() == ids(text)


def table(spark, extra=0):
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, "x"), (3, "again three", 1, "x"), (3, "again three", 1, "x")]
    rows += [(100 + i, "w " * random.Random(i).randint(0, 300), 0, "x") for i in range(extra)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, ids string"), [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("parts", [1, 9])
def test_packing_places_each_id_once(spark, parts):
    docs, rows = table(spark, 300)
    pieces = packing.pack(docs.repartition(parts), windows=4, fan_in=2).collect()
    want = sorted((i is None, i or 0, tuple(ids(t)) + (0,)) for i, t in rows)
    sequences, whole = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        whole.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"], p["ids_crc32"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    assert sum(p["length"] for p in pieces) == sum(len(x[2]) for x in want)
    copies = Counter((i, len(own)) for i, own in ((i, (*ids(t), 0)) for i, t in rows))
    texts = {(i, len(own)): own for i, own in ((i, (*ids(t), 0)) for i, t in rows)}
    assert len({(i, tuple(ids(t))) for i, t in rows}) == len(texts)  # so rows with one id and length are repeats
    assert set(whole) == set(copies)
    for key, own in texts.items():
        covered = Counter()
        for start, length, check in whole[key]:
            assert check == crc(own[start : start + length])
            covered.update(range(start, start + length))
        assert covered == Counter({k: copies[key] for k in range(len(own))})
    full = sum(p["length"] for p in pieces) / 1024
    assert len(sequences) <= full * 1.02 + parts / 2 + 1 + parts * 4 * 16 / 1024


def test_packing_an_empty_table_and_bad_size(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert packing.pack(none).isEmpty()
    for bad in ({"size": 0}, {"windows": 0}, {"fan_in": -1}):
        with pytest.raises(ValueError, match="one at least"):
            packing.pack(none, **bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 17), st.integers(0, (1 << 64) - 1), st.just(1 << 60)), max_size=400))
def test_simple8b_round_trip(values):
    words = simple8b.encode(np.array(values, np.uint64))
    assert simple8b.decode(words).tolist() == values


def test_simple8b_packs_small_values():
    assert len(simple8b.encode(np.zeros(600, np.uint64))) == 10 and len(simple8b.encode(np.full(60, 50_000, np.uint64))) == 20
    assert len(simple8b.encode(np.array([1 << 60], np.uint64))) == 2 and len(simple8b.encode(np.zeros(0, np.uint64))) == 0


def test_damaged_block():
    data = simple8b.pack_block(np.arange(1000))
    assert simple8b.unpack_block(data).tolist() == [*range(1000)]
    with pytest.raises(ValueError, match="damaged"):
        simple8b.unpack_block(data[:-1] + bytes([data[-1] ^ 1]))


def test_files_hold_every_document_in_order(spark):
    docs, rows = table(spark)
    path = simple8b.write_ids(docs.repartition(5))
    got = sorted(simple8b.digest_ids(spark, path).collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for x in got:
        assert x["start"] == at
        at += x["n_tokens"]
    want = sorted((i is not None, i or 0, len(ids(t)) + 1, crc(ids(t) + [2])) for i, t in rows)
    assert sorted((x["doc_id"] is not None, x["doc_id"] or 0, x["n_tokens"], x["ids_crc32"]) for x in got) == want
    whole = {x["start"]: x["ids"] for x in simple8b.read_ids(spark, path).collect()}
    assert all(crc(whole[x["start"]]) == x["ids_crc32"] for x in got)


def test_files_of_an_empty_table(spark):
    assert simple8b.digest_ids(spark, simple8b.write_ids(spark.createDataFrame([], "doc_id long, text string"))).isEmpty()
