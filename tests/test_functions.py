import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmatch.functions import bits, codec, distance


def osa(a, b):
    rows = [[*range(len(b) + 1)]]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            best = min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def word(r, n=7, letters="abc"):
    return "".join(r.choice(letters) for _ in range(r.randint(0, n)))


def test_osa_equals_brute_force(spark):
    r = random.Random(1)
    pairs = [(word(r), word(r)) for _ in range(400)] + [("", ""), ("", "ab"), ("ca", "abc"), ("é", "e")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", distance.osa("a", "b").alias("d"), *[distance.within("a", "b", k).alias(f"k{k}") for k in (1, 2, 3)]).collect()
    for a, b, d, *bounded in got:
        assert d == osa(a, b), (a, b)
        assert bounded == [d if d <= k else None for k in (1, 2, 3)], (a, b)


def test_osa_of_null_is_null(spark):
    got = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string").select(distance.within("a", "b", 2)).collect()
    assert [x[0] for x in got] == [None, None]


def test_swap_is_not_edited_again(spark):
    pairs = [("bxa--", "ab--"), ("-bxa-", "-ab-"), ("--bxa", "--ab")]
    got = spark.createDataFrame(pairs, "a string, b string").select(distance.within("a", "b", 2)).collect()
    assert [x[0] for x in got] == [None] * 3


def test_common_prefix_and_log2(spark):
    rows = [("abc", "abd", 1), ("", "x", 0), ("ab", "abc", 2), ("same", "same", 1023), ("é1", "é2", 1024), (None, "a", 3)]
    got = spark.createDataFrame(rows, "a string, b string, n bigint").select(distance.common_prefix_length("a", "b"), distance.floor_log2("n")).collect()
    assert [tuple(x) for x in got] == [(2, 0), (0, 0), (2, 1), (4, 9), (1, 10), (None, 1)]


def test_deletions(spark):
    got = spark.createDataFrame([("aab",), ("",)], "t string").select(distance.deletions("t", 1), distance.deletions("t", 2)).collect()
    assert sorted(got[0][0]) == ["aa", "aab", "ab"] and sorted(got[0][1]) == ["a", "aa", "aab", "ab", "b"]
    assert got[1][0] == [""] and got[1][1] == [""]


def test_bits(spark):
    x = 0x1234_5678_9ABC_DEF0
    row = spark.createDataFrame([(x, 0x80000001, -5)], "x bigint, u bigint, n bigint").select(bits.rotate_right_64(F.col("x"), 8), bits.rotate_right_32(F.col("u"), 1), bits.swap_outer_16(F.col("x")), bits.positive_or_zero(F.col("n")), bits.absolute(F.col("n")), bits.smaller(F.col("n"), F.col("u")), bits.rotate_right_32(F.col("u"), 32)).first()
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert tuple(row) == (signed((x >> 8 | x << 56) & (1 << 64) - 1), 0xC0000000, signed(0xDEF0_0000_0000_1234), 0, 5, -5, 0x80000001)


@given(st.lists(st.integers(0, (1 << 64) - 1)), st.lists(st.integers(-(1 << 63), (1 << 63) - 1)), st.text())
def test_codec_round_trip(unsigned, signed, text):
    ascending = sorted(unsigned)
    at = codec.Cursor(codec.pack_unsigned_array(unsigned) + codec.pack_signed_array(signed) + codec.pack_ascending_array(ascending) + codec.pack_text(text.encode("utf-8", "ignore").decode()))
    assert (at.unsigned_array(), at.signed_array(), at.ascending_array(), at.text()) == (unsigned, signed, ascending, text.encode("utf-8", "ignore").decode())


def test_codec_bytes():
    assert codec.pack_unsigned(300) == b"\xac\x02" and codec.pack_signed(-1) == b"\x41" and codec.pack_signed(64) == b"\xc0\x00" and codec.pack_signed(codec.LEAST) == b"\x40"
    assert [codec.Cursor(codec.pack_unsigned(x)).unsigned() for x in (0, 63, 64, 127, 128, 192, 16384, 65535)] == [0, 63, 64, 127, 128, 192, 16384, 65535]
    with pytest.raises(EOFError):
        codec.Cursor(b"\x80").unsigned()
    with pytest.raises(ValueError, match="negative"):
        codec.pack_unsigned(-1)
