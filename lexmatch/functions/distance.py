"""Edit distances and word scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NEVER = 1_000_000


def _positions(text: Column, first: int = 1) -> Column:
    """1..length, or from `first`; empty where that is beyond the end."""
    return F.when(F.length(text) >= first, F.sequence(F.lit(first), F.length(text))).otherwise(F.array().cast("array<int>"))


def osa(a: Column | str, b: Column | str) -> Column:
    """Optimal string alignment distance: insertions, deletions, substitutions and swaps of neighbours, no part edited twice.

    A row of the edit matrix is an array; a fold over a's letters keeps the last two rows, a fold over b's letters makes the next.
    Null if either is null. For a bound on the distance within() is much cheaper.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    first = F.when(F.length(b) > 0, F.sequence(F.lit(0), F.length(b))).otherwise(F.array(F.lit(0)))
    letter = lambda text, i: F.substring(text, i, F.lit(1))

    def next_row(state: Column, i: Column) -> Column:
        one, two = state["one"], state["two"]

        def cell(row: Column, j: Column) -> Column:
            same = letter(a, i) == letter(b, j)
            swapped = (i > 1) & (j > 1) & (letter(a, i) == letter(b, j - 1)) & (letter(a, i - 1) == letter(b, j))
            swap = F.when(swapped, F.get(two, j - 2) + 1).otherwise(F.lit(_NEVER))
            best = F.least(F.get(row, j - 1) + 1, F.get(one, j) + 1, F.get(one, j - 1) + F.when(same, 0).otherwise(1), swap)
            return F.array_append(row, best)

        return F.struct(one.alias("two"), F.aggregate(_positions(b), F.array(i), cell).alias("one"))

    start = F.struct(F.lit(None).cast("array<int>").alias("two"), first.alias("one"))
    return F.aggregate(_positions(a), start, next_row, lambda s: F.get(s["one"], F.length(b)))


def _pairs(text: Column) -> Column:
    """Neighbouring letters that differ; only a swap of such a pair can beat plain edits."""
    every = F.transform(_positions(text, 2), lambda i: F.substring(text, i - 1, F.lit(2)))
    return F.filter(every, lambda x: F.substring(x, 1, 1) != F.substring(x, 2, 1))


def within(a: Column | str, b: Column | str, k: int) -> Column:
    """The OSA distance if it is at most k, else null.

    A swap is at most two plain edits, so a Levenshtein distance over 2k rules a pair out. Where no pair of neighbours in a stands
    reversed in b, no swap can take place and both distances are equal; the matrix is folded only for the pairs that remain.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    plain = F.levenshtein(a, b, 2 * k)
    may_swap = F.arrays_overlap(_pairs(a), F.transform(_pairs(b), F.reverse))
    exact = F.when(plain <= 1, plain).when(may_swap, osa(a, b)).otherwise(plain)
    return F.when((F.abs(F.length(a) - F.length(b)) <= k) & (plain >= 0) & (exact <= k), exact)


def common_prefix_length(a: Column | str, b: Column | str) -> Column:
    """Letters that both begin with."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    shorter = F.least(F.length(a), F.length(b))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    first = F.array_min(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(first - 1, shorter))


def floor_log2(x: Column | str) -> Column:
    """Exact floor of the binary logarithm of a positive whole number; 0 for 0."""
    return F.greatest(F.length(F.bin(x)) - 1, F.lit(0)).cast("long")


def deletions(text: Column | str, k: int) -> Column:
    """The different strings left by deleting up to k letters."""
    text = F.col(text) if isinstance(text, str) else text
    one = lambda t: F.transform(_positions(t), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    found = F.array(text)
    for _ in range(k):
        found = F.array_distinct(F.flatten(F.transform(found, lambda t: F.concat(F.array(t), one(t)))))
    return found
