"""OSA distances of many pairs of words at once in NumPy, for Arrow passes.

A column of the edit matrix is two 64-bit words of differences (Hyyrö 2003), so a letter costs some operations on arrays of pairs instead of a
fold over a row. Pairs are proposed by length and by sets of letters, which lose none, and every proposed pair is measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs measured at once, whose arrays fit a core's cache; cells of a table of letter sets; entries of a table of letters' places.
PAIRS, CELLS, PLACES = 1 << 14, 1 << 17, 1 << 22
_ONE = np.uint64(1)


class Words:
    """Words as one array of code points, with each one's start and length."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each letter (by its code modulo 32) occurs, up to four times, as 128 bits in two arrays; an edit changes two bits at most, an insertion or deletion one.

        A letter's occurrences set one more of its bits each: two in the first array, then two in the second.
        """
        bits, seen = np.zeros((2, len(self.words)), np.uint64), np.zeros((len(self.words), 32), np.uint8)
        for j in range(int(self.size.max(initial=0))):
            at = np.flatnonzero(self.size > j)
            letter = self.codes[self.start[at] + j] % 32
            n = seen[at, letter]
            seen[at, letter] = np.minimum(n + 1, 4)
            for half in (0, 1):
                own = n // 2 == half
                bits[half, at[own]] |= _ONE << (letter[own] + 32 * (n[own] % 2)).astype(np.uint64)
        return bits[0], bits[1]


def _osa(a: str, b: str) -> int:
    """Of one pair, for words too long for a machine word."""
    two, one = [], [*range(len(b) + 1)]
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = min(row[j] + 1, one[j + 1] + 1, one[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, two[j - 1] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def osa(queries: Words, terms: Words, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The OSA distance of each pair of a query and a term, given by their places in queries and terms."""
    out, fits = np.empty(len(q), np.int64), queries.size[q] <= 64
    for i in np.flatnonzero(~fits):
        out[i] = _osa(queries.words[q[i]], terms.words[t[i]])
    whole, ids = np.flatnonzero(fits), None
    for part in (whole[i : i + PAIRS] for i in range(0, len(whole), PAIRS)):
        used, own = np.unique(q[part], return_inverse=True)
        if ids is None or len(used) > len(held) or not np.isin(used, held, assume_unique=True).all():
            held, ids, places, width = _places(queries, terms, np.unique(q[whole]), used)
        out[part] = _columns(queries, terms, q[part], t[part], ids, places, np.searchsorted(held, used)[own] * width)
    return out


def _places(queries: Words, terms: Words, every: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For every query, or those in use where that table would be too large: (queries, letter id of each code of terms, bits of a letter's places by query and id, ids)."""
    for chosen in (every, used):
        size = queries.size[chosen]
        row = np.repeat(np.arange(len(chosen)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        code = queries.codes[np.repeat(queries.start[chosen], size) + place]
        alphabet = np.unique(code)
        if len(chosen) * (len(alphabet) + 1) <= PLACES:
            break
    ids = np.searchsorted(alphabet, terms.codes)
    ids[ids == len(alphabet)] = 0
    ids = np.where(alphabet[ids] == terms.codes, ids + 1, 0) if len(alphabet) else np.zeros(len(terms.codes), np.int64)
    places = np.zeros(len(chosen) * (len(alphabet) + 1), np.uint64)
    np.bitwise_or.at(places, row * (len(alphabet) + 1) + np.searchsorted(alphabet, code) + 1, _ONE << place.astype(np.uint64))
    return chosen, ids, places, len(alphabet) + 1


def _columns(queries: Words, terms: Words, q: np.ndarray, t: np.ndarray, ids: np.ndarray, places: np.ndarray, row: np.ndarray) -> np.ndarray:
    """osa() of pairs whose queries have at most 64 letters. Longer terms come first, so those with a letter left are a slice."""
    order = np.argsort(-terms.size[t], kind="stable")
    n, m, start, row = terms.size[t[order]], queries.size[q[order]], terms.start[t[order]], row[order]
    found = m.copy()
    top = np.where(m > 0, _ONE << (np.maximum(m, 1) - 1).astype(np.uint64), np.uint64(0))
    up, down, same, before = np.full(len(q), ~np.uint64(0)), *np.zeros((3, len(q)), np.uint64)
    for j in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -j))
        up, down, same, before = up[:k], down[:k], same[:k], before[:k]
        here = places[row[:k] + ids[start[:k] + j]]
        swap = ((~same & here) << _ONE) & before
        same = (((here & up) + up) ^ up) | here | down | swap
        more, less = down | ~(same | up), same & up
        found[:k] += (more & top[:k]) != 0
        found[:k] -= (less & top[:k]) != 0
        more, less = (more << _ONE) | _ONE, less << _ONE
        up, down, before = less | ~(same | more), more & same, here
    out = np.empty(len(q), np.int64)
    out[order] = np.where(m > 0, found, n)
    return out


def near(queries: Words, terms: Words, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in queries, places in terms, distance) of all pairs within k edits, some ten thousand at a time."""
    (qa, qb), (ta, tb) = queries.letters(), terms.letters()
    by_query, by_term = np.argsort(queries.size, kind="stable"), np.argsort(terms.size, kind="stable")
    lengths, sizes = queries.size[by_query], terms.size[by_term]
    held, n = [], 0

    def measured() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, t = (np.concatenate(x) for x in zip(*held))
        distance = osa(queries, terms, q, t)
        good = distance <= k
        return q[good], t[good], distance[good]

    for length in np.unique(sizes):
        own = by_term[np.searchsorted(sizes, length) : np.searchsorted(sizes, length, "right")]
        asked = by_query[np.searchsorted(lengths, length - k) : np.searchsorted(lengths, length + k, "right")]
        wide = max(1, min(len(own), CELLS // max(1, min(len(asked), 64))))
        high = max(1, CELLS // wide)
        for t in (own[i : i + wide] for i in range(0, len(own), wide)):
            for q in (asked[i : i + high] for i in range(0, len(asked), high)):
                apart = np.bitwise_count(qa[q, None] ^ ta[t]) + np.bitwise_count(qb[q, None] ^ tb[t])
                i, j = np.nonzero(apart <= (2 * k - np.abs(queries.size[q] - length))[:, None])
                held.append((q[i], t[j]))
                n += len(i)
                if n >= 4 * PAIRS:
                    yield measured()
                    held, n = [], 0
    if n:
        yield measured()


def prefix(k: int) -> int:
    """Letters of a word's start from which its keys are made."""
    return 2 * k + 3


def keys(words: Words, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, keys): a key is a hash of what up to k deletions leave of a word's prefix. A word has a key for each choice of letters, equal ones too."""
    held = np.minimum(words.size, prefix(k))
    for length in np.unique(held):
        own = np.flatnonzero(held == length)
        letters = [(words.codes[words.start[own] + p].astype(np.uint64) + _ONE) * np.uint64(0x9E3779B97F4A7C15) for p in range(int(length))]
        todo = [(0, k, np.zeros(len(own), np.uint64))]
        while todo:
            p, left, found = todo.pop()
            if p == length:
                yield own, found ^ (found >> np.uint64(29))
                continue
            if left:
                todo.append((p + 1, left - 1, found))
            todo.append((p + 1, left, (found + letters[p]) * np.uint64(0xD6E8FEB86659FD93)))


class Keys:
    """The keys of queries, to be met by those of terms. A table of the keys' top bits rules nearly all others out."""

    TOP = 22

    def __init__(self, queries: Words, k: int) -> None:
        made = [*keys(queries, k)]
        own, key = (np.concatenate([x[i] for x in made]) if made else np.zeros(0, t) for i, t in ((0, np.int64), (1, np.uint64)))
        order = np.lexsort((own, key))
        own, key = own[order], key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        self.queries, self.k, self.own, self.key = queries, k, own[fresh], key[fresh]
        self.seen = np.zeros(1 << self.TOP, bool)
        self.seen[self.key >> np.uint64(64 - self.TOP)] = True

    def near(self, terms: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in queries, places in terms, distance) of all pairs within k edits, each once."""
        held = []
        for own, key in keys(terms, self.k):
            at = np.flatnonzero(self.seen[key >> np.uint64(64 - self.TOP)])
            first, last = np.searchsorted(self.key, key[at]), np.searchsorted(self.key, key[at], "right")
            n = last - first
            q = self.own[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
            t = np.repeat(own[at], n)
            good = np.abs(self.queries.size[q] - terms.size[t]) <= self.k
            held.append(q[good] * len(terms.words) + t[good])
        pairs = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        for part in (pairs[i : i + 4 * PAIRS] for i in range(0, len(pairs), 4 * PAIRS)):
            q, t = part // len(terms.words), part % len(terms.words)
            distance = osa(self.queries, terms, q, t)
            good = distance <= self.k
            yield q[good], t[good], distance[good]
