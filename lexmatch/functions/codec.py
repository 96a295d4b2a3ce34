"""Variable-length integers and length-prefixed arrays of the index file format.

Unsigned numbers go in groups of seven bits, lowest first, with the top bit set on all bytes but the last. Signed numbers do too, but
the last byte holds six bits and, in its 0x40 bit, the sign; a negative zero stands for the least 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

MORE, SIGN = 0x80, 0x40
LEAST = -(1 << 63)


def pack_unsigned(value: int) -> bytes:
    if value < 0:
        raise ValueError(f"{value} is negative")
    out = bytearray()
    while value >= MORE:
        out.append(value & 0x7F | MORE)
        value >>= 7
    out.append(value)
    return bytes(out)


def pack_signed(value: int) -> bytes:
    size = 0 if value == LEAST else abs(value)
    sign = SIGN if value < 0 else 0
    out = bytearray()
    while size >= SIGN:
        out.append(size & 0x7F | MORE)
        size >>= 7
    out.append(size | sign)
    return bytes(out)


class Cursor:
    """Reads from bytes; raises EOFError at the end of them."""

    def __init__(self, data: bytes) -> None:
        self._data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self._data):
            raise EOFError("the file ends too early")
        self.at += n
        return self._data[self.at - n : self.at]

    def _groups(self) -> Iterator[int]:
        while True:
            (byte,) = self.take(1)
            yield byte
            if byte < MORE:
                return

    def unsigned(self) -> int:
        return sum((byte & 0x7F) << 7 * i for i, byte in enumerate(self._groups()))

    def signed(self) -> int:
        *high, last = self._groups()
        size = sum((byte & 0x7F) << 7 * i for i, byte in enumerate(high)) + ((last & 0x3F) << 7 * len(high))
        if last & SIGN:
            return -size if size else LEAST
        return size

    def unsigned_array(self) -> list[int]:
        return [self.unsigned() for _ in range(self.unsigned())]

    def signed_array(self) -> list[int]:
        return [self.signed() for _ in range(self.unsigned())]

    def ascending_array(self) -> list[int]:
        total, out = 0, []
        for step in self.unsigned_array():
            total += step
            out.append(total)
        return out

    def text(self) -> str:
        size, letters = self.unsigned(), self.unsigned()
        found = bytes(self.take(size)).decode()
        if len(found.encode("utf-16-le")) != 2 * letters:
            raise ValueError("the text's length in the file isn't that of the text")
        return found


def pack_unsigned_array(values: Sequence[int]) -> bytes:
    return pack_unsigned(len(values)) + b"".join(map(pack_unsigned, values))


def pack_signed_array(values: Sequence[int]) -> bytes:
    return pack_unsigned(len(values)) + b"".join(map(pack_signed, values))


def deltas(values: Iterable[int]) -> list[int]:
    last, out = 0, []
    for x in values:
        out.append(x - last)
        last = x
    return out


def pack_ascending_array(values: Sequence[int]) -> bytes:
    return pack_unsigned_array(deltas(values))


def pack_text(text: str) -> bytes:
    data = text.encode()
    return pack_unsigned(len(data)) + pack_unsigned(len(text.encode("utf-16-le")) // 2) + data


def pack_many(values: np.ndarray, signed: bool = False) -> bytes:
    """The bytes of pack_unsigned or pack_signed of each of many 64-bit numbers, one after the other."""
    size = np.where(values == LEAST, 0, np.abs(values)).astype(np.uint64) if signed else values.astype(np.uint64)
    last, n = np.uint64(SIGN if signed else MORE), np.ones(len(size), np.int64)
    for i in range(9):
        n += size >> np.uint64(7 * i) >= last
    groups = np.empty((len(size), int(n.max(initial=0))), np.uint8)
    for i in range(groups.shape[1]):
        groups[:, i] = size >> np.uint64(7 * i) & np.uint64(0x7F)
        groups[:, i] |= np.where(i < n - 1, MORE, np.where(values < 0, SIGN, 0) if signed else 0).astype(np.uint8)
    return groups[np.arange(groups.shape[1]) < n[:, None]].tobytes()


def unpack_many(data: np.ndarray, at: int, n: int, signed: bool = False, block: int = 1 << 20) -> tuple[np.ndarray, int]:
    """n numbers from data, an array of bytes, from `at` on, and the place behind them. Raises EOFError at the end of data."""
    out, done = np.empty(n, np.int64), 0
    while done < n:
        part = data[at : at + block]
        ends = np.flatnonzero(part < MORE)[: n - done]
        if not len(ends):
            raise EOFError("the file ends too early")
        part = part[: ends[-1] + 1]
        starts = np.concatenate([[0], ends[:-1] + 1])
        bits = part & np.uint8(0x7F)
        if signed:
            bits[ends] &= np.uint8(SIGN - 1)
        place = np.arange(len(part)) - np.repeat(starts, ends - starts + 1)
        found = np.add.reduceat(bits.astype(np.uint64) << (7 * place).astype(np.uint64), starts).view(np.int64)
        if signed:
            negative = part[ends] & SIGN != 0
            found = np.where(negative, np.where(found == 0, LEAST, -found), found)
        out[done : done + len(ends)] = found
        done, at = done + len(ends), at + len(part)
    return out, at
