"""Word splitting shared by the operators, as Column expressions and as numpy code.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. ``bytes.split()`` separates on exactly those
six ASCII characters, and ``bytes.lower()`` lowers exactly A-Z, so both forms agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(text_or_empty(text), SPACE_CLASS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray, salt: np.ndarray | None = None) -> np.ndarray:
    """Bijective finaliser over uint64 (splitmix64), of x or of x + salt."""
    x = x.astype(np.uint64, copy=True) if salt is None else x + salt
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        take = min(filled, n - filled)
        step = np.uint64(pow(base, filled, 1 << 64))
        out[filled : filled + take] = out[:take] * step
        filled += take
    return out


class RangeHash:
    """64-bit hashes of any byte range of one buffer from two polynomial prefix sums mod 2**64.

    The sums live in arrays that the process uses again, as fresh ones cost more than the sums: only the
    latest instance can be asked.
    """

    BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
    TABLES = tuple(mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(m)) | np.uint64(1) for m in (0xA24BAED4963EE407, 0x9FB21C651E98DF25))
    _cache: dict[tuple[int, int], np.ndarray] = {}
    _arrays: list[np.ndarray] = [np.empty(0, np.uint64)] * 3
    _latest: RangeHash | None = None

    def __init__(self, data: np.ndarray, two: bool = True) -> None:
        n = len(data)
        self.n = n
        self.prefix, self.inverse = [], []
        RangeHash._latest = self
        for k in range(2 if two else 1):
            terms, total = self._array(0, n), self._array(k + 1, n + 1)
            np.take(self.TABLES[k], data, out=terms, mode="clip")
            terms *= self._power(n + 1, self.BASES[k], k)[:n]
            total[0] = 0
            np.cumsum(terms, out=total[1:])
            self.prefix.append(total)
            self.inverse.append(self._power(n + 1, pow(self.BASES[k], -1, 1 << 64), k + 2))

    @classmethod
    def _array(cls, slot: int, n: int) -> np.ndarray:
        if len(cls._arrays[slot]) < n:
            cls._arrays[slot] = np.empty(max(n, 1 << 16), np.uint64)
        return cls._arrays[slot][:n]

    @classmethod
    def _power(cls, n: int, base: int, slot: int) -> np.ndarray:
        have = cls._cache.get((slot, 0))
        if have is None or len(have) < n:
            have = cls._cache[(slot, 0)] = _powers(max(n, 1 << 16), base)
        return have[:n]

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of data[start:end] for arrays of offsets; equal ranges hash alike wherever they stand."""
        if RangeHash._latest is not self:
            raise RuntimeError("only the latest RangeHash of a process can be asked")
        out = (end - start).astype(np.uint64)
        out *= np.uint64(0x9E3779B97F4A7C15)
        for total, inverse in zip(self.prefix, self.inverse, strict=True):
            part = total[end]
            part -= total[start]
            part *= inverse[start]
            out = mix64(part, out)
        return out


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte buffer."""
    gap = np.ones(len(data) + 2, bool)
    inside = gap[1:-1]
    np.less_equal(data - np.uint8(9), np.uint8(4), out=inside)  # the bytes 9 to 13; smaller ones wrap around
    inside |= data == 32
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]
