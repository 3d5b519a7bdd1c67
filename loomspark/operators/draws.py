"""Hash draws for many places at once: md5 of a short prefix and the number of each place, as four 32-bit numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np

SHORT = 55  # bytes of a message of one block
AT_ONCE = 1 << 14
SINES = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5(words: np.ndarray) -> np.ndarray:
    """[4, n] state after the single blocks given as [16, n] little-endian words."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in START)
    for i in range(64):
        kind = i // 16
        f = (b & c) | (~b & d) if kind == 0 else (d & b) | (~d & c) if kind == 1 else b ^ c ^ d if kind == 2 else c ^ (b | ~d)
        f = f + a + SINES[i] + words[WORD[kind](i)]
        turn = TURNS[kind][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    return np.stack([x + s for x, s in zip((a, b, c, d), START, strict=True)])


def place_draws(prefix: str, n: int) -> np.ndarray:
    """[4, n]: the 8 hexadecimal digits each of md5(prefix + i) in order, as numbers, for the places 0 to n - 1."""
    head = prefix.encode()
    if len(head) + len(str(n)) > SHORT:
        every = b"".join(hashlib.md5(b"%s%d" % (head, i)).digest() for i in range(n))
        return np.frombuffer(every, ">u4").reshape(n, 4).T.astype(np.uint32)
    out = np.empty((4, n), np.uint32)
    digits, lo = 1, 0
    while lo < n:
        hi = min(n, 10**digits)
        for first in range(lo, hi, AT_ONCE):
            at = np.arange(first, min(hi, first + AT_ONCE))
            block = np.zeros((len(at), 64), np.uint8)
            size = len(head) + digits
            block[:, : len(head)] = np.frombuffer(head, np.uint8)
            for k in range(digits):
                block[:, size - 1 - k] = at // 10**k % 10 + 48
            block[:, size] = 0x80
            block[:, 56:58] = np.frombuffer((8 * size).to_bytes(2, "little"), np.uint8)
            out[:, at[0] : at[-1] + 1] = _md5(np.ascontiguousarray(block.view("<u4").T)).byteswap()
        digits, lo = digits + 1, hi
    return out
