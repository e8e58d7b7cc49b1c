"""Hash-based randomness: a draw depends only on (seed, keys), never on the
partitioning, so a re-run or a recomputed task gives the same result."""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, functions as F


def hash_int(*parts) -> Column:
    """48-bit non-negative integer from the '|'-joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    key = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint")


def pick(n: Column, *parts) -> Column:
    """Integer in [0, n)."""
    return F.pmod(hash_int(*parts), n.cast("bigint"))


_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(np.sin(i + 1)) * 2 ** 32) for i in range(64)]
BATCH = 16384              # messages hashed at once: their words stay in the cache
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_48(words: list[np.ndarray | np.uint32]) -> np.ndarray:
    """First 48 bits of the digests of one-block messages given as sixteen
    little-endian words, each an array over the messages or what broadcasts
    to it."""
    n = np.broadcast_shapes(*(np.shape(w) for w in words))
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(64):
            if i < 16:
                j = i
                np.bitwise_xor(c, d, out=f); f &= b; f ^= d
            elif i < 32:
                j = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f); f &= d; f ^= c
            elif i < 48:
                j = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f); f ^= d
            else:
                j = 7 * i % 16
                np.bitwise_not(d, out=f); f |= b; f ^= c
            f += a
            f += words[j] + np.uint32(_SINES[i])           # one number for most words
            np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=t)
            f <<= np.uint32(_SHIFTS[i])
            f |= t
            f += b
            a, d, c, b, f = d, c, b, f, a
    a, b = a + np.uint32(_START[0]), b + np.uint32(_START[1])
    return (a.byteswap().astype(np.int64) << 16) | ((b & 0xFF).astype(np.int64) << 8) | ((b >> 8) & 0xFF).astype(np.int64)


class HashTails:
    """`hash_int(*parts, tail)` for many tails at once inside a task. Their
    words are laid out once per length of the text before them."""

    def __init__(self, tails: list[str] | int):
        """Texts, or a count n for the numbers 0 to n - 1."""
        self.by_length, self.laid = [], {}
        if isinstance(tails, int):
            self.n, lo = tails, 0
            for m in range(1, len(str(max(self.n - 1, 0))) + 1):
                at = np.arange(lo, min(10 ** m, self.n))
                digits = np.empty((len(at), m), np.uint8)
                for j in range(m):
                    digits[:, j] = at // 10 ** (m - 1 - j) % 10 + 48
                self.by_length.append((m, at, digits))
                lo = 10 ** m
            return
        raw = [t.encode() for t in tails]
        lengths, self.n = np.array([len(t) for t in raw], np.int64), len(raw)
        for m in np.unique(lengths):
            at = np.flatnonzero(lengths == m)
            self.by_length.append((int(m), at, np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), m)))

    def _words(self, ahead: int) -> tuple[np.ndarray, list]:
        """Numbers of the tails that end in the first block, and its words."""
        if ahead not in self.laid:
            short = [x for x in self.by_length if ahead + x[0] <= 55]
            at = np.concatenate([np.empty(0, np.int64), *(x[1] for x in short)])
            first, last = ahead // 4, (ahead + max((x[0] for x in short), default=0)) // 4
            raw, bits, lo = np.zeros((len(at), 4 * (last - first + 1)), np.uint8), np.empty(len(at), np.uint32), 0
            for m, mine, tail in short:
                rows, end = slice(lo, lo + len(mine)), ahead + m
                raw[rows, ahead - 4 * first:end - 4 * first] = tail
                raw[rows, end - 4 * first] = 0x80
                bits[rows], lo = 8 * end, rows.stop
            words = [np.uint32(0)] * 16
            words[first:last + 1] = np.ascontiguousarray(raw.view("<u4").T)
            words[14] = bits
            self.laid = {ahead: (at, words)}
        return self.laid[ahead]

    def rows(self, heads: list[str]) -> np.ndarray:
        """A row of hashes for each text before the tails."""
        out, texts = np.empty((len(heads), self.n), np.int64), [h.encode() for h in heads]
        for ahead in sorted({len(t) for t in texts}) if self.n else ():
            mine = np.array([i for i, t in enumerate(texts) if len(t) == ahead])
            for m, at, tail in self.by_length:
                if ahead + m > 55:                 # more than one block
                    for r in mine:
                        start = hashlib.md5(texts[r])
                        for i, t in zip(at, tail):
                            one = start.copy()
                            one.update(t.tobytes())
                            out[r, i] = int.from_bytes(one.digest()[:6], "big")
            if all(ahead + m > 55 for m, _, _ in self.by_length):
                continue
            at, words = self._words(ahead)
            lead = np.stack([np.frombuffer(texts[r].ljust(64, b"\0"), "<u4") for r in mine])
            many, in_order = max(1, BATCH // len(at)), len(mine) == len(heads) and np.array_equal(at, np.arange(self.n))
            for r in range(0, len(mine), many):
                for i in range(0, len(at), BATCH):
                    block = lead[r:r + many]
                    hashed = _md5_48([(w[i:i + BATCH] if np.ndim(w) else w) | (v[0] if (v == v[0]).all() else v[:, None]) for w, v in zip(words, block.T)])
                    hashed = np.broadcast_to(hashed, (len(block), len(at[i:i + BATCH])))
                    if in_order:                   # rows and tails stand as they came
                        out[r:r + many, i:i + BATCH] = hashed
                    else:
                        out[np.ix_(mine[r:r + many], at[i:i + BATCH])] = hashed
        return out

    def hashes(self, *parts) -> np.ndarray:
        """Parts that are None are left out, as `concat_ws` does."""
        return self.rows(["".join(f"{p}|" for p in parts if p is not None)])[0]
