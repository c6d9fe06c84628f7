"""Vectorised views of a batch of texts: word boundaries, 64-bit word hashes and shingle hashes, as flat numpy arrays."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64, for polynomial hashes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Most bytes of a substring whose hash is a polynomial.
SHORT = 256

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(BASE), of(INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least; sizes are rounded up so that batches share them."""
    return _powers(-(-n // (1 << 18)) << 18)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte * BASE**i before each position (length n + 1); a substring's hash is a difference times BASE**-start."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the substrings [start, end) of `data`.

    Polynomials modulo 2**64 tell short strings apart, but have collisions, whatever the base, from 1,024 bytes on (of strings that
    repeat their own complement). So substrings of more than SHORT bytes are hashed by BLAKE2; without `data` there may be none.
    """
    out = mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U64))
    long_ = np.flatnonzero(end - start > SHORT)
    if len(long_):
        if data is None:
            raise ValueError(f"substrings of more than {SHORT} bytes need the bytes themselves")
        whole = data.tobytes()
        digests = b"".join(hashlib.blake2b(whole[a:b], digest_size=8).digest() for a, b in zip(start[long_].tolist(), end[long_].tolist(), strict=True))
        out[long_] = np.frombuffer(digests, U64)
    return out


@dataclass
class Words:
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    doc: np.ndarray  # index of its text in the batch
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Maximal runs of bytes other than space and \\t..\\r; runs end with their text."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1 : n + 1] = ~SEPARATOR[data]
    edge = np.diff(inside)
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])  # where one text's last word touches the next one's first
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(cuts):
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    at = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    return Words(start, end, doc, at)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z to lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive words of each text, and each one's text; a text of 1 to k - 1 words is one shingle itself."""
    n, count = len(hashes), np.diff(bounds)
    total = np.zeros(n, U64)
    left = np.repeat(bounds[1:], count) - np.arange(n)  # words from here to the text's end
    for j in range(k):
        part = np.zeros(n, U64)
        part[: max(0, n - j)] = hashes[j:] if j else hashes
        total = np.where(left > j, mix(total * U64(3) + part + U64(j)), total)
    doc = np.repeat(np.arange(len(count)), count)
    first = np.arange(n) == np.repeat(bounds[:-1], count)
    keep = (left >= k) | (first & (left < k))
    return total[keep], doc[keep]


def code_points(data: np.ndarray) -> np.ndarray:
    """Running number of code points that begin before each byte (length n + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
