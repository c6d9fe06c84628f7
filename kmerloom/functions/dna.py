"""DNA text as columns and as numpy arrays: encoding, reverse complement, breaks, hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64

#: 2-bit codes of the bases in either case; U counts as T; every other byte is a break.
CODES = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3}
BREAK = 4
CODE_OF_BYTE = np.full(256, BREAK, np.uint8)
for _base, _code in CODES.items():
    CODE_OF_BYTE[[ord(_base), ord(_base.lower())]] = _code
BASES = np.frombuffer(b"ACGT", np.uint8)

#: Fixed values of the 64-bit Murmur2 hash.
MURMUR_FACTOR, MURMUR_SHIFT = 0xC6A4A7935BD1E995, 47
DEFAULT_SEED = 42


def text_as_dna(text: Column) -> Column:
    """Any text as a sequence: letters become bases by their place in the alphabet, blanks and line feeds vanish, other characters are breaks."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    # what has no counterpart vanishes
    return F.translate(F.lower(text), letters + " \n", "".join("ACGT"[i % 4] for i in range(len(letters))))


def normalised(seq: Column) -> Column:
    """Upper case with T for U."""
    return F.translate(F.upper(seq), "U", "T")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(seq: Column) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


def packed(seq: Column) -> Column:
    """Up to 31 bases as a number, two bits a base, the first base highest."""
    return F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("long")


def murmur2(values: np.ndarray, seed: int = DEFAULT_SEED) -> np.ndarray:
    """64-bit Murmur2 of each value's eight bytes."""
    m, r = U64(MURMUR_FACTOR), U64(MURMUR_SHIFT)
    x = values.astype(U64) * m
    x ^= x >> r
    x *= m
    h = (x ^ U64(seed ^ (8 * MURMUR_FACTOR % (1 << 64)))) * m
    h ^= h >> r
    h *= m
    return h ^ (h >> r)


def random_order(values: np.ndarray, seed: int = DEFAULT_SEED) -> np.ndarray:
    """A cheaper order of m-mers: multiply and fold."""
    x = (values.astype(U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(32))


def lexicographic(values: np.ndarray, seed: int = DEFAULT_SEED) -> np.ndarray:
    """The order of the m-mers as text."""
    return values.astype(U64)


#: Minimizer orders by name; any function of packed m-mers and a seed can be added.
HASHERS = {"murmur2": murmur2, "random": random_order, "lexicographic": lexicographic}
