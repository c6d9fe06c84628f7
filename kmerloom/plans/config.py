"""Options of an index."""

from __future__ import annotations

from dataclasses import dataclass

from kmerloom.functions.dna import DEFAULT_SEED, HASHERS

MAX_K, MAX_M = 63, 31
LAYOUTS = ("partitioned", "unpartitioned")


class OptionError(ValueError):
    """An option outside its range."""


@dataclass(frozen=True)
class Options:
    """k: bases of a k-mer; m: bases of a minimizer; layout: how codes are laid out; canonical: strands count as equal for minimizers."""

    k: int = 31
    m: int = 15
    seed: int = DEFAULT_SEED
    layout: str = "partitioned"
    hasher: str = "murmur2"
    canonical: bool = False
    #: Only for the space model: bits that a minimal perfect hash function takes a key.
    bits_per_key: float = 3.0

    def __post_init__(self):
        if not 1 <= self.k <= MAX_K:
            raise OptionError(f"k must be from 1 to {MAX_K}")
        if not 1 <= self.m <= min(self.k, MAX_M):
            raise OptionError(f"m must be from 1 to k and {MAX_M} at most")
        if self.layout not in LAYOUTS:
            raise OptionError(f"layout must be one of {', '.join(LAYOUTS)}")
        if self.hasher not in HASHERS:
            raise OptionError(f"hasher must be one of {', '.join(HASHERS)}")

    @property
    def window(self) -> int:
        """m-mers of a k-mer."""
        return self.k - self.m + 1
