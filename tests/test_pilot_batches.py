"""Pilots of many buckets are searched at a time."""

import numpy as np
import pytest

from kmerloom.operators import perfect_hash


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 1 << 15])
def test_pilots_of_a_partition(monkeypatch, n):
    hashes = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    hashes = np.unique(hashes)
    calls, real = [0], perfect_hash.xxhash

    def counted(*args):
        calls[0] += 1
        return real(*args)

    monkeypatch.setattr(perfect_hash, "xxhash", counted)
    n_keys, slots, dense, buckets, pilots, moved = perfect_hash._pilots(hashes)
    assert n_keys == len(hashes) and calls[0] < 200 + buckets // 4
    # every key's place, from the hash alone
    bucket = perfect_hash._bucket_of(hashes, dense, buckets)
    place = np.mod(real(pilots[bucket].astype(np.int64), real(hashes)).view(np.int64), slots)
    place = np.where(place < n_keys, place, np.append(moved, 0)[np.maximum(place - n_keys, -1)] if n else place)
    assert sorted(place.tolist()) == list(range(n_keys))
    # no larger pilots than when buckets were searched one by one: 1.92 bits a key as Rice codes then
    if n > 1000:
        assert min(int((pilots >> r).sum()) + buckets * (r + 1) for r in range(16)) / n < 2


def test_buckets_that_want_one_slot(monkeypatch):
    """Each bucket has slots of its own, whatever the batch; the first in order takes what it wants first."""
    taken, pilots = np.zeros(40, bool), np.full(38, -1, np.int32)
    own = perfect_hash.xxhash(np.arange(38))[:, None]
    monkeypatch.setattr(perfect_hash, "TRIED", 64)
    perfect_hash._settled(np.arange(38), own, taken, pilots)
    at = np.mod(perfect_hash.xxhash(pilots.astype(np.int64), own[:, 0]).view(np.int64), 40)
    assert len(set(at.tolist())) == 38 == np.count_nonzero(taken) and pilots[0] == 0
