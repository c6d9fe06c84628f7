"""Minimal perfect hash functions that store no keys, built and probed in partitions of their own.

Keys are k-mers as numbers. A seeded 64-bit hash deals them into partitions of about `size` keys, each built by one task from
the hashes alone; a function is a table of one row a partition, and a key's code is its partition's offset and its place
there. A probe is one equi-join by partition and built-in functions of the key's hash. Keys outside the set get any code, or null.

* Pilots: the keys of a partition fall into small buckets; from the largest on, each bucket gets the least pilot number whose
  hashes put all its keys on free slots, many buckets of one size at a time. There are a few more slots than keys, and the slots beyond are sent to free ones below.
* Cascade: on each level the keys that are left are hashed into gamma slots a key; those alone in a slot stay, marked in a
  bitmap. A probe walks the levels to the first mark, and its place is the number of marks before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.ranking import running_sum
from kmerloom.storage import discarded, staged

U64 = np.uint64
#: The 64-bit xxHash's primes, as Spark's xxhash64() has them.
PRIMES = tuple(map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)))
SPARK_SEED = U64(42)

#: Keys of a partition, keys of a bucket on average, slots a key, and the share of keys that the dense third of the buckets gets.
SIZE, BUCKET, ROOM, DENSE = 1 << 15, 4, 1.03, 0.6
#: Pilots that are tried at a time: of all buckets, and of each.
TRIED, MIN_TRIED, MAX_TRIED = 1 << 15, 8, 1 << 10
PILOTS = "shard long, n long, slots long, dense long, buckets long, pilots array<int>, moved array<int>"
CASCADE = "shard long, n long, sizes array<int>, starts array<int>, bits array<long>, ranks array<int>, rest array<long>"


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << U64(bits) | x >> U64(64 - bits)


def xxhash(values: np.ndarray, seeds: np.ndarray | np.uint64 = SPARK_SEED) -> np.ndarray:
    """64-bit xxHash of each value's eight bytes, as unsigned numbers; equal to Spark's xxhash64() of longs."""
    p1, p2, p3, p4, p5 = PRIMES
    with np.errstate(over="ignore"):
        h = np.asarray(seeds, U64) + p5 + U64(8)
        h = h ^ _turned(np.asarray(values).astype(U64) * p2, 31) * p1
        h = _turned(h, 27) * p1 + p4
        h = (h ^ h >> U64(33)) * p2
        h = (h ^ h >> U64(29)) * p3
        return h ^ h >> U64(32)


def _below(hashes: np.ndarray, n: int) -> np.ndarray:
    """Places from 0 to n - 1, as pmod of a signed number gives them."""
    signed = hashes.view(np.int64)
    return signed - signed // n * n  # several times as fast as np.mod()


@dataclass
class Function:
    """A built function: its kind, its table with a row a partition (and `base`), and how keys are dealt."""

    kind: str
    table: DataFrame
    parts: int
    seed: int
    n_keys: int


def _hash(kmer: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), kmer)


def _shard(parts: int, h: Column | str = "h") -> Column:
    return F.pmod(F.shiftright(F.xxhash64(h, F.lit(1).cast("long")), 8), F.lit(parts).cast("long"))


def _built(kmers: DataFrame, kind: str, schema: str, make, seed: int, size: int, distinct: bool) -> Function:
    given = kmers.where("kmer is not null").select("kmer")
    keys = (given if distinct else staged(given.distinct(), "keys", "zstd")).select(_hash("kmer", seed).alias("h"))
    n = keys.count()
    parts = max(1, -(-n // size))

    def run(group: pa.Table) -> pa.Table:
        hashes = group.column("h").combine_chunks().to_numpy().view(U64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two k-mers have one 64-bit hash; take another seed")
        row = make(np.sort(hashes))
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
        values = [group.column("shard")[0].as_py(), *row]
        return pa.table([pa.array([v], kinds[x.split()[1]]) for v, x in zip(values, schema.split(", "), strict=True)], names=names)

    table = staged(keys.withColumn("shard", _shard(parts)).groupBy("shard").applyInArrow(run, schema), "shards", "zstd")
    if not distinct:
        discarded(keys)
    bases = running_sum(table.select("shard", F.col("n").alias("width")), ["shard"], "width", "base").select("shard", "base")  # a row a partition
    return Function(kind, table.join(bases, "shard"), parts, seed, n)


# pilots


def _bucket_of(hashes: np.ndarray, dense: int, buckets: int) -> np.ndarray:
    other = xxhash(hashes)
    crowded = np.mod((other >> U64(40)).astype(np.int64), 100) < 100 * DENSE
    return np.where(crowded, _below(other, dense), dense + _below(other, max(1, buckets - dense)))


def _free(own: np.ndarray, first: np.ndarray, width: int, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, pilot, slots): of buckets with the keys `own`, a row each, those that one of the `width` pilots from `first` on puts on free slots, and the least such pilot. Each key meets those pilots only that the keys before leave."""
    tried = first[:, None] + np.arange(width)
    at = _below(xxhash(tried, own[:, :1]), len(taken))
    row, column = np.nonzero(~taken[at])
    tried, slots = tried[row, column], at[row, column][:, None]
    for i in range(1, own.shape[1]):
        at = _below(xxhash(tried, own[row, i]), len(taken))
        stay = np.flatnonzero(~taken[at] & (slots != at[:, None]).all(axis=1))
        row, tried, slots = row[stay], tried[stay], np.column_stack([slots[stay], at[stay]])
    bucket, least = np.unique(row, return_index=True)
    return bucket, tried[least], slots[least]


def _settled(left: np.ndarray, own: np.ndarray, taken: np.ndarray, pilots: np.ndarray) -> None:
    """Give the buckets `left`, with as many keys each, `own`, their pilots, and take their slots. Many are tried at a time; of those that want one slot the first has it, and the others go on."""
    first, owner = np.zeros(len(left), np.int64), np.zeros(len(taken), np.int64)
    while len(left):
        # about as many pilots as a bucket needs
        need = (len(taken) / max(1, len(taken) - np.count_nonzero(taken))) ** own.shape[1]
        width = int(min(max(need, MIN_TRIED), MAX_TRIED))
        step, done = max(1, TRIED // width), np.zeros(len(left), bool)
        for low in range(0, len(left), step):
            bucket, tried, slots = _free(own[low : low + step], first[low : low + step], width, taken)
            bucket += low
            first[low : low + step] += width
            first[bucket] = tried
            owner[slots[::-1].ravel()] = np.repeat(bucket[::-1], slots.shape[1])  # the first of those that want a slot is written last
            mine = (owner[slots] == bucket[:, None]).all(axis=1)
            taken[slots[mine]], pilots[left[bucket[mine]]], done[bucket[mine]] = True, tried[mine], True
        left, own, first = left[~done], own[~done], first[~done]


def _pilots(hashes: np.ndarray) -> tuple:
    n = len(hashes)
    slots, buckets = max(n, int(ROOM * n)), max(2, n // BUCKET)
    dense = max(1, buckets // 3)
    bucket = _bucket_of(hashes, dense, buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    inner = xxhash(hashes)  # the state that a pilot's hash goes on from
    taken, pilots = np.zeros(slots, bool), np.zeros(buckets, np.int32)
    sizes = np.diff(bounds)
    for size in np.unique(sizes[sizes > 0])[::-1].tolist():
        left = np.flatnonzero(sizes == size)
        _settled(left, inner[order[bounds[left][:, None] + np.arange(size)]], taken, pilots)
    # keys on slots from n on move to the free ones below, in order
    moved = np.zeros(slots - n, np.int32)
    moved[taken[n:]] = np.flatnonzero(~taken[:n])
    return n, slots, dense, buckets, pilots, moved


def by_pilots(kmers: DataFrame, seed: int = 1, size: int = SIZE, distinct: bool = False) -> Function:
    """A function of the distinct k-mers of `kmers` (kmer) by buckets and pilots. Null k-mers don't count. With `distinct`, `kmers` is a table without repeats, and is read as it is."""
    return _built(kmers, "pilots", PILOTS, _pilots, seed, size, distinct)


def _pilot_place() -> Column:
    other = F.xxhash64("h")
    crowded = F.expr(f"pmod(shiftrightunsigned(xxhash64(h), 40), 100L) < {int(100 * DENSE)}")
    bucket = F.when(crowded, F.pmod(other, F.col("dense"))).otherwise(F.col("dense") + F.pmod(other, F.greatest(F.lit(1), F.col("buckets") - F.col("dense"))))
    pilot = F.get("pilots", bucket.cast("int")).cast("long")
    slot = F.pmod(F.xxhash64("h", pilot), F.col("slots"))
    return F.when(slot < F.col("n"), slot).otherwise(F.get("moved", (slot - F.col("n")).cast("int")).cast("long"))


# cascade


def _levels(gamma: float, levels: int):
    def make(hashes: np.ndarray) -> tuple:
        n, left, sizes, bits = len(hashes), hashes, [], []
        inner = xxhash(hashes)
        for level in range(levels):
            if not len(left):
                break
            slots = max(1, int(gamma * len(left)))
            at = _below(xxhash(np.full(len(left), level), inner), slots)
            alone = np.bincount(at, minlength=slots) == 1
            sizes.append(slots)
            bits.append(np.pad(alone, (0, -slots % 64)))  # each level begins a word
            stay = ~alone[at]
            left, inner = left[stay], inner[stay]
        starts = np.cumsum([0] + [len(b) for b in bits])[:-1]
        words = np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool), bitorder="little").view(U64)
        counts = np.bitwise_count(words).astype(np.int64)
        ranks = np.cumsum(counts) - counts
        return n, sizes, starts, words.view(np.int64), ranks, np.sort(left.view(np.int64))

    return make


def by_cascade(kmers: DataFrame, gamma: float = 1.0, levels: int = 24, seed: int = 1, size: int = SIZE, distinct: bool = False) -> Function:
    """A function of the distinct k-mers of `kmers` (kmer) by levels of collision-free slots; hashes left after `levels` are listed. `distinct` as in by_pilots()."""
    return _built(kmers, "cascade", CASCADE, _levels(gamma, levels), seed, size, distinct)


def _cascade_place() -> Column:
    """The rank of the first marked place of the levels, or the place in the list of the rest."""
    place = "(get(starts, l) + pmod(xxhash64(h, cast(l as long)), cast(get(sizes, l) as long)))"
    marked = f"(shiftrightunsigned(get(bits, cast({place} div 64 as int)), cast({place} % 64 as int)) & 1L) = 1L"
    first = f"if(size(sizes) = 0, -1L, aggregate(sequence(0, size(sizes) - 1), -1L, (s, l) -> if(s >= 0, s, if({marked}, {place}, -1L))))"
    listed = "if(array_contains(rest, h), n - size(rest) + array_position(rest, h) - 1, null)"
    rank = f"if(a < 0, {listed}, get(ranks, cast(a div 64 as int)) + bit_count(get(bits, cast(a div 64 as int)) & ~shiftleft(-1L, cast(a % 64 as int))))"
    return F.expr(f"transform(array({first}), a -> cast({rank} as long))[0]")


# lookups


def looked_up(kmers: DataFrame, function: Function) -> DataFrame:
    """`kmers` with hval, the function's code of each; of k-mers outside its set any code or null. Null k-mers have a null code."""
    place = _pilot_place() if function.kind == "pilots" else _cascade_place()
    h = _hash("kmer", function.seed)
    # joined by an expression of the k-mer and hashed again, so that nothing else moves with it
    found = kmers.join(function.table, _shard(function.parts, h) == F.col("shard"), "left").withColumn("h", h)
    return found.select(*kmers.columns, F.when(F.col("kmer").isNotNull(), F.col("base") + place).alias("hval"))


def space(function: Function) -> DataFrame:
    """(n_keys, bits, bits_per_key) of a compact form of the tables.

    Pilots: Rice codes of the partition's best parameter, and the moved slots in full width. Cascade: bitmaps with a 32-bit count
    every eight words, and 64 bits for each hash of the rest. Either has five 32-bit numbers a partition.
    """
    if function.kind == "pilots":
        rice = [f"aggregate(pilots, 0L, (s, p) -> s + shiftright(p, {r}) + {r + 1})" for r in range(16)]
        bits = F.expr(f"least({', '.join(rice)}) + size(moved) * ceil(log2(greatest(n, 2)))")
    else:
        bits = F.expr("size(bits) * 64 + ceil(size(bits) / 8) * 32 + size(rest) * 64 + size(sizes) * 32")
    row = function.table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_keys"), F.coalesce(F.sum(bits + 160), F.lit(0)).cast("long").alias("bits"))
    return row.withColumn("bits_per_key", F.col("bits") / F.greatest(F.col("n_keys"), F.lit(1)))
