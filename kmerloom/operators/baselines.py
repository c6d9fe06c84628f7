"""Minimal perfect hash functions over whole k-mer sets, for comparison: a global rank, and cascading collision-free slots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from kmerloom.functions import packed
from kmerloom.operators.ranking import parts_of, ranked, sums_before
from kmerloom.storage import discarded, staged


def by_rank(kmers: DataFrame, distinct: bool = False) -> DataFrame:
    """(kmer, hval): the distinct k-mers by their order as text. With `distinct`, `kmers` is a table without repeats, and is read as it is."""
    return ranked(kmers.select("kmer"), ["kmer"], "hval", distinct=not distinct)


def looked_up(kmers: DataFrame, table: DataFrame) -> DataFrame:
    """`kmers` with the hval that a baseline's `table` (kmer, hval) gives each, null for k-mers outside it."""
    return kmers.join(table.select("kmer", "hval"), "kmer", "left")


#: Ranges of slots for each shuffle partition, so that hashing deals them evenly.
RANGES = 16


def slot_of(level: int, slots: int, text: Column):
    """The slot of a k-mer on a level, of `slots`: 60 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{level}:"), text).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def _alone(dealt: DataFrame, parts: int, slots: int) -> DataFrame:
    """(kmer, part, alone, inside) of `dealt` (kmer, slot), whose partitions have whole parts and are sorted by slot: whether a k-mer is alone in its slot, and of its part how many of those alone stand before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kmers, at, before, part, done = None, np.zeros(0, np.int64), -1, -1, 0
        for batch in chain(batches, [None]):
            # the last row waits for the slot after it
            if batch is not None:
                kmers = batch.column(0) if kmers is None else pa.concat_arrays([kmers, batch.column(0)])
                at = np.concatenate([at, batch.column(1).to_numpy()])
            n = len(at) - (batch is not None)
            if n < 1:
                continue
            own, after = at[:n], np.append(at[1:], -1)[:n]
            alone = (own != np.append(before, own[:-1])) & (own != after)
            parts_of_rows = own * parts // slots
            opens = np.flatnonzero(np.append(True, parts_of_rows[1:] != parts_of_rows[:-1]))
            sums = np.cumsum(alone) - alone
            start = sums[opens] - np.append(done if parts_of_rows[0] == part else 0, np.zeros(len(opens) - 1, np.int64))
            inside = sums - np.repeat(start, np.diff(np.append(opens, n)))
            before, part, done = int(own[-1]), int(parts_of_rows[-1]), int(inside[-1] + alone[-1])
            yield pa.RecordBatch.from_arrays([kmers.slice(0, n), pa.array(parts_of_rows), pa.array(alone), pa.array(inside)], names=["kmer", "part", "alone", "inside"])
            kmers, at = kmers.slice(n), at[n:]

    return dealt.mapInArrow(run, StructType([dealt.schema["kmer"], *(StructField(c, t) for c, t in (("part", LongType()), ("alone", BooleanType()), ("inside", LongType())))]))


def by_levels(kmers: DataFrame, gamma: float = 1.0, levels: int = 24, k: int | None = None, distinct: bool = False) -> DataFrame:
    """(kmer, level, hval): on each level the k-mers left are thrown into gamma slots a k-mer; those alone in a slot stay
    there, the others go on. hval is the rank by (level, slot). What is left after `levels` is ranked as text behind.

    With `k`, k-mers come and go as numbers of so many bases; `distinct` as in by_rank(). A level is one shuffle by ranges of slots, in which k-mers are
    sorted by slot, and those alone in one are marked and ranked; the next level reads the others from the same table.
    """
    text = packed.to_text(F.col("kmer"), k) if k else F.col("kmer")
    left = kmers.select("kmer") if distinct else staged(kmers.select("kmer").distinct(), "left", "zstd")
    done, before, n, parts = [], 0, left.count(), RANGES * parts_of(left)
    for level in range(levels):
        if not n:
            break
        slots = max(1, int(gamma * n))
        # digests are spread evenly, so ranges of slots need no sample
        dealt = left.select("kmer", slot_of(level, slots, text).alias("slot")).repartition(F.expr(f"slot * {parts} div {slots}")).sortWithinPartitions("slot")
        placed = staged(_alone(dealt, parts, slots), "level", "zstd")
        if not level and not distinct:
            discarded(left)
        stay, left = placed.where("alone"), placed.where("not alone").select("kmer")
        offsets = sums_before(stay.groupBy("part").agg(F.count("*").alias("n")))
        done.append(stay.join(F.broadcast(offsets), "part").select("kmer", F.lit(level).alias("level"), (F.lit(before) + F.col("offset") + F.col("inside")).alias("hval")))
        gone, n = n, left.count()
        before += gone - n
    done.append(ranked(left, ["kmer"], "at").select("kmer", F.lit(levels).alias("level"), (F.lit(before) + F.col("at")).alias("hval")))
    return reduce(DataFrame.unionByName, done)
