"""Which rows may have a key of a large set: a Bloom filter as a table of bitmaps, made by one aggregation and small enough to be broadcast.

A key's hash names one block of 32,768 bits and three bits in it. Blocks are made by Spark's bitmap aggregate
and kept as 512 longs, which a probe reads in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.storage import staged

#: Bits a key; with three of them set, about one foreign key in 200 passes.
BITS, SET = 16, 3
BLOCK_BITS, WORD_BITS = 1 << 15, 64
#: The most that is broadcast, whatever the cluster: a filter of 33 million keys.
MOST_BYTES = 64 << 20


def blocks(n_keys: int) -> int:
    return max(1, -(-BITS * n_keys // BLOCK_BITS))


def size(n_keys: int) -> int:
    """Bytes of the filter of so many keys."""
    return blocks(n_keys) * BLOCK_BITS // 8


def _block(key: Column, n_keys: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks(n_keys)))


def _bit(key: Column, i: int) -> Column:
    return F.shiftright(F.xxhash64(key, F.lit(1)), 15 * i).bitwiseAND(BLOCK_BITS - 1)


def built(keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """(block, words): the filter of the values of `key`, of which there are `n_keys`; more only make it less selective. Nulls have no part."""
    # the three bits of a key travel as one number, to where its block is put together: half-filled blocks of every task would be larger
    hashed = keys.where(F.col(key).isNotNull()).select(_block(F.col(key), n_keys).alias("block"), F.xxhash64(F.col(key), F.lit(1)).bitwiseAND((1 << 15 * SET) - 1).alias("h")).repartition("block")
    bits = hashed.select("block", F.explode(F.array(*(F.shiftright("h", 15 * i).bitwiseAND(BLOCK_BITS - 1) for i in range(SET)))).alias("bit"))
    maps = bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    word = "cast(conv(hex(substring(bits, 8 * i + 1, 8)), 16, -10) as long)"
    return staged(maps.select("block", F.expr(f"transform(sequence(0, {BLOCK_BITS // WORD_BITS - 1}), i -> {word})").alias("words")), "filter", "zstd")


def judged(df: DataFrame, key: str, bloom: DataFrame, n_keys: int, into: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`df` with a boolean column: false if `key` is surely not among the filter's keys, or null. Filters of more than `most_bytes` aren't broadcast."""
    # bytes of a word stand highest first, bits of a byte lowest first
    held = F.lit(True)
    for i in range(SET):
        bit = _bit(F.col(key), i)
        shift = (F.lit(56) - F.shiftleft(F.shiftright(bit, 3).bitwiseAND(7), 3) + bit.bitwiseAND(7)).cast("int")
        word = F.get("words", F.shiftright(bit, 6).cast("int"))
        held = held & (F.call_function("shiftrightunsigned", word, shift).bitwiseAND(1) == 1)
    block = F.when(F.col(key).isNotNull(), _block(F.col(key), n_keys))
    renamed = bloom.withColumnRenamed("block", "block_")
    small = size(n_keys) <= most_bytes
    # a larger filter meets the rows by a shuffle of both: it never goes through the driver whole
    met = df.withColumn("block_", block).join(F.broadcast(renamed) if small else renamed.hint("merge"), "block_", "left")
    return met.withColumn(into, F.coalesce(held & F.col("block_").isNotNull(), F.lit(False))).drop("block_", "words")
