"""Levels of collision-free slots: k-mers alone in their slot are found and ranked in one pass over sorted rows."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import packed
from kmerloom.operators import baselines


@pytest.mark.parametrize("rows_a_batch", [1, 7, 10_000])
def test_alone_across_batches_and_parts(spark, rows_a_batch):
    rng = random.Random(rows_a_batch)
    slots, parts = 400, 13
    rows = [(i, rng.choice([rng.randrange(slots), rng.randrange(5), slots - 1])) for i in range(600)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        dealt = spark.createDataFrame(rows, "kmer long, slot long").repartition(5, F.expr(f"slot * {parts} div {slots}")).sortWithinPartitions("slot")
        got = baselines._alone(dealt, parts, slots).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    slot, times = dict(rows), collections.Counter(s for _, s in rows)
    assert sorted(r.kmer for r in got) == sorted(slot) and all(r.alone == (times[slot[r.kmer]] == 1) and r.part == slot[r.kmer] * parts // slots for r in got)
    for r in got:
        if r.alone:
            assert r.inside == sum(times[s] == 1 for s in range(slot[r.kmer]) if s * parts // slots == r.part)


def test_text_without_conv(spark):
    """Digits by conv() and letters by translate() were most of the time that a k-mer's slot took."""
    kmers = spark.range(3000).select(F.xxhash64("id").bitwiseAND((1 << 62) - 1).alias("kmer"))
    plan = kmers.select(packed.to_text(F.col("kmer"), 31).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and "translate(" not in plan
    assert sorted(r.hval for r in baselines.by_levels(kmers, 2.0, 4, 31).collect()) == list(range(3000))


@pytest.mark.parametrize("k", [1, 7, 8, 9, 16, 31, 32, 47, 48, 63])
def test_text_of_words(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGT", k=k)) for _ in range(50)] + [x * k for x in "ACGT"] + [None]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed.from_text(F.col("t"), k).alias("kmer"))
    assert all(r.t == r.u for r in made.select("t", packed.to_text(F.col("kmer"), k).alias("u")).collect())
