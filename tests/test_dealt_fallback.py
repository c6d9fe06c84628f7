"""Lookups probe the k-mers of colliding minimizers where their runs are."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import lookup
from kmerloom.operators.index import Index, build
from kmerloom.operators.sequences import packed_kmers, packed_super_kmers
from kmerloom.plans.config import Options

SHAPES = [Options(k=11, m=4), Options(k=31, m=6), Options(k=33, m=5), Options(k=63, m=7), Options(k=40, m=31), Options(k=21, m=5, canonical=True), Options(k=50, m=6, canonical=True, hasher="lexicographic")]


def contigs(spark, seed, n=60):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, "".join(rng.choices("ACGTN", [9, 9, 9, 9, 0.1], k=rng.randint(60, 260)))) for i in range(n)], "seq_id long, seq string")


@pytest.mark.parametrize("o", SHAPES, ids=lambda o: f"{o.k}-{o.m}-{o.canonical}")
def test_owners_are_the_minimizers(spark, o):
    """The fallback tells each k-mer's minimizer, ranks ascend with the k-mers, and lookups by either way give one code a k-mer."""
    given = contigs(spark, 3).unionByName(spark.createDataFrame([(100, "ACGTTGCA" * 30), (101, "A" * 300)], "seq_id long, seq string"))
    index = build(given, o)
    owned = {str(r.kmer): (r.minimizer, r.fb_rank) for r in index.owned_fallback().collect()}
    runs = packed_super_kmers(given, o).alias("r").join(index.minimizers.where("n > 1").select("minimizer"), "minimizer")
    from kmerloom.operators.minimizers import kmers_of

    assert {str(r.kmer): r.minimizer for r in kmers_of(runs, o.k, "minimizer").collect()} == {k: m for k, (m, _) in owned.items()}
    assert sorted(rank for _, rank in owned.values()) == list(range(len(owned)))
    found = lookup.by_super_kmer(given, index, keep_kmer=True).collect()
    codes = {str(r.kmer): r.hval for r in found}
    assert len(found) == packed_kmers(given, o.k).count() and sorted(codes.values()) == list(range(index.n_kmers))
    bare = Index(o, index.minimizers, index.fallback.select("kmer", "fb_rank"), index.n_main)
    assert {str(r.kmer): r.hval for r in lookup.by_super_kmer(given, bare, keep_kmer=True).collect()} == codes


def test_no_kmer_of_the_sequences_moves(spark):
    """Of all exchanges none is by k-mer: runs, minimizers and the fallback are dealt by minimizer."""
    given = contigs(spark, 5, 200)
    index = build(given, Options(k=11, m=4))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup.by_super_kmer(given, index)
        found.collect()
        final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    dealt = [line for line in final.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "probe" in line or "hashpartitioning(kmer" in line]
    assert found.where(F.col("hval").isNull()).count() == 0
