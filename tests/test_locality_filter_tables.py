"""Locality by blocks and runs, the membership filter, and the index as bucketed tables."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import packed
from kmerloom.operators import lookup, membership, sequences, statistics
from kmerloom.operators.index import Index, build
from kmerloom.plans.config import Options
from tests.test_engine import contigs, some_rows


def brute_locality(codes) -> tuple[int, int]:
    at = {(r.seq_id, r.seg_id, r.pos): r.hval for r in codes.collect()}
    after = [(h, at[s, g, p + 1]) for (s, g, p), h in at.items() if at.get((s, g, p + 1)) is not None]
    return len(after), sum(h is not None and abs(h - b) == 1 for h, b in after)


@pytest.mark.parametrize("layout,block", [("partitioned", 1), ("partitioned", 1 << 14), ("unpartitioned", 3)])
def test_locality_by_blocks_and_runs(spark, layout, block):
    long = "".join(random.Random(7).choices("ACGT", k=400))
    given = contigs(spark, some_rows(5, 30) + [(500, long)])
    index = build(given, Options(k=7, m=4, layout=layout))
    other = contigs(spark, some_rows(6, 30) + [(500, long[200:] + long[:250])])  # k-mers and minimizers outside the index too
    for rows in (given, other):
        want = brute_locality(lookup.by_super_kmer(rows, index))
        assert want[0] > 100
        assert tuple(statistics.run_locality(rows, index, tile=9, block=block).first()) == want
        assert tuple(statistics.locality(lookup.by_super_kmer(rows, index), block).first()) == want


def test_locality_of_nothing(spark):
    none = contigs(spark, [(1, None), (2, ""), (3, "ACG")])
    index = build(none, Options(k=7, m=3))
    assert tuple(statistics.run_locality(none, index).first()) == (0, 0)
    assert tuple(statistics.locality(lookup.by_super_kmer(none, index)).first()) == (0, 0)


def test_no_window_over_a_segment(spark):
    """One long sequence: places are dealt by blocks, so no task has more than its share."""
    rng = random.Random(4)
    one = contigs(spark, [(1, "".join(rng.choices("ACGT", k=60_000)))])
    index = build(one, Options(k=15, m=7), tile=1 << 12)
    codes = statistics._with_next(lookup.by_super_kmer(one, index, tile=1 << 12), 1 << 10)
    sizes = codes.groupBy(codes.pos.bitwiseAND(0).alias("all"), (codes.pos / 1024).cast("int").alias("block")).count().collect()
    assert len(sizes) == 59 and max(r["count"] for r in sizes) <= 1024
    assert codes.where("after is null").count() == 1


@pytest.mark.parametrize("k", [7, 31, 40])
def test_filter_loses_nothing_and_stops_most(spark, k):
    rng = random.Random(k)
    text = lambda n: ["".join(rng.choices("ACGT", k=k)) for _ in range(n)]
    mine, alien = (text(3000), text(3000)) if k > 7 else ([t for t in text(3000) if t < "G"], [t for t in text(3000) if t >= "G"])
    table = lambda rows: spark.createDataFrame([(t,) for t in rows] + [(None,)], "t string").select(packed.from_text(F.col("t"), k).alias("kmer"))
    n = len(set(mine))
    bloom = membership.built(table(mine), "kmer", n)
    assert bloom.count() <= membership.blocks(n) and membership.size(n) == 4096 * membership.blocks(n)
    assert membership.judged(table(mine), "kmer", bloom, n, "maybe").where("maybe").count() == len(mine)
    assert membership.judged(table(alien), "kmer", bloom, n, "maybe").where("maybe").count() <= 0.03 * len(alien)
    assert membership.judged(table([]), "kmer", bloom, n, "maybe").where("maybe").count() == 0  # a null key


@pytest.mark.parametrize("k,m", [(9, 4), (35, 7)])
def test_strict_with_and_without_filter(spark, k, m):
    given, other = contigs(spark, some_rows(11, 60)), contigs(spark, some_rows(12, 60) + [(900, "ACGTTGCA" * 30)])
    index = build(given, Options(k=k, m=m))
    keys = sequences.packed_kmers(given, k)
    plain, filtered = (sorted(map(tuple, lookup.strict(other, index, keys, filter_bytes=b).collect()), key=repr) for b in (0, membership.MOST_BYTES))
    assert plain == filtered
    known = {r.kmer for r in sequences.kmers(given, k).collect()}
    want = {(r.seq_id, r.seg_id, r.pos) for r in sequences.kmers(other, k).collect() if r.kmer in known}
    assert {r[:3] for r in filtered if r[3] is not None} == want


def test_filter_of_no_keys(spark):
    none = contigs(spark, [(1, "")])
    index = build(none, Options(k=9, m=4))
    got = lookup.strict(contigs(spark, [(1, "ACGTACGTTG")]), index, sequences.packed_kmers(none, 9)).collect()
    assert [r.hval for r in got] == [None, None]


@pytest.mark.parametrize("k,m", [(9, 4), (35, 7)])
def test_bucketed_tables(spark, k, m):
    given = contigs(spark, some_rows(13, 60))
    index = build(given, Options(k=k, m=m, layout="unpartitioned"))
    index.save_tables(f"held_{k}", 4)
    again = Index.load_tables(spark, f"held_{k}")
    assert again.options == index.options and (again.n_main, again.n_kmers) == (index.n_main, index.n_kmers)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        stored, fresh = lookup.by_super_kmer(given, again), lookup.by_super_kmer(given, index)
        exchanges = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (stored, fresh)]
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, fresh.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert exchanges[0] <= exchanges[1] - 2  # neither the minimizers nor the fallback move
