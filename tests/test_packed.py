"""k-mers as numbers, perfect hash functions without keys, and checks by order and population."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import packed
from kmerloom.operators import lookup, perfect_hash, sequences, skew, validation
from kmerloom.operators.index import Index, build
from kmerloom.operators.ranking import order_violations
from kmerloom.plans.config import Options
from tests.test_engine import brute_runs, contigs, some_rows, split

TURN = str.maketrans("ACGT", "TGCA")


@pytest.mark.parametrize("k", [1, 2, 16, 31, 32, 33, 47, 62, 63])
def test_packed_kmers_are_the_text(spark, k):
    rng = random.Random(k)
    rows = [(i, "".join(rng.choices("ACGTN", [9] * 4 + [1], k=rng.randint(0, 4 * k)))) for i in range(30)] + [(99, "A" * 70), (98, "T" * 70), (97, None), (96, "")]
    want = sorted((i, g, p, s[p : p + k]) for i, seq in rows for g, s in split(seq or "") for p in range(len(s) - k + 1))
    given = contigs(spark, rows)
    for tile in (None, 7):
        made = sequences.packed_kmers(given, k, tile)
        text = packed.to_text(F.col("kmer"), k)
        got = made.select("seq_id", "seg_id", "pos", text.alias("kmer"), packed.to_text(packed.reverse_complement("kmer", k), k).alias("back"), packed.from_text(text, k).eqNullSafe(F.col("kmer")).alias("same"))
        got = got.collect()
        assert sorted(tuple(r)[:4] for r in got) == want and all(r.same and r.back == r.kmer[::-1].translate(TURN) for r in got)
        assert [r[0] for r in made.orderBy("kmer").select(text).collect()] == sorted(w[3] for w in want)
        assert sorted(map(tuple, sequences.kmers(given, k, tile).collect())) == want


@pytest.mark.parametrize("k,m", [(5, 3), (31, 15), (63, 17), (63, 1), (40, 31)])
@pytest.mark.parametrize("tile", [None, 1, 9])
def test_packed_super_kmers(spark, k, m, tile):
    rng = random.Random(3)
    rows = some_rows(11, 15) + [(200 + i, "".join(rng.choices("ACGT", k=rng.randint(60, 300)))) for i in range(8)]
    made = sequences.packed_super_kmers(contigs(spark, rows), Options(k=k, m=m), tile)
    kmers = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda j: j)
    got = made.withColumn("minimizer", packed.to_text(F.col("minimizer"), m)).collect()
    assert sorted(tuple(r)[:7] for r in got) == brute_runs(rows, k, m)
    segs = {(i, g): s for i, seq in rows for g, s in split(seq or "")}
    each = made.select("seq_id", "seg_id", "start", F.explode(kmers).alias("j"), "words").select("seq_id", "seg_id", (F.col("start") + F.col("j")).alias("pos"), packed.to_text(packed.kmer_of("words", "j", k), k).alias("kmer"))
    assert all(r.kmer == segs[r.seq_id, r.seg_id][r.pos : r.pos + k] for r in each.collect())


def test_one_long_sequence_in_tiles(spark):
    """A sequence of 20 million bases in tiles: counted whole, looked up whole, in many tasks."""
    given = spark.range(1).select(F.col("id").alias("seq_id"), F.expr("repeat('ACGGTCATTGCAGT', 1428571)").alias("seq"))
    n = 14 * 1428571 - 31 + 1
    made = sequences.packed_kmers(given, 31, tile=1 << 20)
    row = made.withColumn("task", F.spark_partition_id()).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_distinct("kmer").alias("d"), F.count_distinct("task").alias("tasks")).first()
    assert (row.n, row.first, row.last, row.d) == (n, 0, n - 1, 14) and row.tasks > 1
    assert sequences.packed_super_kmers(given, Options(k=31, m=15), 1 << 20).agg(F.sum("size")).first()[0] == n
    # without tiles too, in pieces of one task
    assert sequences.kmers(given, 31).agg(F.count("*"), F.max("pos")).first() == (n, n - 1)


@pytest.mark.parametrize("k", [1, 12, 31, 40, 63])
@pytest.mark.parametrize("make", [perfect_hash.by_pilots, perfect_hash.by_cascade, lambda d, **o: perfect_hash.by_cascade(d, 1.0, 2, **o), lambda d, **o: perfect_hash.by_cascade(d, 2.0, **o)])
def test_functions_are_minimal_and_perfect(spark, k, make):
    rng = random.Random(k)
    kmers = sequences.packed_kmers(contigs(spark, [(i, "".join(rng.choices("ACGT", k=400))) for i in range(5)] + [(9, "A" * 100)]), k).select("kmer")
    n = kmers.distinct().count()
    f = make(kmers, size=300)
    assert f.n_keys == n and f.table.count() == min(f.parts, n) and not set(f.table.columns) & {"kmer", "h"}
    codes = sorted(r.hval for r in perfect_hash.looked_up(kmers.distinct(), f).collect())
    assert codes == list(range(n))
    row = perfect_hash.space(f).first()
    assert row.n_keys == n and row.bits > 0
    alien = sequences.packed_kmers(contigs(spark, [(1, "GATTACA" * 30)]), k)
    got = perfect_hash.looked_up(alien, f)
    assert got.count() == alien.count() and got.where("hval < 0 or hval >= " + str(n)).count() == 0


def test_functions_of_no_keys(spark):
    none = sequences.packed_kmers(contigs(spark, [(1, "ACG")]), 5)
    for make in (perfect_hash.by_pilots, perfect_hash.by_cascade):
        f = make(none)
        assert f.n_keys == 0 and perfect_hash.space(f).first().bits == 0
        assert [r.hval for r in perfect_hash.looked_up(spark.createDataFrame([(7,), (None,)], "kmer long"), f).collect()] == [None, None]


def test_functions_take_few_bits(spark):
    kmers = spark.range(60_000).select(F.col("id").alias("kmer"))
    assert perfect_hash.space(perfect_hash.by_pilots(kmers)).first().bits_per_key < 3
    assert perfect_hash.space(perfect_hash.by_cascade(kmers)).first().bits_per_key < 3.5


def test_hash_is_sparks(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    got = [r.h for r in spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64("v").alias("h")).collect()]
    import numpy as np

    assert perfect_hash.xxhash(np.array(values, np.int64)).view(np.int64).tolist() == got


def test_order_violations(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 300):
        values = [rng.choice([None, *range(40)]) for _ in range(n)]
        given = spark.createDataFrame(list(enumerate(values)), "o long, v long").repartition(3)
        seen = [v for v in values if v is not None]
        want = (len(seen), sum(b < a for a, b in zip(seen, seen[1:])), sum(b == a for a, b in zip(seen, seen[1:])))
        assert tuple(order_violations(given, ["o"], "v").first()) == want


def test_order_sees_a_damaged_index(spark):
    index = build(contigs(spark, some_rows(4)), Options(k=7, m=4, layout="unpartitioned"))
    assert order_violations(index.minimizers, ["minimizer"], "mm_rank").first().n_descents == 0
    damaged = index.minimizers.withColumn("mm_rank", F.when(F.col("mm_rank") == 5, 2).otherwise(F.col("mm_rank")))
    assert order_violations(damaged, ["minimizer"], "mm_rank").first().n_descents == 1


def test_population(spark):
    codes = spark.createDataFrame([(x,) for x in [0, 1, 1, 40_000, 65_535, 65_536, -1, None, 99_999, 100_000]], "hval long")
    assert tuple(validation.population(codes, 100_000).first()) == (10, 3, 100_000 - 6)
    assert tuple(validation.population(codes.limit(0), 5).first()) == (0, 0, 5)


def test_lookups_shuffle_runs_once(spark):
    """Both joins of a streaming lookup read one shuffle of the runs, and no more than unique runs and colliding k-mers move."""
    given = contigs(spark, some_rows(5))
    index = build(given, Options(k=7, m=4))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup.by_super_kmer(given, index)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("MapInArrow") == 1


def test_strict_takes_text_and_numbers(spark):
    given = contigs(spark, some_rows(5))
    index = build(given, Options(k=40, m=7))
    a, b = (sorted(map(tuple, lookup.strict(given, index, keys).collect())) for keys in (sequences.kmers(given, 40), sequences.packed_kmers(given, 40)))
    assert a == b and all(r[3] is not None for r in a)
    assert isinstance(index, Index)


@pytest.mark.parametrize("k", [11, 40])
def test_hot_minimizers_are_spread(spark, k):
    """Half of all super-k-mers have one minimizer: its rows are dealt evenly, and the codes are the same."""
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("ACGT", k=200))) for i in range(60)] + [(1000 + i, "A" * 500) for i in range(20)]
    given, o = contigs(spark, rows), Options(k=k, m=7)
    index = build(given, o)
    want = sorted(map(tuple, lookup.by_super_kmer(given, index, keep_kmer=True).collect()))
    assert sorted(map(tuple, lookup.by_super_kmer(given, index, keep_kmer=True, spread=True).collect())) == want
    assert sorted(map(tuple, lookup.by_super_kmer(contigs(spark, [(1, "GATTACA" * 9 + "A" * 90)]), index, spread=True).collect())) == sorted(map(tuple, lookup.by_super_kmer(contigs(spark, [(1, "GATTACA" * 9 + "A" * 90)]), index).collect()))
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    for c, v in confs.items():
        spark.conf.set(c, v)
    try:
        runs = sequences.packed_super_kmers(given, o)
        hot = skew.heavy_keys(runs, "minimizer", 1 / 64)
        assert runs.join(hot, "minimizer", "left_semi").count() > 0.4 * runs.count() and hot.count() < 64
        even = skew.spread_join(runs, index.minimizers.select("minimizer", "cls"), "minimizer", ["seq_id", "start"])
        sizes = sorted(r.n for r in even.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n")).collect())
        assert len(sizes) == 16 and sizes[-1] < 3 * sizes[8] and sum(sizes) == runs.count()
    finally:
        for c in confs:
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
