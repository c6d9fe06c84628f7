"""What larger tables than the test tables bring out."""

import collections
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import packed
from kmerloom.operators import baselines, membership, minimizers, sequences, skew
from kmerloom.operators.index import build, kept, relaid
from kmerloom.operators.ranking import running_sum
from kmerloom.plans.config import Options
from kmerloom.storage import shared_dir
from tests.test_engine import contigs, some_rows


@pytest.mark.parametrize("k", [32, 40, 63])
def test_text_of_every_last_word(spark, k):
    """Also of the word whose highest bit alone is set."""
    texts = ["C" * (k - 32) + x for x in ("G" + "A" * 31, "A" * 32, "T" * 32, "G" + "A" * 30 + "C", "C" + "T" * 31, "A" * 15 + "TG" + "A" * 15)]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed.from_text(F.col("t"), k).alias("kmer"))
    assert [r.u for r in made.select(packed.to_text(F.col("kmer"), k).alias("u")).collect()] == texts


def test_an_index_keeps_its_own_tables_only(spark):
    """Neither super-k-mers nor sorted tables stay on disk, and k-mers are ranked only when they are asked for."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    index = build(contigs(spark, some_rows(21, 60)), Options(k=7, m=3))
    made = relaid(index, "unpartitioned")
    made.minimizers = kept(made.minimizers, "minimizers")
    assert sorted(x.name.split("-")[0] for x in set(folder.iterdir()) - before) == ["minimizers", "minimizers", "runs"]
    assert made.fallback is index.fallback and made.n_kmers == index.n_kmers > 0
    assert sorted(x.name.split("-")[0] for x in set(folder.iterdir()) - before) == ["fallback", "minimizers", "minimizers"]


def test_sums_by_section_of_one_order(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), rng.choice([None, *range(9)])) for i in range(500)]
    rng.shuffle(rows)
    got = running_sum(spark.createDataFrame(rows, "i long, s int, v int"), ["i"], "v", "before", "s", "at").collect()
    in_order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {r[0]: sum(x[2] or 0 for x in in_order[:n]) for n, r in enumerate(in_order)}
    assert {r.i: r.before for r in got} == want and all(r.at == r.i for r in got)


def test_copies_move_once(spark):
    """A sequence that stands fifty times gives no more super-k-mers than once, and all its k-mers."""
    one = "".join(random.Random(3).choices("ACGT", k=300))
    runs = [sequences.packed_super_kmers(contigs(spark, [(i, one) for i in range(n)]), Options(k=31, m=15), 1 << 10) for n in (1, 50)]
    few, many = (minimizers.held(r).collect() for r in runs)
    assert len(few) == len(many) and {r.n for r in many} == {50 * r.n for r in few}
    assert minimizers.distinct_kmers(runs[1], 31).count() == 270


def test_levels_of_numbers_and_of_text(spark):
    given = contigs(spark, some_rows(22, 60))
    text = baselines.by_levels(sequences.kmers(given, 31), 2.0, 3).collect()
    runs = sequences.packed_super_kmers(given, Options(k=31, m=15))
    made = baselines.by_levels(minimizers.distinct_kmers(runs, 31), 2.0, 3, 31)
    packed_rows = made.select(packed.to_text(F.col("kmer"), 31).alias("kmer"), "level", "hval").collect()
    assert sorted(map(tuple, text)) == sorted(map(tuple, packed_rows)) and sorted(r.hval for r in text) == list(range(len(text)))
    # by (level, slot), which the digest gives
    n, done = len(text), 0
    for level in range(3):
        own = sorted((r.hval, int(hashlib.md5(f"{level}:{r.kmer}".encode()).hexdigest()[:15], 16) % max(1, int(2.0 * (n - done)))) for r in text if r.level == level)
        assert [s for _, s in own] == sorted({s for _, s in own})
        done += len(own)


def test_canonical_counts_by_super_kmers(spark):
    o, rows = Options(k=9, m=4, canonical=True), some_rows(23, 60)
    given = contigs(spark, rows + [(1000 + i, s) for i, s in rows])
    got = {r.t: r.n for r in minimizers.canonical_counts(sequences.packed_super_kmers(given, o, 8), 9).select(packed.to_text(F.col("kmer"), 9).alias("t"), "n").collect()}
    turned = str.maketrans("ACGT", "TGCA")
    assert got == collections.Counter(min(r.kmer, r.kmer.translate(turned)[::-1]) for r in sequences.kmers(given, 9).collect())
    assert minimizers.canonical_counts(sequences.packed_super_kmers(given, o, 8), 9).count() == len(got)


def test_large_filter_is_not_broadcast(spark):
    given = contigs(spark, some_rows(24, 60))
    keys = sequences.packed_kmers(given, 9)
    n = keys.distinct().count()
    bloom = membership.built(keys, "kmer", n)
    asked = keys.union(sequences.packed_kmers(contigs(spark, some_rows(25, 60)), 9))
    small, large = (membership.judged(asked, "kmer", bloom, n, "maybe", b) for b in (membership.MOST_BYTES, 0))
    assert "Broadcast" in small._jdf.queryExecution().executedPlan().toString() and "Broadcast" not in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert large.where("not maybe").join(keys, "kmer", "left_semi").count() == 0


def test_counts_of_keys_do_not_stay(spark):
    """Of the rows of all keys that heavy_keys() counts, only the heavy ones are left on disk."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    heavy = skew.heavy_keys(spark.createDataFrame([(i % 50 if i < 100 else 7,) for i in range(200)], "key long"), "key", 0.25)
    assert [r.key for r in heavy.collect()] == [7]
    assert [x.name.split("-")[0] for x in set(folder.iterdir()) - before] == ["heavy"]
