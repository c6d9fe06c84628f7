"""A lookup of few k-mers in a large index takes few of its rows."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import lookup, sequences
from kmerloom.operators.index import Index, build
from kmerloom.plans.config import Options


@pytest.mark.parametrize("o", [Options(k=21, m=7), Options(k=40, m=6)], ids=str)
def test_few_rows_of_the_index_are_dealt(spark, o):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("ACGT", k=n))
    given = spark.createDataFrame([(i, text(4000)) for i in range(10)], "seq_id long, seq string")
    known = given.first().seq
    asked = spark.createDataFrame([(1, known[100:180] + "N" + text(70)), (2, None), (3, "ACGT")], "seq_id long, seq string")
    made = build(given, o)
    index = Index(o, made.minimizers.checkpoint(), made.fallback.checkpoint(), made.n_main, made.n_kmers)
    few = lookup.thinned(asked, index)
    n = sequences.packed_kmers(asked, o.k).count()
    assert few.n_kmers == index.n_kmers and few.minimizers.count() + few.fallback.count() < 2 * n + (index.n_kmers + index.minimizers.count()) // 50
    rows = lambda i: sorted(map(tuple, lookup.by_super_kmer(asked, i, keep_kmer=True).collect()), key=repr)
    assert rows(few) == rows(index) and len(rows(few)) == n and any(r[-1] is not None for r in rows(few))
    # many sequences, or no filter, take the index as it is; none take nothing
    assert lookup.thinned(given.unionByName(asked), index) is lookup.thinned(asked, index, filter_bytes=0) is index
    none = lookup.thinned(asked.where("seq_id = 3"), index)
    assert none.minimizers.count() == none.fallback.count() == 0
    # keys may be repeated
    keys = sequences.packed_kmers(given, o.k).select("kmer")
    strict = {r.pos: r.hval for r in lookup.strict(asked.where("seq_id = 1"), index, keys.unionByName(keys)).where("seg_id = 0").collect()}
    assert None not in strict.values() and len(strict) == 80 - o.k + 1
    assert lookup.strict(asked, index, keys).where(F.col("hval").isNotNull()).count() == len(strict)
