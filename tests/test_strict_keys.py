"""A strict lookup of few k-mers moves few of the keys."""

import random

from kmerloom.operators import lookup, sequences
from kmerloom.operators.index import build
from kmerloom.plans.config import Options


def test_few_kmers_move_few_keys(spark):
    rng = random.Random(8)
    text = "".join(rng.choices("ACGT", k=30_000))
    given = spark.createDataFrame([(1, text)], "seq_id long, seq string")
    asked = spark.createDataFrame([(2, text[500:560] + "".join(rng.choices("ACGT", k=60)))], "seq_id long, seq string")
    index = build(given, Options(k=21, m=9))
    keys = sequences.packed_kmers(given, 21).select("kmer").distinct().checkpoint()
    index.n_kmers  # makes the fallback
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    known = {r.kmer for r in keys.collect()}
    before = written()
    got = {r.pos: r.hval for r in lookup.strict(asked, index, keys).collect()}
    # the rows of its minimizers and of its fallback move, keys don't
    assert sum(n for s, n in written().items() if s not in before) < index.minimizers.count() + index.fallback.count() + len(known) // 2
    want = {r.pos: r.kmer in known for r in sequences.packed_kmers(asked, 21).collect()}
    assert sum(want.values()) == 40 and {p: h is not None for p, h in got.items()} == want
    assert {r.pos: r.hval for r in lookup.strict(asked, index, keys, filter_bytes=0).collect()} == got
