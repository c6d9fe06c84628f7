"""What the Jaccard join moves: rows of signatures follow tasks and shuffle partitions, and texts and signatures that no join asks for stay where they are."""

import random

import numpy as np
from pyspark.sql import functions as F

from kmerloom.llm import jaccard_join


def written(spark) -> dict[int, int]:
    """The rows that each stage so far has written to its shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_rows_of_signatures_follow_tasks_and_shuffle_partitions(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    rows = [(i, " ".join(word() for _ in range(400))) for i in range(320)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(8)]
    before, parts = set(written(spark)), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        given = spark.createDataFrame(rows, "doc_id long, text string").repartition(16).checkpoint()
        got = {r.doc_id: r.component_id for r in jaccard_join.linked(given).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == {d: d - 1000 if d >= 1000 else d for d, _ in rows}
    assert max(n for stage, n in written(spark).items() if stage not in before) <= 16 * 16 + len(rows)


def test_pieces_of_a_bucket_are_whole_and_keep_equal_keys_together():
    rng = np.random.default_rng(1)
    keys = jaccard_join.widened(jaccard_join.narrow(rng.integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64)[rng.integers(0, 500, 5000)]).tobytes())
    ids = np.arange(5000)
    got = list(jaccard_join.pieces((keys, ids), keys))
    assert len(got) > 1 and sorted(np.concatenate([i for _, i in got]).tolist()) == ids.tolist()
    assert sum(len(np.unique(k)) for k, _ in got) == len(np.unique(keys)) and all((keys[i] == k).all() for k, i in got)


def test_rows_of_given_ids_leave_and_others_stay(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, f"t{i}", i) for i in range(200)], "doc_id long, words string, block_ int")
    ids = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "id long").checkpoint()
    want = sorted(map(str, docs.where("doc_id is null or doc_id % 3 <> 0").collect()))
    for most in (64 << 20, 0):
        monkeypatch.setattr(jaccard_join.membership, "MOST_BYTES", most)
        assert sorted(map(str, jaccard_join.without(docs, "doc_id", ids).collect())) == want
        kept = jaccard_join.narrowed(docs, "doc_id", ids)
        assert kept.columns == docs.columns and kept.join(ids, F.col("doc_id") == F.col("id")).count() == docs.where("doc_id % 3 = 0").count()
