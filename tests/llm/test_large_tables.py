"""What larger tables than the test tables bring out in the corpus operators."""

import random

from kmerloom.llm import topk_search


def test_queries_are_not_broadcast(spark):
    """Each query goes to every block; together they grow with the square of the table, so no driver may hold them."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    made = topk_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)
    assert made.count() == 15 * 3
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
