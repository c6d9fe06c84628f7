"""Connected components of links between ids, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import discarded, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in `links` (two long columns): the least id that it reaches.

    Each round, every node takes its least neighbour as its parent, if that is less than itself, and its parent's parent as
    its label; then the links are drawn between labels, and those within one go. Stars end after a round, and every round
    leaves half of the linked nodes at most. Labels of a round are written to the shared folder. Links with a null end,
    or of an id with itself, are ignored.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges, rounds = staged(pairs.distinct(), "links"), []
    while not rounds or not edges.isEmpty():
        parents = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("parent"))
        above = parents.select(F.col("id").alias("at"), F.col("parent").alias("upper"))
        labels = staged(parents.join(above, F.col("parent") == F.col("at")).select("id", F.col("upper").alias("label")), "labels")
        ends = edges.join(labels.toDF("u", "a"), "u").join(labels.toDF("v", "b"), "v").where("a <> b")
        left = staged(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        discarded(edges)
        edges = left
        rounds.append(labels)
    reached = rounds[0].select("id", F.col("label").alias("component"))
    for labels in rounds[1:]:
        onward = labels.select(F.col("id").alias("component"), "label")
        reached = reached.join(onward, "component", "left").select("id", F.coalesce("label", "component").alias("component"))
    return reached
