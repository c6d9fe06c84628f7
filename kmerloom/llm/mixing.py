"""Mixing sources to target weights: hierarchical budgeting over a tree of columns, by DataFrame functions only.

A token budget goes down the tree. At each node it is dealt to the children by weight; what a child can't supply goes
to its siblings by weight, and only what no sibling can supply is left to the siblings of its ancestors, since a node's
capacity is all that its leaves can give. A leaf supplies whole seeded epochs of its documents, then the longest
token-prefix of one more epoch's order that fits.

Leaves may hold a third of all rows: the order of an epoch is a hash seeded by its number, cut into ranges of about
`block_docs` documents, and only range sums are cumulated in a leaf; the one range that the prefix ends in is cumulated by
document, and no other row moves.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.llm.common import WORD, checkpointed

#: Trees of more leaves are joined by a shuffle.
MOST_BROADCAST = 2000


def budgeted(leaves: DataFrame, levels: list[str], budget: float, max_epochs: int, weight: Column | None = None) -> DataFrame:
    """`leaves` (levels..., leaf_tokens) with leaf_budget in tokens: the root's `budget`, which it can supply, dealt down the tree.

    `weight` is an expression over level columns, evaluated on each node with the deeper levels null; 1 by default.
    A node's budget never exceeds max_epochs times its tokens. Budgets are whole tokens and sum to the node's.
    """
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    for depth in range(1, len(levels) + 1):
        names, parent = levels[:depth], levels[: depth - 1]
        nodes = leaves.groupBy(*names).agg((F.sum("leaf_tokens").cast("double") * max_epochs).alias("cap"))
        full = reduce(lambda d, c: d.withColumn(c, F.lit(None).cast("string")), levels[depth:], nodes).withColumn("weight", weight).drop(*levels[depth:])
        nodes = full.join(above, parent) if parent else full.withColumn("node_budget", F.lit(float(budget)))
        siblings = W.partitionBy(*(parent or [F.lit(0)]))
        by_need = siblings.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(names[-1]).asc())
        before = by_need.rowsBetween(W.unboundedPreceding, -1)
        nodes = (
            nodes.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "weight_all": F.sum("weight").over(siblings)})
            .withColumn("short", F.col("cap") * (F.col("weight_all") - F.col("weight_before")) <= (F.col("node_budget") - F.col("cap_before")) * F.col("weight"))
            .withColumns({"cap_short": F.coalesce(F.sum(F.when(F.col("short"), F.col("cap"))).over(siblings), F.lit(0.0)), "weight_short": F.coalesce(F.sum(F.when(F.col("short"), F.col("weight"))).over(siblings), F.lit(0.0))})
        )
        # whole tokens: differences of floors of running shares, so that they sum to the budget
        left, share = F.col("node_budget") - F.col("cap_short"), lambda w: w - F.col("weight_short")
        upto = lambda w: F.floor(left * share(w) / (F.col("weight_all") - F.col("weight_short"))).cast("double")
        dealt = F.when(F.col("short"), F.col("cap")).otherwise(upto(F.col("weight_before") + F.col("weight")) - upto(F.col("weight_before")))
        above = nodes.select(*names, dealt.alias("node_budget"))
    return leaves.join(above, levels).withColumn("leaf_budget", F.col("node_budget").cast("long")).drop("node_budget")


def mixed(
    docs: DataFrame,
    levels: dict[str, Column],
    share: float,
    weight: Column | None = None,
    max_epochs: int = 4,
    seed: int = 11,
    block_docs: int = 4096,
    keep: list[str] | None = None,
) -> DataFrame:
    """Select documents to `share` of all tokens, dealt over the tree of `levels` (name -> expression over docs).

    Returned for every document selected: doc_id, the level columns, n_tokens (words), copies (epochs it is in), and the
    columns of `keep` in a struct `kept`. A null level value is the value ''. Null and empty texts have no tokens and
    come with their leaf's whole epochs only. Documents with equal order keys are ordered by doc_id and n_tokens.
    An empty table selects nothing.
    """
    names = list(levels)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.coalesce(v.cast("string"), F.lit("")).alias(k) for k, v in levels.items()),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
        *([F.struct(*(F.col(c) for c in keep)).alias("kept")] if keep else []),
    )
    leaves = checkpointed(rows.groupBy(*names).agg(F.sum("n_tokens").alias("leaf_tokens"), F.count("*").alias("leaf_docs")))
    total = leaves.agg(F.coalesce(F.sum("leaf_tokens"), F.lit(0))).first()[0]  # one number
    plan = budgeted(leaves, names, min(math.floor(share * total), total * max_epochs), max_epochs, weight)
    whole = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("leaf_budget") / F.col("leaf_tokens"))).otherwise(F.lit(0)).cast("long")
    plan = checkpointed(plan.withColumn("whole", whole).select(
        *names, "whole", (F.col("leaf_budget") - F.col("whole") * F.col("leaf_tokens")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("leaf_docs") / block_docs)).alias("blocks")
    ))
    few = leaves.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    small = F.broadcast if few else lambda df: df
    # the place in the epoch that the leaf ends in, which has an order of its own as every epoch has
    key = F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = rows.join(small(plan), names).withColumn("place", F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"))
    placed = placed.withColumn("block", F.floor(F.col("place") * F.col("blocks") / F.lit(float(1 << 32))).cast("long"))
    upto = F.sum("block_tokens").over(W.partitionBy(*names).orderBy("block"))
    sums = placed.groupBy(*names, "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("rest").alias("rest")).withColumn("upto", upto)
    # the first block that doesn't fit whole, and the tokens before it
    ends = sums.where("upto > rest").groupBy(*names).agg(F.min(F.struct("block", (F.col("upto") - F.col("block_tokens")).alias("before"))).alias("end"))
    placed = placed.join(small(ends), names, "left").withColumns({"end_block": F.coalesce("end.block", "blocks"), "before": F.coalesce("end.before", F.lit(0))})
    columns = ["doc_id", *names, "n_tokens", "copies", *(["kept"] if keep else [])]
    apart = placed.where("block <> end_block").withColumn("copies", F.col("whole") + F.when((F.col("block") < F.col("end_block")) & (F.col("rest") > 0), 1).otherwise(0))
    cumulated = F.col("before") + F.sum("n_tokens").over(W.partitionBy(*names).orderBy("place", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0))
    at_end = placed.where("block = end_block").withColumn("copies", F.col("whole") + F.when((F.col("rest") > 0) & (cumulated <= F.col("rest")), 1).otherwise(0))
    return apart.select(*columns).unionByName(at_end.select(*columns)).where("copies > 0").withColumn("copies", F.col("copies").cast("long"))


def sql(levels: dict[str, str], weights: list[str], share: float, max_epochs: int = 4, seed: int = 11) -> str:
    """The same selection in SQL; weights has an expression for each level over the columns of its nodes."""
    names = list(levels)
    every = ", ".join(names)
    parts = [
        f"""rows_ AS (SELECT doc_id, {", ".join(f"coalesce({v}, '') AS {k}" for k, v in levels.items())},
  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents)""",
        f"leaves AS (SELECT {every}, sum(n_tokens)::BIGINT AS leaf_tokens FROM rows_ GROUP BY {every})",
        f"n0 AS (SELECT least(floor({share} * sum(leaf_tokens)::DOUBLE), sum(leaf_tokens)::DOUBLE * {max_epochs}) AS node_budget FROM leaves)",
    ]
    for depth in range(1, len(names) + 1):
        own, parent = ", ".join(names[:depth]), names[: depth - 1]
        above = f"JOIN n{depth - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN n0"
        over = f"PARTITION BY {', '.join(parent)}" if parent else ""
        before = f"({over} ORDER BY cap / weight, {names[depth - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        parts += [
            f"c{depth} AS (SELECT {own}, sum(leaf_tokens)::DOUBLE * {max_epochs} AS cap, ({weights[depth - 1]})::DOUBLE AS weight FROM leaves GROUP BY {own})",
            f"""w{depth} AS (SELECT *, coalesce(sum(cap) OVER {before}, 0) AS cap_before, coalesce(sum(weight) OVER {before}, 0) AS weight_before,
  sum(weight) OVER ({over}) AS weight_all FROM c{depth} {above})""",
            f"s{depth} AS (SELECT *, cap * (weight_all - weight_before) <= (node_budget - cap_before) * weight AS short FROM w{depth})",
            f"""r{depth} AS (SELECT *, coalesce(sum(CASE WHEN short THEN cap END) OVER ({over}), 0) AS cap_short,
  coalesce(sum(CASE WHEN short THEN weight END) OVER ({over}), 0) AS weight_short FROM s{depth})""",
            f"""n{depth} AS (SELECT {own}, CASE WHEN short THEN cap ELSE
  floor((node_budget - cap_short) * (weight_before + weight - weight_short) / (weight_all - weight_short))
  - floor((node_budget - cap_short) * (weight_before - weight_short) / (weight_all - weight_short)) END AS node_budget FROM r{depth})""",
        ]
    parts += [
        f"""p AS (SELECT *, node_budget::BIGINT - whole * leaf_tokens AS rest FROM (SELECT *, CASE WHEN leaf_tokens > 0
  THEN node_budget::BIGINT // leaf_tokens ELSE 0 END AS whole FROM leaves JOIN n{len(names)} USING ({every})))""",
        f"d AS (SELECT *, ('0x' || substr(md5('{seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place FROM rows_ JOIN p USING ({every}))",
        f"e AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {every} ORDER BY place, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM d)",
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {every}, n_tokens, copies FROM (SELECT *, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM e) WHERE copies > 0"
