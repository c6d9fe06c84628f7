"""A training-data pipeline of five corpus operators: from `documents` to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
they are. Null texts count as empty, repeated rows as rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import jaccard_join, langid, line_dedup, mixing, packing
from kmerloom.llm.common import documents, staged
from kmerloom.llm.queries import MIX_LEVELS, mix_weight, vocabulary

#: A document stays if its language has at least this share of its n-grams.
LEAST_SHARE = 0.4
#: The share of all tokens that the mixture takes; no document is taken twice.
TOKEN_SHARE = 0.8


def replaced(rows: DataFrame, docs: DataFrame, **columns: Column) -> DataFrame:
    """The columns of `docs` from the struct `row`, some of them replaced where `docs` has them; other columns of `rows` may have their names."""
    return rows.select(*(columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go; the others get it where they name none."""
    kept = langid.identified(docs, whole_rows=True).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return replaced(kept, docs, lang=F.coalesce(F.col("row.lang").cast("string"), F.col("lang_pred")))


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates and repeated long lines go, and documents of which nothing else is left."""
    left = line_dedup.deduped(docs, whole_rows=True).where((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    return replaced(left, docs, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the least doc_id; five-word shingles, Jaccard of 0.8.

    Rows that repeat the doc_id of one that stays do so too, and so do all rows without a doc_id: nothing names them.
    """
    groups = jaccard_join.linked(docs, words=5, percent=80).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    return jaccard_join.without(docs, "doc_id", staged(groups.where("not stays").select("doc_id"), "gone"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to the target weights."""
    return mixing.mixed(docs, {k: F.expr(v) for k, v in MIX_LEVELS.items()}, TOKEN_SHARE, mix_weight(), max_epochs=1, keep=docs.columns).select("kept.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of token sequences."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("language ID", language_id), ("line dedup", line_templates), ("n-gram Jaccard join", near_duplicates), ("mixing to target weights", mixture), ("packing", sequences)]

#: Not all stages can be expressed in SQL. Tests hold near_duplicates against brute force and line_templates' operator against SQL,
#: and the effect of the others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{k}")
    return docs
