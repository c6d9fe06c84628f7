"""The registered queries of the corpus operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import filter_audit, fingerprints, jaccard_join, langid, line_dedup, mixing, packing, periodic_runs, pii, quality, substring_dedup, suffix_dedup, topk_search
from kmerloom.llm.common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(documents(spark, sf_dir))


#: The tree of the mixing query: a domain is a set of sources; weights of each level's nodes, 1 where none is named.
MIX_LEVELS = {"domain": "CASE WHEN source = 'src0' THEN 'web' WHEN source IN ('src1', 'src2', 'src3', 'src4') THEN 'books' ELSE 'reference' END", "lang": "lang", "source": "source"}
MIX_WEIGHTS = ["CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 5 ELSE 3 END", "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 3 ELSE 2 END", "CASE WHEN source = '' THEN 0.5 ELSE 1 END"]
MIX_SHARE = 0.6


def mix_weight():
    return F.expr(f"CASE WHEN source IS NOT NULL THEN {MIX_WEIGHTS[2]} WHEN lang IS NOT NULL THEN {MIX_WEIGHTS[1]} ELSE {MIX_WEIGHTS[0]} END")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir), {k: F.expr(v) for k, v in MIX_LEVELS.items()}, MIX_SHARE, mix_weight())


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduped(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), vocabulary("piece_bpe_32k.model"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(documents(spark, sf_dir), words=3, percent=90)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduped(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.collapsed(documents(spark, sf_dir), planted=True)


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_mixing, op4_fingerprints, op5_language_id, op6_pii, op7_line_dedup, op8_quality_rules, op9_jaccard_join, op10_suffix_dedup, op11_periodic_runs, op12_topk_search, op13_filter_audit)}

#: DuckDB SQL for the rows of the queries above; the others are tested against brute force.
SQL: dict[str, str] = {"op2_substring_dedup": substring_dedup.SQL, "op3_mixing": mixing.sql(MIX_LEVELS, MIX_WEIGHTS, MIX_SHARE), "op7_line_dedup": line_dedup.SQL, "op12_topk_search": topk_search.SQL, "op13_filter_audit": filter_audit.SQL}
