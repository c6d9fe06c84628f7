"""Minimizers of super-k-mers: unique and colliding ones, and the k-mers of the latter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.functions import packed
from kmerloom.plans.config import Options


def classified(super_kmers: DataFrame) -> DataFrame:
    """(minimizer, n, p1, size): distinct minimizers, with the shape of their super-k-mer where they have one only."""
    made = super_kmers.groupBy("minimizer").agg(F.count("*").alias("n"), F.min("p1").alias("p1"), F.min("size").alias("size"))
    one = F.col("n") == 1
    return made.select("minimizer", "n", F.when(one, F.col("p1")).alias("p1"), F.when(one, F.col("size")).alias("size"))


def distinct_runs(super_kmers: DataFrame) -> DataFrame:
    """(minimizer, p1, size, words, n_same): packed super-k-mers that read the same as one row, all of a minimizer in one partition."""
    runs = super_kmers.select("minimizer", "p1", "size", "words").repartition("minimizer")
    return runs.groupBy("minimizer", "p1", "size", "words").agg(F.count("*").alias("n_same"))


def held(super_kmers: DataFrame) -> DataFrame:
    """(minimizer, p1, size, words, n, first): distinct_runs() with the number of super-k-mers of their minimizer, one row of each of which is its first.

    What an index needs of its sequences, by one shuffle.
    """
    of = W.partitionBy("minimizer")
    return distinct_runs(super_kmers).select("minimizer", "p1", "size", "words", F.sum("n_same").over(of).alias("n"), (F.row_number().over(of.orderBy("minimizer")) == 1).alias("first"))


def owners(held_runs: DataFrame) -> DataFrame:
    """classified() of the super-k-mers of held()."""
    one = F.col("n") == 1
    return held_runs.where("first").select("minimizer", "n", F.when(one, F.col("p1")).alias("p1"), F.when(one, F.col("size")).alias("size"))


def distinct_kmers(super_kmers: DataFrame, k: int) -> DataFrame:
    """(kmer): the distinct k-mers of packed super-k-mers. Equal k-mers have one minimizer, so that only super-k-mers move, a few bytes a k-mer."""
    return _distinct(distinct_runs(super_kmers), k)


def _distinct(runs: DataFrame, k: int) -> DataFrame:
    """(kmer): of super-k-mers that are dealt by minimizer, so without a shuffle."""
    return kmers_of(runs, k, "minimizer").select("minimizer", "kmer").distinct().select("kmer")


def counts(super_kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, n): distinct_kmers() with how often each stands."""
    each = kmers_of(distinct_runs(super_kmers), k, "minimizer", "n_same")
    return each.groupBy("minimizer", "kmer").agg(F.sum("n_same").alias("n")).select("kmer", "n")


def canonical_counts(super_kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, n): how often each canonical k-mer stands in packed super-k-mers, whose minimizers are canonical too: a k-mer and its reverse complement have one, so only super-k-mers move."""
    each = kmers_of(distinct_runs(super_kmers), k, "minimizer", "n_same")
    return each.groupBy("minimizer", packed.canonical("kmer", k).alias("kmer")).agg(F.sum("n_same").alias("n")).select("kmer", "n")


def held_collisions(held_runs: DataFrame, k: int) -> DataFrame:
    """(kmer): the distinct k-mers of colliding minimizers, of held() as it was made."""
    return _distinct(held_runs.where("n > 1"), k)


def with_class(minimizers: DataFrame, options: Options) -> DataFrame:
    """The class of each minimizer, by where its super-k-mer ends: COLLISION, MAXIMAL, RIGHT, LEFT or NONE."""
    k, m, w = options.k, options.m, options.window
    at_right, full = F.col("p1") == k - m, F.col("size") == w
    cls = F.when(F.col("n") > 1, "COLLISION").when(at_right & full, "MAXIMAL").when(at_right, "RIGHT").when(F.col("p1") == F.col("size") - 1, "LEFT").otherwise("NONE")
    return minimizers.withColumn("cls", cls)


def kmers_of(super_kmers: DataFrame, k: int, *keep: str) -> DataFrame:
    """The k-mers of super-k-mers: the columns of `keep`, j (0 .. size - 1) and kmer, as numbers if the super-k-mers are packed."""
    bases = "words" if "words" in super_kmers.columns else "bases"
    at = super_kmers.select(*keep, bases, F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("j"))
    kmer = packed.kmer_of("words", "j", k) if bases == "words" else F.substring("bases", F.col("j") + 1, F.lit(k))
    return at.select(*keep, "j", kmer.alias("kmer"))


def owner_of(options: Options) -> Column:
    """The minimizer of a k-mer, from the columns `kmer` and `owner_at`, where in the k-mer it begins."""
    k, m = options.k, options.m
    mmer = packed.mmer_of("kmer", "owner_at", k, m)
    return F.least(F.expr(mmer), packed.reverse_complement(mmer, m)) if options.canonical else F.expr(mmer)


def colliding(super_kmers: DataFrame, minimizers: DataFrame) -> DataFrame:
    """The super-k-mers whose minimizer is owned by several."""
    return super_kmers.join(minimizers.where("n > 1").select("minimizer"), "minimizer", "left_semi")


def colliding_kmers(super_kmers: DataFrame, minimizers: DataFrame, k: int) -> DataFrame:
    """(kmer): the distinct k-mers of colliding minimizers."""
    return kmers_of(colliding(super_kmers, minimizers), k).select("kmer").distinct()
