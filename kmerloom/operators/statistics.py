"""Figures of an index and of the sequences it is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.operators import lookup
from kmerloom.operators.index import Index
from kmerloom.operators.minimizers import classified
from kmerloom.plans.config import Options


def build_statistics(contigs: DataFrame, super_kmers: DataFrame, options: Options) -> DataFrame:
    """One row: n_contigs, n_kmers, n_super_kmers, n_minimizers, frac_nonunique (super-k-mers of colliding minimizers per
    distinct minimizer), eps_theory and eps_true (super-k-mers per k-mer, expected and counted), alpha (contigs less one
    per k-mer). Without k-mers the ratios are null."""
    runs = super_kmers.agg(F.count("*").alias("n_super_kmers"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_kmers"))
    owners = classified(super_kmers).agg(F.count("*").alias("n_minimizers"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("n_colliding"))
    one = lambda df: df.withColumn("one", F.lit(1))
    row = one(contigs.agg(F.count("*").alias("n_contigs"))).join(one(runs), "one").join(one(owners), "one")
    n = F.when(F.col("n_kmers") > 0, F.col("n_kmers"))
    return row.select(
        "n_contigs", "n_kmers", "n_super_kmers", "n_minimizers",
        (F.col("n_colliding") / F.when(F.col("n_minimizers") > 0, F.col("n_minimizers"))).alias("frac_nonunique"),
        F.lit(2.0 / (options.window + 1)).alias("eps_theory"), (F.col("n_super_kmers") / n).alias("eps_true"), (F.greatest(F.col("n_contigs") - 1, F.lit(0)) / n).alias("alpha"),
    )


def class_counts(index: Index) -> DataFrame:
    """(cls, n_minimizers, percent): the percentage is of the unique minimizers, for COLLISION of all."""
    counts = index.minimizers.groupBy("cls").agg(F.count("*").alias("n_minimizers"))
    every = W.partitionBy(F.lit(0))
    unique = F.sum(F.when(F.col("cls") != "COLLISION", F.col("n_minimizers")).otherwise(0)).over(every)
    of = F.when(F.col("cls") == "COLLISION", F.sum("n_minimizers").over(every)).otherwise(unique)
    return counts.select("cls", "n_minimizers", (100.0 * F.col("n_minimizers") / of).alias("percent"))


def _elias_fano(n: Column, universe: Column) -> Column:
    """Bits of an Elias-Fano sequence of n + 1 prefix sums up to `universe`: n + 1 low parts, and the unary high parts."""
    m = n + 1
    low = F.when(universe >= m, F.floor(F.log2((universe / m).cast("double")))).otherwise(F.lit(0)).cast("long")
    return m * low + m + F.floor(universe / F.pow(F.lit(2.0), low)).cast("long") + 1


def space_model(index: Index) -> DataFrame:
    """(component, bits, bits_per_kmer): a closed-form model of a succinct encoding, with options.bits_per_key for each perfect hash function."""
    o, t = index.options, index.minimizers
    one = F.col("cls") != "COLLISION"
    width = F.coalesce(F.sum("size"), F.lit(0)).cast("long")
    if o.layout == "partitioned":
        # sums of sizes of LEFT, RIGHT (collisions as zeros) and NONE, and of the places of NONE; MAXIMAL is implicit
        part = F.col("cls") != "MAXIMAL"
        listed = F.sum(F.when(part, 1).otherwise(0)) + F.sum(F.when(F.col("cls") == "NONE", 1).otherwise(0))
        universe = F.coalesce(F.sum(F.when(part & one, F.col("size"))), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("cls") == "NONE", F.col("p1"))), F.lit(0))
        row = t.agg(F.count("*").alias("d"), F.coalesce(listed, F.lit(0)).cast("long").alias("listed"), universe.cast("long").alias("universe"))
        parts = {"minimizer_order": F.col("d") * F.lit(o.bits_per_key), "classes": F.col("d") * 2 * F.lit(1.25), "sizes_and_positions": _elias_fano(F.col("listed"), F.col("universe")).cast("double")}
    else:
        row = t.agg(F.count("*").alias("d"), width.alias("sizes"), F.coalesce(F.sum("p1"), F.lit(0)).cast("long").alias("places"))
        parts = {"minimizer_order": F.col("d") * F.lit(o.bits_per_key), "sizes": _elias_fano(F.col("d"), F.col("sizes")).cast("double"), "positions": _elias_fano(F.col("d"), F.col("places")).cast("double")}
    parts["fallback"] = F.lit(float((index.n_kmers - index.n_main) * o.bits_per_key))
    bits = F.explode(F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*(p.cast("double") for p in parts.values()))))
    return row.select(bits.alias("component", "bits")).withColumn("bits_per_kmer", F.col("bits") / F.lit(max(1, index.n_kmers)))


#: Places of a segment that one window sees, whatever its length.
BLOCK = 1 << 14


def _with_next(codes: DataFrame, block: int) -> DataFrame:
    """Rows with `after`, the code at the next place of the segment that has a row. Windows are of blocks of places; each has a copy of the next one's first row, if that is at the block's very start."""
    here = F.floor(F.col("pos") / block).cast("long")
    into = F.when((F.col("pos") % block == 0) & (F.col("pos") > 0), F.array(here, here - 1)).otherwise(F.array(here))
    dealt = codes.select("*", here.alias("own"), F.explode(into).alias("block"))
    w = W.partitionBy("seq_id", "seg_id", "block").orderBy("pos")
    return dealt.withColumn("after", F.lead("hval").over(w)).where("block = own").drop("own", "block")


def _pairs(met: DataFrame, inside: Column) -> DataFrame:
    """Of rows of _with_next(); `inside` are pairs, all adjacent, that a row has counted already."""
    close = F.coalesce(F.abs(F.col("after") - F.col("hval")) == 1, F.lit(False)).cast("long")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return met.agg((F.count("after") + total(inside)).alias("n_pairs"), total(close + inside).alias("n_adjacent"))


def locality(codes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(n_pairs, n_adjacent): neighbouring k-mers of a segment, and those of them whose codes are neighbours too. Of every place of a segment there is a row."""
    return _pairs(_with_next(codes, block), F.lit(0))


def run_locality(contigs: DataFrame, index: Index, tile: int | None = None, block: int = BLOCK) -> DataFrame:
    """locality() of a lookup of `contigs`, whose steps inside a super-k-mer are counted and not made.

    Codes of a run with a unique minimizer are neighbours by construction, so only its two ends, and the k-mers of colliding
    minimizers, meet their neighbours.
    """
    joined = lookup.met_runs(contigs, index, tile)
    alone = joined.where(~lookup.run_collides()).select("seq_id", "seg_id", "start", "base", "sign", lookup.run_size().alias("size"), lookup.run_place().alias("place"))
    last = F.col("size") - 1
    # the first k-mer of a longer run is met by the run before only: its own next one is inside the run
    ends = F.explode(F.when(last > 0, F.array(F.lit(0), last)).otherwise(F.array(F.lit(0)))).alias("j")
    met = alone.select("*", ends).select("seq_id", "seg_id", (F.col("start") + F.col("j")).alias("pos"), (F.col("base") + F.col("sign") * (F.col("place") - F.col("j"))).alias("hval"), (F.col("j") == last).alias("opens"), F.when(F.col("base").isNotNull(), last).otherwise(0).alias("inside"))
    each = lookup.probed_runs(joined, index).select("seq_id", "seg_id", "pos", "hval", F.lit(True).alias("opens"), F.lit(0).alias("inside"))
    return _pairs(_with_next(met.unionByName(each), block).where("opens"), F.col("inside"))


def fallback_share(index: Index) -> float:
    """Share of the k-mers that are ranked one by one."""
    return (index.n_kmers - index.n_main) / index.n_kmers if index.n_kmers else 0.0


def parameters(index: Index) -> DataFrame:
    """(name, value): the options and totals of an index, as text."""
    o = index.options
    rows = [("k", o.k), ("m", o.m), ("seed", o.seed), ("layout", o.layout), ("hasher", o.hasher), ("canonical", o.canonical), ("n_kmers", index.n_kmers), ("n_main", index.n_main), ("fallback_share", fallback_share(index))]
    return index.minimizers.sparkSession.createDataFrame([(a, str(b)) for a, b in rows], "name string, value string")
