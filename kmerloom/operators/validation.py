"""Checks of an index against sequences; each gives rows that must not be, so a sound index gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.operators import lookup
from kmerloom.operators.index import Index
from kmerloom.operators.lookup import by_kmer, by_super_kmer
from kmerloom.operators.minimizers import distinct_runs
from kmerloom.operators.sequences import packed_kmers, packed_super_kmers
from kmerloom.storage import staged

#: What report() counts.
KINDS = ("out_of_bounds", "duplicate_codes", "uncovered_codes", "stream_differs", "missing_kmers")


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("long")


def out_of_bounds(codes: DataFrame, n: int) -> DataFrame:
    return codes.where("hval is null").unionByName(codes.where((F.col("hval") < 0) | (F.col("hval") >= n)))


def duplicates(coded_kmers: DataFrame) -> DataFrame:
    """Codes that different k-mers have."""
    return coded_kmers.select("kmer", "hval").distinct().groupBy("hval").agg(F.count("*").alias("n")).where("n > 1")


def population(codes: DataFrame, n: int) -> DataFrame:
    """One row, (n_codes, out_of_bounds, uncovered_codes), by one aggregation into bitmaps of 4 KB for every 32,768 codes."""
    inside = F.col("hval").between(0, n - 1)
    place = F.when(inside, F.col("hval"))
    maps = codes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.count("*").alias("n"), F.when(F.col("bucket").isNotNull(), F.bitmap_construct_agg(F.bitmap_bit_position(place))).alias("bits"))
    counts = maps.select("n", "bucket", F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0).alias("found"))
    return counts.agg(zero(F.sum("n")).alias("n_codes"), zero(F.sum(F.when(F.col("bucket").isNull(), F.col("n")))).alias("out_of_bounds"), (F.lit(n) - zero(F.sum("found"))).cast("long").alias("uncovered_codes"))


def uncovered(codes: DataFrame, n: int) -> DataFrame:
    """Codes below n that no k-mer has."""
    return codes.sparkSession.range(n).select(F.col("id").alias("hval")).join(codes.select("hval").distinct(), "hval", "left_anti")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places whose codes differ between two lookups, or that one of them lacks."""
    key = ["seq_id", "seg_id", "pos"]
    both = a.withColumnRenamed("hval", "a").join(b.withColumnRenamed("hval", "b"), key, "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def compared(contigs: DataFrame, index: Index, tile: int | None = None) -> DataFrame:
    """report() by comparing rows: every k-mer's codes of both lookups, at each place, and the k-mers themselves are shuffled against each other."""
    n = index.n_kmers
    stepped = staged(by_super_kmer(contigs, index, True, tile), "codes", "zstd")
    parts = {
        "duplicate_codes": duplicates(stepped),
        "stream_differs": differences(stepped.drop("kmer"), by_kmer(contigs, index, tile)),
        "missing_kmers": packed_kmers(contigs, index.options.k, tile).select("kmer").distinct().join(stepped.select("kmer").distinct(), "kmer", "left_anti"),
    }
    counts = [population(stepped, n).selectExpr("stack(2, 'out_of_bounds', out_of_bounds, 'uncovered_codes', uncovered_codes) as (what, n)")]
    counts += [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in parts.items()]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every.groupBy().pivot("what", list(KINDS)).agg(F.sum("n"))


#: Bits of a part of a hash that summed() adds up: sums of 2^39 rows fit a long.
PART_BITS = 24


def summed(value: Column, times: Column | None = None) -> list[Column]:
    """Sums s0 .. s3 of four parts of two hashes of `value`, each row counted `times` times: equal for the same values as often, whatever their order, and else
    equal with a chance of about 2^-96."""
    hashes = F.xxhash64(value), F.xxhash64(value, F.lit(1))
    parts = [F.shiftrightunsigned(h, PART_BITS * i).bitwiseAND((1 << PART_BITS) - 1) for h in hashes for i in (0, 1)]
    return [F.coalesce(F.sum(p if times is None else p * times), F.lit(0)).cast("long").alias(f"s{i}") for i, p in enumerate(parts)]


def sound(contigs: DataFrame, index: Index, tile: int | None = None) -> bool:
    """Whether report() is all 0, told from sums: super-k-mers that read the same are looked up once, as by_super_kmer() does it, where minimizers deal them, and no k-mer moves.

    * The codes of the distinct k-mers are 0 .. n - 1, each once: as many as n, and with the sums of those numbers. So none is out of bounds, uncovered or had by two.
    * The k-mers looked up, with the number of their places, have the sums of those that are cut from the sequences themselves. So none is missing, and each place has one code.
    * by_kmer() has the same codes: it differs only in that it finds a row of the fallback by its k-mer alone, and every row was found by its k-mer and its minimizer.
    """
    k, n = index.options.k, index.n_kmers
    joined = lookup.met(lookup.headed(distinct_runs(packed_super_kmers(contigs, index.options, tile).where("minimizer is not null")), "n_same"), index)
    alone = lookup.cut(joined.where(~lookup.run_collides())).select(lookup.cut_kmer(k).alias("kmer"), F.col("n_same").alias("n"), lookup.stepped_code().alias("hval"))
    asked = lookup.cut(joined.where("cls = 'COLLISION'")).select("minimizer", lookup.cut_kmer(k).alias("probe"), "n_same").groupBy("minimizer", "probe").agg(F.sum("n_same").alias("n"))
    # rows of the fallback that no k-mer asks for have a null n
    probed = lookup.met_fallback(asked, index, "full_outer").select(F.col("probe").alias("kmer"), "n", (F.col("fb_rank") + index.n_main).alias("hval"))
    counts = F.count("*").alias("rows"), F.count("n").alias("asked"), F.count("hval").alias("coded"), zero(F.sum("n")).alias("places")
    sums = F.struct(*summed(F.col("kmer"), F.coalesce("n", F.lit(0)))).alias("kmers"), F.struct(*summed(F.col("hval"))).alias("codes")
    # one job, so that the runs move once
    rows = alone.agg(*counts, *sums).unionByName(probed.agg(*counts, *sums)).collect()
    total = {c: sum(r[c] for r in rows) for c in ("rows", "asked", "coded", "places")}
    if not total["rows"] == total["asked"] == total["coded"] == n:
        return False
    added = lambda name: [sum(xs) for xs in zip(*(r[name] for r in rows), strict=True)]
    if added("codes") != list(contigs.sparkSession.range(n).agg(*summed(F.col("id"))).first()):
        return False
    return [total["places"], *added("kmers")] == list(packed_kmers(contigs, k, tile).agg(F.count("*"), *summed(F.col("kmer"))).first())


def report(contigs: DataFrame, index: Index, tile: int | None = None) -> DataFrame:
    """One row: how many violations of each kind the sequences that the index was built from show. All 0 for a sound index, which sums tell; any other is compared row by row."""
    if sound(contigs, index, tile):
        return contigs.sparkSession.range(1).select(*(F.lit(0).cast("long").alias(what) for what in KINDS))
    return compared(contigs, index, tile)
