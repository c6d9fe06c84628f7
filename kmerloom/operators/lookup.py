"""Codes of the k-mers of sequences: one index probe a super-k-mer, or one a k-mer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import packed
from kmerloom.operators import membership
from kmerloom.operators.index import Index
from kmerloom.operators.sequences import kmer_counts, packed_kmers, packed_super_kmers
from kmerloom.operators.skew import spread_join
from kmerloom.storage import discarded, staged

#: Bits of a run's header below its size: the place of the minimizer in its first k-mer.
PLACE_BITS = 32


def headed(super_kmers: DataFrame, *keep: str) -> DataFrame:
    """(.. keep, minimizer, run): packed super-k-mers; `run` are a run's words behind its header: size, and the place of the minimizer in the first k-mer."""
    header = F.shiftleft(F.col("size").cast("long"), PLACE_BITS).bitwiseOR(F.col("p1").cast("long"))
    return super_kmers.select(*keep, "minimizer", F.concat(F.array(header), "words").alias("run"))


def headed_runs(contigs: DataFrame, index: Index, tile: int | None = None) -> DataFrame:
    """(seq_id, seg_id, start, minimizer, run): headed() of the super-k-mers of `contigs`."""
    return headed(packed_super_kmers(contigs, index.options, tile).where("minimizer is not null"), "seq_id", "seg_id", "start")


def met(runs: DataFrame, index: Index) -> DataFrame:
    """`runs` of headed() with cls, base and sign of their minimizer, nulls where the index hasn't got it. A hash join, as minimizers are distinct and few to runs: these aren't sorted."""
    return runs.join(index.minimizers.select("minimizer", "cls", "base", "sign").hint("shuffle_hash"), "minimizer", "left")


def met_runs(contigs: DataFrame, index: Index, tile: int | None = None, spread: bool = False) -> DataFrame:
    """(minimizer, seq_id, seg_id, start, run, cls, base, sign): headed_runs() with the row of their minimizer, nulls where the index hasn't got it."""
    runs = headed_runs(contigs, index, tile)
    if spread:
        return spread_join(runs, index.minimizers.select("minimizer", "cls", "base", "sign"), "minimizer", ["seq_id", "seg_id", "start"])
    return met(runs, index)


def met_fallback(probes: DataFrame, index: Index, how: str = "left") -> DataFrame:
    """`probes` (minimizer, probe, ..), which are dealt by minimizer, with fb_rank, null where the fallback hasn't got the k-mer.

    Equal k-mers have one minimizer, so that the join finds both sides where they are and no probe moves: Spark may take sides that are dealt by some keys of a join
    as they are, which it must be allowed once a session. Nor are they sorted; the hashed side is one partition's part of the fallback.
    """
    owned = index.owned_fallback()
    if owned is None:
        return probes.join(index.fallback.select(F.col("kmer").alias("probe"), "fb_rank"), "probe", how)
    probes.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return probes.join(owned.withColumnRenamed("kmer", "probe").hint("shuffle_hash"), ["minimizer", "probe"], how)


def run_size() -> Column:
    """Of a row of met_runs(): the number of its k-mers."""
    return F.shiftright(F.col("run")[0], PLACE_BITS).cast("int")


def run_place() -> Column:
    """The place of the minimizer in the first of them."""
    return F.col("run")[0].bitwiseAND((1 << PLACE_BITS) - 1)


def run_collides() -> Column:
    """Whether they are ranked one by one."""
    return F.coalesce(F.col("cls") == "COLLISION", F.lit(False))


def cut(joined: DataFrame) -> DataFrame:
    """A row a k-mer of the runs: `j` is its place in its run."""
    return joined.select("*", F.explode(F.sequence(F.lit(0), run_size() - 1)).alias("j"))


def cut_kmer(k: int) -> Column:
    """Of a row of cut(): the k-mer."""
    return packed.kmer_of("run", f"(j + {packed.WORD})", k)


def stepped_code() -> Column:
    """Of a row of cut() whose run doesn't collide: the code, which steps from the minimizer's; null where the index hasn't got the minimizer."""
    return F.col("base") + F.col("sign") * (run_place() - F.col("j"))


def probed_runs(joined: DataFrame, index: Index, spread: bool = False) -> DataFrame:
    """(seq_id, seg_id, pos, probe, hval) of the k-mers, `probe`, of the colliding runs of met_runs()."""
    probes = cut(joined.where("cls = 'COLLISION'")).select("minimizer", "seq_id", "seg_id", (F.col("start") + F.col("j")).alias("pos"), cut_kmer(index.options.k).alias("probe"))
    if spread:
        probed = spread_join(probes.drop("minimizer"), index.fallback.select(F.col("kmer").alias("probe"), "fb_rank"), "probe", ["seq_id", "seg_id", "pos"])
    else:
        probed = met_fallback(probes, index)
    return probed.select("seq_id", "seg_id", "pos", "probe", (F.col("fb_rank") + index.n_main).alias("hval"))


def by_super_kmer(contigs: DataFrame, index: Index, keep_kmer: bool = False, tile: int | None = None, spread: bool = False) -> DataFrame:
    """(seq_id, seg_id, pos, hval) of every k-mer: the join is made once a super-k-mer, its k-mers step from there.

    K-mers that are surely not in the index (an unknown minimizer, or a colliding one and an unknown k-mer) have a null
    code; other k-mers outside it may get any code, as the index holds no keys. `tile` cuts very long sequences, so that
    they spread over tasks. With keep_kmer the k-mers are returned too, as numbers. With `spread`, minimizers and k-mers that very
    many runs or probes have, as those of low complexity, are found by a first pass and dealt over all tasks; not for streams.

    Runs whose minimizer is unique or unknown, and runs of colliding ones, are two joins of one shuffle of all runs: both take
    the same columns of it, a run's header (its size, and the place of its minimizer) being the first of its words. K-mers of colliding minimizers are
    probed where their runs are, see met_fallback(); with `spread` they move.
    """
    joined = met_runs(contigs, index, tile, spread)
    kept = [cut_kmer(index.options.k).alias("kmer")] if keep_kmer else []
    stepped = cut(joined.where(~run_collides())).select("seq_id", "seg_id", (F.col("start") + F.col("j")).alias("pos"), stepped_code().alias("hval"), *kept)
    return stepped.unionByName(probed_runs(joined, index, spread).select("seq_id", "seg_id", "pos", "hval", *([F.col("probe").alias("kmer")] if keep_kmer else [])))


def thinned(contigs: DataFrame, index: Index, tile: int | None = None, filter_bytes: int = membership.MOST_BYTES) -> Index:
    """`index` with few of the rows that no lookup of `contigs` asks for, told by filters of their minimizers and k-mers: the codes are the same, and of a large index few rows are
    dealt and hashed. Sequences whose filters were larger than `filter_bytes`, or of more k-mers than the index, take the index as it is."""
    k = index.options.k
    n = kmer_counts(contigs, k).agg(F.coalesce(F.sum("n_kmers"), F.lit(0))).first()[0]
    if n > index.n_kmers or membership.size(n) > filter_bytes:
        return index
    runs = packed_super_kmers(contigs, index.options, tile)

    def asked(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
        bloom = membership.built(keys, key, n)
        rows = staged(membership.judged(table, key, bloom, n, "maybe").where("maybe").drop("maybe"), "asked", "zstd")
        discarded(bloom)
        return rows

    table = asked(index.minimizers, "minimizer", runs.select("minimizer"))
    return Index(index.options, table, asked(index.fallback, "kmer", packed_kmers(contigs, k, tile).select("kmer")), index.n_main, index.n_kmers)


def by_kmer(contigs: DataFrame, index: Index, tile: int | None = None) -> DataFrame:
    """The same codes, each k-mer looked up for itself: its minimizer's row by one join, its own, if that collides, by another.

    Super-k-mers are dealt by minimizer and cut there, so that no k-mer moves to the first join; only k-mers of colliding minimizers move to the second.
    """
    dealt = headed_runs(contigs, index, tile).repartition("minimizer")
    each = dealt.select("*", F.explode(F.sequence(F.lit(0), run_size() - 1)).alias("j"))
    each = each.select("seq_id", "seg_id", (F.col("start") + F.col("j")).alias("pos"), "minimizer", (run_place() - F.col("j")).alias("p"), packed.kmer_of("run", f"(j + {packed.WORD})", index.options.k).alias("kmer"))
    # a hash join, as minimizers are distinct and few to k-mers: these aren't sorted, which spilled
    met = each.join(index.minimizers.select("minimizer", "cls", "base", "sign").hint("shuffle_hash"), "minimizer", "left")
    plain = met.where(~run_collides()).select("seq_id", "seg_id", "pos", (F.col("base") + F.col("sign") * F.col("p")).alias("hval"))
    probed = met.where("cls = 'COLLISION'").select("seq_id", "seg_id", "pos", "kmer").join(index.fallback, "kmer", "left")
    return plain.unionByName(probed.select("seq_id", "seg_id", "pos", (F.col("fb_rank") + index.n_main).alias("hval")))


def strict(contigs: DataFrame, index: Index, keys: DataFrame, tile: int | None = None, filter_bytes: int = membership.MOST_BYTES) -> DataFrame:
    """by_super_kmer() with a null code for every k-mer that isn't among `keys` (kmer, as text or numbers, repeated or not), the index's own k-mers.

    Of the index only thinned() rows are looked up. If the k-mers that have a code are fewer than the index's, a filter of them thins out the keys before these move; else a filter of the keys thins
    out the k-mers. Filters go to all tasks; larger ones than `filter_bytes` aren't made, and all are joined. The rows are the same.
    """
    kmer = packed.from_text(F.col("kmer"), index.options.k) if dict(keys.dtypes)["kmer"] == "string" else F.col("kmer")
    known = keys.select(kmer.alias("known"))
    found = staged(by_super_kmer(contigs, thinned(contigs, index, tile, filter_bytes), keep_kmer=True, tile=tile), "found", "zstd")
    asked = staged(found.where("hval is not null").select("kmer").distinct(), "asked", "zstd")
    n_asked, aliens = asked.count(), []
    if n_asked <= index.n_kmers and membership.size(n_asked) <= filter_bytes:
        known = membership.judged(known, "known", membership.built(asked, "kmer", n_asked), n_asked, "maybe").where("maybe").select("known")
    elif membership.size(index.n_kmers) <= filter_bytes:
        judged = membership.judged(found, "kmer", membership.built(known, "known", index.n_kmers), index.n_kmers, "maybe")
        found, aliens = judged.where("maybe"), [judged.where("not maybe").select("seq_id", "seg_id", "pos", F.lit(None).cast("long").alias("hval"))]
    checked = found.join(known.distinct(), F.col("kmer") == F.col("known"), "left").select("seq_id", "seg_id", "pos", F.when(F.col("known").isNotNull(), F.col("hval")).alias("hval"))
    for rows in aliens:
        checked = checked.unionByName(rows)
    return checked


def counted(contigs: DataFrame, index: Index, one_by_one: bool = False) -> DataFrame:
    """(n_kmers, n_found): a lookup of which only the counts return."""
    found = by_kmer(contigs, index) if one_by_one else by_super_kmer(contigs, index)
    return found.agg(F.count("*").alias("n_kmers"), F.count("hval").alias("n_found"))
