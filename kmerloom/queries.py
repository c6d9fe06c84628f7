"""The registered queries of the k-mer engine over sequences made from `documents` and `benchmark`, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions import dna, packed
from kmerloom.operators import baselines, lookup, membership, minimizers, perfect_hash, sequences, statistics, validation
from kmerloom.operators.index import Index, build, kept, relaid
from kmerloom.operators.ranking import order_violations, ranked
from kmerloom.plans.config import Options
from kmerloom.sources import sequences as files
from kmerloom.storage import checkpointed, new_folder, staged
from kmerloom.streaming import lookup as streaming

OPTIONS = Options(k=31, m=15)
K, M, W = OPTIONS.k, OPTIONS.m, OPTIONS.window
GAMMA, LEVELS = 2.0, 6
#: K-mers of a tile: long sequences spread over tasks, and so do the sequences of a file that is one split.
TILE = 1 << 14
#: The largest k, whose k-mers are two numbers.
LONG = Options(k=63, m=17)

#: Indexes built in this session, by application, files and layout: most queries ask for the same one.
_built: dict[tuple, Index] = {}


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def aliens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_text(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """The files of `documents` with their sizes and times, so that an index of other files isn't taken for theirs."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/documents.parquet").select("path", "length", "modificationTime")
    return tuple(sorted(map(tuple, listed.collect())))


def index(spark: SparkSession, sf_dir: str, layout: str = "partitioned") -> Index:
    key = (spark.sparkContext.applicationId, _files(spark, sf_dir), layout)
    if key not in _built:
        if layout == "partitioned":
            _built[key] = build(contigs(spark, sf_dir), OPTIONS, TILE)
        else:
            made = relaid(index(spark, sf_dir), layout)
            made.minimizers = kept(made.minimizers, "minimizers")
            _built[key] = made
    return _built[key]


def super_kmer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.super_kmers(contigs(spark, sf_dir), OPTIONS)


def packed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.packed_super_kmers(contigs(spark, sf_dir), OPTIONS, TILE)


def distinct_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimizers.distinct_kmers(packed_runs(spark, sf_dir), K)


def as_text(df: DataFrame) -> DataFrame:
    """Minimizers and k-mers, which are numbers inside the engine, as text."""
    lengths = {"minimizer": M, "kmer": K}
    return df.select(*(packed.to_text(F.col(c), lengths[c]).alias(c) if c in lengths else c for c in df.columns))


def segments(spark, d):
    return sequences.segments(contigs(spark, d), K).select("seq_id", "seg_id", "seg")


def kmer_explode(spark, d):
    return sequences.kmers(contigs(spark, d), K)


def kmer_count(spark, d):
    return sequences.kmer_counts(contigs(spark, d), K)


def kmer_distinct_count(spark, d):
    return distinct_kmers(spark, d).agg(F.count("*").alias("n_distinct"))


def revcomp(spark, d):
    return sequences.segments(contigs(spark, d), K).select("seq_id", "seg_id", dna.reverse_complement(F.col("seg")).alias("revcomp"))


def canonical_kmers(spark, d):
    runs = sequences.packed_super_kmers(contigs(spark, d), replace(OPTIONS, canonical=True), TILE)
    return as_text(minimizers.canonical_counts(runs, K))


def canonical_kmers_63(spark, d):
    made = sequences.packed_kmers(contigs(spark, d), LONG.k, tile=1 << 10).groupBy(packed.canonical("kmer", LONG.k).alias("kmer")).agg(F.count("*").alias("n"))
    return made.select(packed.to_text(F.col("kmer"), LONG.k).alias("kmer"), "n")


def lookup_63(spark, d):
    given = contigs(spark, d)
    return lookup.by_super_kmer(given, build(given, LONG, tile=1 << 10), tile=1 << 10)


def packed_mmers(spark, d):
    """Minimizers as numbers, two bits a base."""
    return as_text(packed_runs(spark, d).select("minimizer").distinct().withColumn("packed", F.col("minimizer")))


def kmer_minimizer(spark, d):
    each = minimizers.kmers_of(super_kmer_table(spark, d), K, "seq_id", "seg_id", "start", "minimizer", "p1")
    return each.select("seq_id", "seg_id", (F.col("start") + F.col("j")).alias("pos"), "minimizer", (F.col("p1") - F.col("j")).alias("p"))


def super_kmers(spark, d):
    return super_kmer_table(spark, d).select("seq_id", "seg_id", "start", "minimizer", "p1", "size")


def super_kmer_histogram(spark, d):
    return packed_runs(spark, d).groupBy("p1", "size").agg(F.count("*").alias("n"))


def minimizer_classify(spark, d):
    return as_text(minimizers.with_class(minimizers.classified(packed_runs(spark, d)), OPTIONS))


def colliding_minimizers(spark, d):
    return as_text(minimizers.classified(packed_runs(spark, d)).where("n > 1").select("minimizer", "n"))


def colliding_kmers(spark, d):
    return as_text(minimizers.held_collisions(minimizers.held(packed_runs(spark, d)), K))


def class_counts(spark, d):
    return statistics.class_counts(index(spark, d))


def minimizer_rank(spark, d):
    return as_text(index(spark, d).minimizers.select("minimizer", "mm_rank"))


def fallback_rank(spark, d):
    return as_text(index(spark, d).fallback.select("kmer", "fb_rank"))


def rank_in_class(spark, d):
    """Each minimizer's place among those of its class: the global place less that of the class's first."""
    placed = ranked(index(spark, d).minimizers.select("minimizer", "cls", "mm_rank"), ["cls", "mm_rank"], "at")
    first = placed.groupBy("cls").agg(F.min("at").alias("first"))  # a row a class
    return as_text(placed.join(F.broadcast(first), "cls").select("minimizer", "cls", (F.col("at") - F.col("first")).alias("rank")))


def index_partitioned(spark, d):
    return as_text(index(spark, d).minimizers.drop("n"))


def index_unpartitioned(spark, d):
    return as_text(index(spark, d, "unpartitioned").minimizers.select("minimizer", "mm_rank", "base", "sign"))


def lookup_streaming_p(spark, d):
    return lookup.by_super_kmer(contigs(spark, d), index(spark, d), tile=TILE)


def lookup_streaming_u(spark, d):
    return lookup.by_super_kmer(contigs(spark, d), index(spark, d, "unpartitioned"), tile=TILE)


def lookup_spread(spark, d):
    return lookup.by_super_kmer(contigs(spark, d), index(spark, d), tile=TILE, spread=True)


def lookup_random_p(spark, d):
    return lookup.by_kmer(contigs(spark, d), index(spark, d), TILE)


def lookup_random_u(spark, d):
    return lookup.by_kmer(contigs(spark, d), index(spark, d, "unpartitioned"), TILE)


def lookup_count(spark, d):
    return lookup.counted(contigs(spark, d), index(spark, d))


def lookup_count_random(spark, d):
    return lookup.counted(contigs(spark, d), index(spark, d), one_by_one=True)


def few_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of the aliens, who are few to the index."""
    given, made = aliens(spark, sf_dir), index(spark, sf_dir)
    return lookup.by_super_kmer(given, lookup.thinned(given, made))


def lookup_alien(spark, d):
    return few_looked_up(spark, d)


def lookup_strict(spark, d):
    # the keys are cut and thinned out where they stand: they needn't be distinct
    return lookup.strict(aliens(spark, d), index(spark, d), sequences.packed_kmers(contigs(spark, d), K, TILE))


def lookup_stream(spark, d):
    """The sequences as a stream of files."""
    source, out, state = (new_folder(spark, f"stream-{x}") for x in ("in", "out", "state"))
    given = contigs(spark, d).select("seq_id", "seq")
    given.write.parquet(source)
    query = streaming.written(spark.readStream.schema(given.schema).parquet(source), index(spark, d), out, state)
    query.awaitTermination()
    return spark.read.parquet(out)


def check_index(spark, d):
    return validation.report(contigs(spark, d), index(spark, d))


def check_index_unpartitioned(spark, d):
    return validation.report(contigs(spark, d), index(spark, d, "unpartitioned"))


def build_stats(spark, d):
    return statistics.build_statistics(contigs(spark, d), checkpointed(packed_runs(spark, d)), OPTIONS)


def space_model(spark, d):
    return statistics.space_model(index(spark, d))


def locality(spark, d):
    return statistics.run_locality(contigs(spark, d), index(spark, d), TILE)


def locality_random(spark, d):
    """The same of codes that were looked up one by one."""
    return statistics.locality(lookup.by_kmer(contigs(spark, d), index(spark, d), TILE))


def whole_set_mphf(spark, d):
    return as_text(baselines.by_rank(staged(distinct_kmers(spark, d), "kmers", "zstd"), distinct=True))


def baseline_lookup(spark, d):
    """The alien k-mers in a saved whole-set baseline."""
    path = new_folder(spark, "baseline")
    baselines.by_rank(staged(distinct_kmers(spark, d), "kmers", "zstd"), distinct=True).write.parquet(path)
    return baselines.looked_up(sequences.packed_kmers(aliens(spark, d), K), spark.read.parquet(path)).select("seq_id", "seg_id", "pos", "hval")


def bbhash(spark, d):
    return as_text(baselines.by_levels(staged(distinct_kmers(spark, d), "kmers", "zstd"), GAMMA, LEVELS, K, distinct=True))


def _codes_of(kmers: DataFrame, function: perfect_hash.Function) -> DataFrame:
    """Whether a function is minimal and perfect over its own k-mers: as many codes as k-mers, from 0 on."""
    place = F.when(F.col("hval") >= 0, F.col("hval"))
    found = perfect_hash.looked_up(kmers, function).groupBy(F.bitmap_bucket_number(place).alias("bucket"))
    maps = found.agg(F.count("*").alias("n"), F.when(F.col("bucket").isNotNull(), F.bitmap_construct_agg(F.bitmap_bit_position(place))).alias("bits"), F.min("hval").alias("least"), F.max("hval").alias("most"))
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return maps.agg(zero("n").alias("n_kmers"), zero(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits"))).alias("n_codes"), F.min("least").alias("least"), F.max("most").alias("most"))


def pilot_mphf(spark, d):
    kmers = staged(distinct_kmers(spark, d), "kmers", "zstd")
    return _codes_of(kmers, perfect_hash.by_pilots(kmers, distinct=True))


def cascade_mphf(spark, d):
    kmers = staged(distinct_kmers(spark, d), "kmers", "zstd")
    return _codes_of(kmers, perfect_hash.by_cascade(kmers, distinct=True))


def index_order(spark, d):
    """Ranks ascend with the minimizers, and places in the unpartitioned layout too."""
    made = index(spark, d, "unpartitioned").minimizers.withColumn("ends", F.col("base") - F.col("p1") + F.col("size"))
    ranks, ends = (order_violations(made, ["minimizer"], c).select(F.lit(c).alias("what"), "*") for c in ("mm_rank", "ends"))
    return ranks.unionByName(ends).unionByName(order_violations(made, ["mm_rank"], "size").select(F.lit("size").alias("what"), "*"))


def code_population(spark, d):
    """Codes of the k-mers of `benchmark` among those of the index: how many are out of its bounds, and how many of its codes they leave out."""
    return validation.population(few_looked_up(spark, d), index(spark, d).n_kmers)


def index_roundtrip(spark, d):
    path = new_folder(spark, "index")
    index(spark, d).save(path)
    return lookup.by_super_kmer(contigs(spark, d), Index.load(spark, path))


def index_tables(spark, d):
    """The index as tables bucketed by minimizer and k-mer."""
    name = f"index_{uuid.uuid4().hex}"
    index(spark, d).save_tables(name)
    return lookup.by_super_kmer(contigs(spark, d), Index.load_tables(spark, name), tile=TILE)


def kmer_filter(spark, d):
    """Of the k-mers of `documents`, whether the filter of the index's k-mers lets all pass."""
    # each k-mer is asked once, with the number of its places
    kmers = staged(minimizers.counts(packed_runs(spark, d), K), "kmers", "zstd")
    n = kmers.count()
    made = membership.judged(kmers, "kmer", membership.built(kmers, "kmer", n), n, "passes")
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return made.agg(zero("n").alias("n_kmers"), zero(F.when(~F.col("passes"), F.col("n"))).alias("n_lost"))


def fasta_roundtrip(spark, d):
    path = new_folder(spark, "fasta")
    files.write_fasta(contigs(spark, d), path, "gzip")
    return files.read_fasta(spark, path).select("name", "seq")


def fastq_roundtrip(spark, d):
    """The segments as FASTQ files, of which plain ones are read in ranges, and back."""
    path = new_folder(spark, "fastq")
    reads = sequences.segments(contigs(spark, d), K).select(F.concat_ws(":", "seq_id", "seg_id").alias("name"), F.col("seg").alias("seq"), "seq_id")
    files.write_fastq(reads, path, quality="@")
    return files.read_fastq(spark, path, 1 << 20).select("name", "seq")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        segments, kmer_explode, kmer_count, kmer_distinct_count, revcomp, canonical_kmers, packed_mmers, kmer_minimizer, super_kmers, super_kmer_histogram,
        minimizer_classify, colliding_minimizers, colliding_kmers, class_counts, minimizer_rank, fallback_rank, rank_in_class, index_partitioned, index_unpartitioned,
        lookup_streaming_p, lookup_streaming_u, lookup_random_p, lookup_random_u, lookup_count, lookup_count_random, lookup_alien, lookup_strict, lookup_stream,
        check_index, check_index_unpartitioned, build_stats, space_model, locality, whole_set_mphf, baseline_lookup, bbhash, index_roundtrip, fasta_roundtrip,
        canonical_kmers_63, lookup_63, pilot_mphf, cascade_mphf, index_order, code_population, fastq_roundtrip, lookup_spread,
        locality_random, index_tables, kmer_filter,
    )
}


# The same in SQL.

LETTERS = "abcdefghijklmnopqrstuvwxyz"
TWO64, SHIFT = 1 << 64, 1 << dna.MURMUR_SHIFT
FACTOR = f"{dna.MURMUR_FACTOR}::UHUGEINT"
START = f"{OPTIONS.seed ^ (8 * dna.MURMUR_FACTOR % TWO64)}::UHUGEINT"


def _times(x: str) -> str:
    return f"(({x}) * {FACTOR}) % {TWO64}::UHUGEINT"


def _fold(x: str) -> str:
    return f"xor({x}, {x} // {SHIFT}::UHUGEINT)"


def _sequences(table: str = "documents", key: str = "doc_id", k: int = K) -> str:
    bases = "".join("ACGT"[i % 4] for i in range(26))
    return f"""contigs AS (SELECT {key} AS seq_id, translate(regexp_replace(lower(text), '[ \\n]', '', 'g'), '{LETTERS}', '{bases}') AS seq FROM {table}),
parts AS (SELECT seq_id, unnest(p) AS seg, unnest(range(len(p))) AS seg_id FROM (SELECT seq_id, regexp_split_to_array(seq, '[^ACGT]+') AS p FROM contigs)),
segs AS MATERIALIZED (SELECT * FROM parts WHERE length(seg) >= {k}),
kms AS (SELECT seq_id, seg_id, pos, substr(seg, pos + 1, {k}) AS kmer FROM (SELECT *, unnest(range(length(seg) - {k - 1})) AS pos FROM segs))"""


def _runs(prefix: str = "", k: int = K, m: int = M) -> str:
    p = prefix
    return f"""{p}mms AS MATERIALIZED (SELECT seq_id, seg_id, i, substr(seg, i + 1, {m}) AS mm FROM (SELECT *, unnest(range(length(seg) - {m - 1})) AS i FROM {p}segs)),
{p}c AS (SELECT mm, list_reduce(list_transform(string_split(translate(mm, 'ACGT', '0123'), ''), lambda x: x::BIGINT), lambda a, b: a * 4 + b)::UHUGEINT AS code FROM (SELECT DISTINCT mm FROM {p}mms)),
{p}h1 AS (SELECT mm, {_times("code")} AS x FROM {p}c), {p}h2 AS (SELECT mm, {_fold("x")} AS x FROM {p}h1), {p}h3 AS (SELECT mm, {_times("x")} AS x FROM {p}h2),
{p}h4 AS (SELECT mm, {_times(f"xor({START}, x)")} AS x FROM {p}h3), {p}h5 AS (SELECT mm, {_fold("x")} AS x FROM {p}h4), {p}h6 AS (SELECT mm, {_times("x")} AS x FROM {p}h5),
{p}hashed AS MATERIALIZED (SELECT mm, ({_fold("x")})::UBIGINT AS h FROM {p}h6),
{p}argmin AS (SELECT seq_id, seg_id, i AS pos, min({{'h': h, 'i': i}}) OVER (PARTITION BY seq_id, seg_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - m} FOLLOWING) AS a FROM {p}mms JOIN {p}hashed USING (mm)),
{p}each AS MATERIALIZED (SELECT s.seq_id, s.seg_id, pos, a.i AS ap, substr(seg, pos + 1, {k}) AS kmer, substr(seg, a.i + 1, {m}) AS minimizer, (a.i - pos)::BIGINT AS p FROM {p}argmin x JOIN {p}segs s ON s.seq_id = x.seq_id AND s.seg_id = x.seg_id WHERE pos <= length(seg) - {k}),
{p}sk AS MATERIALIZED (SELECT seq_id, seg_id, min(pos) AS start, minimizer, (ap - min(pos))::INTEGER AS p1, count(*)::INTEGER AS size FROM {p}each GROUP BY seq_id, seg_id, ap, minimizer)"""


def _classes(k: int = K, m: int = M) -> str:
    return f"""owners AS (SELECT minimizer, count(*) AS n, CASE WHEN count(*) = 1 THEN min(p1) END AS p1, CASE WHEN count(*) = 1 THEN min(size) END AS size FROM sk GROUP BY minimizer),
mins AS MATERIALIZED (SELECT *, CASE WHEN n > 1 THEN 'COLLISION' WHEN p1 = {k - m} AND size = {k - m + 1} THEN 'MAXIMAL' WHEN p1 = {k - m} THEN 'RIGHT' WHEN p1 = size - 1 THEN 'LEFT' ELSE 'NONE' END AS cls,
  row_number() OVER (ORDER BY minimizer) - 1 AS mm_rank FROM owners),
fb AS MATERIALIZED (SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS fb_rank FROM (SELECT DISTINCT kmer FROM each JOIN mins USING (minimizer) WHERE n > 1))"""


def _partitioned(k: int = K, m: int = M) -> str:
    return f"""laid AS (SELECT *, coalesce(sum(coalesce(size, 0)) OVER (ORDER BY list_position(['MAXIMAL', 'LEFT', 'RIGHT', 'NONE', 'COLLISION'], cls), mm_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ps FROM mins),
idx AS MATERIALIZED (SELECT minimizer, mm_rank, cls, p1, size, CASE WHEN cls IN ('MAXIMAL', 'LEFT') THEN ps WHEN cls = 'RIGHT' THEN ps + {k - m} WHEN cls = 'NONE' THEN ps + p1 END AS base,
  CASE WHEN cls IN ('MAXIMAL', 'LEFT') THEN 1 WHEN cls <> 'COLLISION' THEN -1 END::INTEGER AS sign FROM laid)"""


CLASSES, PARTITIONED = _classes(), _partitioned()
CLASSES_63, PARTITIONED_63 = _classes(LONG.k, LONG.m), _partitioned(LONG.k, LONG.m)
UNPARTITIONED = """laid AS (SELECT *, coalesce(sum(coalesce(size, 0)) OVER (ORDER BY mm_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ps FROM mins),
idx AS MATERIALIZED (SELECT minimizer, mm_rank, cls, CASE WHEN n = 1 THEN ps + p1 END AS base, CASE WHEN n = 1 THEN -1 END::INTEGER AS sign FROM laid)"""


def _codes(each: str = "each") -> str:
    return f"codes AS (SELECT seq_id, seg_id, pos, kmer, coalesce(base + sign * p, fb_rank + (SELECT coalesce(sum(size), 0) FROM mins))::BIGINT AS hval FROM {each} LEFT JOIN idx USING (minimizer) LEFT JOIN fb USING (kmer))"


def _sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


SEQS, RUNS = _sequences(), _runs()
ALIENS = _sequences("benchmark", "item_id").replace("contigs", "q_contigs").replace("parts", "q_parts").replace("segs", "q_segs").replace("kms", "q_kms")
CODES = "SELECT seq_id, seg_id, pos, hval FROM codes"
SOUND = """SELECT (SELECT count(*) FROM codes WHERE hval IS NULL OR hval < 0 OR hval >= d) AS out_of_bounds, (SELECT count(*) FROM (SELECT hval FROM codes GROUP BY hval HAVING count(DISTINCT kmer) > 1)) AS duplicate_codes,
  d - (SELECT count(DISTINCT hval) FROM codes WHERE hval BETWEEN 0 AND d - 1) AS uncovered_codes, (SELECT count(*) FROM (SELECT seq_id, seg_id, pos FROM kms EXCEPT SELECT seq_id, seg_id, pos FROM codes)) AS stream_differs,
  (SELECT count(*) FROM (SELECT kmer FROM kms EXCEPT SELECT kmer FROM codes)) AS missing_kmers FROM (SELECT count(DISTINCT kmer) AS d FROM kms)"""


def _bbhash() -> str:
    ctes = ["l0 AS MATERIALIZED (SELECT DISTINCT kmer FROM kms)"]
    for i in range(LEVELS):
        ctes.append(f"t{i} AS (SELECT kmer, ('0x' || substr(md5('{i}:' || kmer), 1, 15))::BIGINT % greatest(1, floor({GAMMA} * (SELECT count(*) FROM l{i}))::BIGINT) AS slot FROM l{i})")
        ctes.append(f"a{i} AS MATERIALIZED (SELECT min(kmer) AS kmer, {i} AS level, slot FROM t{i} GROUP BY slot HAVING count(*) = 1)")
        ctes.append(f"l{i + 1} AS MATERIALIZED (SELECT kmer FROM l{i} ANTI JOIN a{i} USING (kmer))")
    every = " UNION ALL ".join(f"SELECT kmer, level, slot FROM a{i}" for i in range(LEVELS)) + f" UNION ALL SELECT kmer, {LEVELS}, 0 FROM l{LEVELS}"
    return _sql(SEQS, *ctes, select=f"SELECT kmer, level::INTEGER AS level, row_number() OVER (ORDER BY level, slot, kmer) - 1 AS hval FROM ({every})")


def _elias_fano(n: str, u: str) -> str:
    low = f"(CASE WHEN {u} >= {n} + 1 THEN floor(log2({u} / ({n} + 1)::DOUBLE)) ELSE 0 END)"
    return f"({n} + 1) * {low} + ({n} + 1) + floor({u} / pow(2, {low})) + 1"


_MINIMAL = _sql(SEQS, select="SELECT count(DISTINCT kmer) AS n_kmers, count(DISTINCT kmer) AS n_codes, CASE WHEN count(*) > 0 THEN 0::BIGINT END AS least, CASE WHEN count(*) > 0 THEN count(DISTINCT kmer) - 1 END AS most FROM kms")
_LOOKUP = _sql(SEQS, RUNS, CLASSES, PARTITIONED, _codes(), select=CODES)
_LOOKUP_U = _sql(SEQS, RUNS, CLASSES, UNPARTITIONED, _codes(), select=CODES)
_LOCALITY = _sql(SEQS, RUNS, CLASSES, PARTITIONED, _codes(), select="SELECT count(*) AS n_pairs, sum(CASE WHEN abs(next - hval) = 1 THEN 1 ELSE 0 END)::BIGINT AS n_adjacent FROM (SELECT hval, lead(hval) OVER (PARTITION BY seq_id, seg_id ORDER BY pos) AS next FROM codes) WHERE next IS NOT NULL")
_COUNT = _sql(SEQS, RUNS, CLASSES, PARTITIONED, _codes(), select="SELECT count(*) AS n_kmers, count(hval) AS n_found FROM codes")

SQL: dict[str, str] = {
    "segments": _sql(SEQS, select="SELECT seq_id, seg_id, seg FROM segs"),
    "kmer_explode": _sql(SEQS, select="SELECT * FROM kms"),
    "kmer_count": _sql(SEQS, select="SELECT seq_id, count(*) AS n_kmers FROM kms GROUP BY seq_id"),
    "kmer_distinct_count": _sql(SEQS, select="SELECT count(DISTINCT kmer) AS n_distinct FROM kms"),
    "revcomp": _sql(SEQS, select="SELECT seq_id, seg_id, reverse(translate(seg, 'ACGT', 'TGCA')) AS revcomp FROM segs"),
    "canonical_kmers": _sql(SEQS, select="SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM kms GROUP BY 1"),
    "packed_mmers": _sql(SEQS, RUNS, select="SELECT DISTINCT minimizer, code::BIGINT AS packed FROM sk JOIN c ON mm = minimizer"),
    "kmer_minimizer": _sql(SEQS, RUNS, select="SELECT seq_id, seg_id, pos, minimizer, p::INTEGER AS p FROM each"),
    "super_kmers": _sql(SEQS, RUNS, select="SELECT seq_id, seg_id, start, minimizer, p1, size FROM sk"),
    "super_kmer_histogram": _sql(SEQS, RUNS, select="SELECT p1, size, count(*) AS n FROM sk GROUP BY p1, size"),
    "minimizer_classify": _sql(SEQS, RUNS, CLASSES, select="SELECT minimizer, n, p1, size, cls FROM mins"),
    "colliding_minimizers": _sql(SEQS, RUNS, CLASSES, select="SELECT minimizer, n FROM mins WHERE n > 1"),
    "colliding_kmers": _sql(SEQS, RUNS, CLASSES, select="SELECT kmer FROM fb"),
    "class_counts": _sql(SEQS, RUNS, CLASSES, select="""SELECT cls, count(*) AS n_minimizers, 100.0::DOUBLE * count(*) / CASE WHEN cls = 'COLLISION' THEN (SELECT count(*) FROM mins) ELSE (SELECT count(*) FROM mins WHERE n = 1) END AS percent FROM mins GROUP BY cls"""),
    "minimizer_rank": _sql(SEQS, RUNS, CLASSES, select="SELECT minimizer, mm_rank FROM mins"),
    "fallback_rank": _sql(SEQS, RUNS, CLASSES, select="SELECT kmer, fb_rank FROM fb"),
    "rank_in_class": _sql(SEQS, RUNS, CLASSES, select="SELECT minimizer, cls, row_number() OVER (PARTITION BY cls ORDER BY minimizer) - 1 AS rank FROM mins"),
    "index_partitioned": _sql(SEQS, RUNS, CLASSES, PARTITIONED, select="SELECT * FROM idx"),
    "index_unpartitioned": _sql(SEQS, RUNS, CLASSES, UNPARTITIONED, select="SELECT minimizer, mm_rank, base, sign FROM idx"),
    "lookup_streaming_p": _LOOKUP, "lookup_spread": _LOOKUP, "index_tables": _LOOKUP, "lookup_random_p": _LOOKUP, "lookup_stream": _LOOKUP, "index_roundtrip": _LOOKUP,
    "lookup_streaming_u": _LOOKUP_U, "lookup_random_u": _LOOKUP_U,
    "lookup_count": _COUNT, "lookup_count_random": _COUNT,
    "lookup_alien": _sql(SEQS, RUNS, CLASSES, PARTITIONED, ALIENS, _runs("q_"), _codes("q_each"), select=CODES),
    "lookup_strict": _sql(SEQS, RUNS, CLASSES, PARTITIONED, ALIENS, _runs("q_"), _codes("q_each"), select="SELECT seq_id, seg_id, pos, CASE WHEN kmer IN (SELECT kmer FROM each) THEN hval END AS hval FROM codes"),
    "check_index": _sql(SEQS, RUNS, CLASSES, PARTITIONED, _codes(), select=SOUND), "check_index_unpartitioned": _sql(SEQS, RUNS, CLASSES, UNPARTITIONED, _codes(), select=SOUND),
    "build_stats": _sql(SEQS, RUNS, CLASSES, select=f"""SELECT (SELECT count(*) FROM contigs) AS n_contigs, (SELECT count(*) FROM each) AS n_kmers, (SELECT count(*) FROM sk) AS n_super_kmers, (SELECT count(*) FROM mins) AS n_minimizers,
  (SELECT sum(n) FROM mins WHERE n > 1)::DOUBLE / (SELECT count(*) FROM mins) AS frac_nonunique, 2.0::DOUBLE / {W + 1} AS eps_theory, (SELECT count(*) FROM sk)::DOUBLE / (SELECT count(*) FROM each) AS eps_true,
  ((SELECT count(*) FROM contigs) - 1)::DOUBLE / (SELECT count(*) FROM each) AS alpha"""),
    "space_model": _sql(SEQS, RUNS, CLASSES, "o AS (SELECT count(*) AS d, sum(CASE WHEN cls <> 'MAXIMAL' THEN 1 ELSE 0 END + CASE WHEN cls = 'NONE' THEN 1 ELSE 0 END)::BIGINT AS l, (sum(CASE WHEN cls NOT IN ('MAXIMAL', 'COLLISION') THEN size ELSE 0 END) + sum(CASE WHEN cls = 'NONE' THEN p1 ELSE 0 END))::BIGINT AS u, (SELECT count(*) FROM fb) AS f, sum(size)::BIGINT AS s FROM mins)",
        select=f"""SELECT component, bits::DOUBLE AS bits, bits::DOUBLE / (SELECT s + f FROM o) AS bits_per_kmer FROM (SELECT 'minimizer_order' AS component, d * {OPTIONS.bits_per_key}::DOUBLE AS bits FROM o
  UNION ALL SELECT 'classes', d * 2.5::DOUBLE FROM o UNION ALL SELECT 'sizes_and_positions', ({_elias_fano("l", "u")})::DOUBLE FROM o UNION ALL SELECT 'fallback', f * {OPTIONS.bits_per_key}::DOUBLE FROM o)"""),
    "locality": _LOCALITY, "locality_random": _LOCALITY,
    "kmer_filter": _sql(SEQS, select="SELECT count(*) AS n_kmers, 0::BIGINT AS n_lost FROM kms"),
    "whole_set_mphf": _sql(SEQS, select="SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS hval FROM (SELECT DISTINCT kmer FROM kms)"),
    "baseline_lookup": _sql(SEQS, ALIENS, select="SELECT q.seq_id, q.seg_id, q.pos, r.hval FROM q_kms q LEFT JOIN (SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS hval FROM (SELECT DISTINCT kmer FROM kms)) r USING (kmer)"),
    "bbhash": _bbhash(),
    "canonical_kmers_63": _sql(_sequences(k=LONG.k), select="SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM kms GROUP BY 1"),
    "lookup_63": _sql(_sequences(k=LONG.k), _runs(k=LONG.k, m=LONG.m), CLASSES_63, PARTITIONED_63, _codes(), select=CODES),
    "pilot_mphf": _MINIMAL, "cascade_mphf": _MINIMAL,
    "index_order": _sql(SEQS, RUNS, CLASSES, "laid AS (SELECT *, sum(coalesce(size, 0)) OVER (ORDER BY minimizer) AS ends FROM mins)", "v AS (SELECT 'mm_rank' AS what, minimizer AS o, mm_rank AS v FROM laid UNION ALL SELECT 'ends', minimizer, ends FROM laid WHERE n = 1 UNION ALL SELECT 'size', minimizer, size FROM laid WHERE n = 1)",
        "p AS (SELECT what, v, lag(v) OVER (PARTITION BY what ORDER BY o) AS last FROM v)", select="SELECT what, count(*) AS n, count(*) FILTER (WHERE v < last) AS n_descents, count(*) FILTER (WHERE v = last) AS n_repeats FROM p GROUP BY what"),
    "code_population": _sql(SEQS, RUNS, CLASSES, PARTITIONED, ALIENS, _runs("q_"), _codes("q_each"), select="""SELECT count(*) AS n_codes, count(*) FILTER (WHERE hval IS NULL OR hval < 0 OR hval >= d) AS out_of_bounds, any_value(d) - count(DISTINCT CASE WHEN hval BETWEEN 0 AND d - 1 THEN hval END) AS uncovered_codes FROM codes, (SELECT count(DISTINCT kmer) AS d FROM kms)"""),
    "fastq_roundtrip": _sql(SEQS, select="SELECT seq_id || ':' || seg_id AS name, seg AS seq FROM segs"),
    "fasta_roundtrip": _sql(SEQS, select="SELECT seq_id::VARCHAR AS name, seq FROM contigs"),
}
