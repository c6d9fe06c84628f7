"""Command line: python -m kmerloom build | query | baseline | baseline-query."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import baselines, lookup, sequences, statistics, validation
from kmerloom.operators.index import Index, build
from kmerloom.plans.config import LAYOUTS, OptionError, Options
from kmerloom.sources.sequences import read_sequences, write_statistics

BAD_INPUT, BAD_OPTION = 2, 3


def session() -> SparkSession:
    spark = SparkSession.builder.appName("kmerloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def say(**row) -> None:
    print(json.dumps(row))


def timed(df: DataFrame) -> tuple[int, float]:
    """Rows of `df` and the seconds that making them all takes."""
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    seconds = time.time() - began
    return df.count(), seconds


def run_build(args: argparse.Namespace) -> int:
    try:
        options = Options(args.k, args.m, args.seed, args.layout, args.hasher, args.canonical)
    except OptionError as error:
        print(error, file=sys.stderr)
        return BAD_OPTION
    spark = session()
    given = read_sequences(spark, args.input)
    began = time.time()
    index = build(given, options, args.tile)
    figures = statistics.build_statistics(given, sequences.packed_super_kmers(given, options, args.tile), options)
    row = figures.first().asDict()
    row["bits_per_kmer"] = sum(r.bits_per_kmer for r in statistics.space_model(index).collect())
    say(input=args.input, k=args.k, m=args.m, layout=args.layout, seconds=round(time.time() - began, 3), fallback_share=statistics.fallback_share(index), **row)
    if args.csv:
        write_statistics(figures.select(F.lit(args.input).alias("input"), F.lit(args.k).alias("k"), F.lit(args.m).alias("m"), "*", F.lit(row["bits_per_kmer"]).alias("bits_per_kmer")), args.csv)
    if args.output:
        index.save(args.output)
        index = Index.load(spark, args.output)
    if args.verbose:
        for r in statistics.parameters(index).collect() + statistics.class_counts(index).collect() + statistics.space_model(index).collect():
            say(**r.asDict())
    if args.check:
        found = validation.report(given, index, args.tile).first().asDict()
        say(ok=not sum(found.values()), **found)
        return int(bool(sum(found.values())))
    return 0


def run_query(args: argparse.Namespace) -> int:
    spark = session()
    try:
        index, given = Index.load(spark, args.index), read_sequences(spark, args.query)
    except Exception as error:  # a path that can't be read
        print(str(error).splitlines()[0], file=sys.stderr)
        return BAD_INPUT
    began = time.time()
    codes = lookup.by_super_kmer(given, index, tile=args.tile)
    made = time.time() - began  # the runs are written when the lookup is asked for
    n, stepped = timed(codes)
    _, single = timed(lookup.by_kmer(given, index, args.tile))
    figures = {"query": args.query, "index": args.index, "n_kmers": n, "ns_per_kmer_streaming": 1e9 * (made + stepped) / max(1, n), "ns_per_kmer_random": 1e9 * single / max(1, n)}
    say(**figures)
    if args.csv:
        write_statistics(spark.createDataFrame([figures]).select(*figures), args.csv)
    if args.output:
        codes.write.mode("overwrite").parquet(args.output)
    return 0


def run_baseline(args: argparse.Namespace) -> int:
    spark = session()
    kmers = sequences.kmers(read_sequences(spark, args.input), args.k)
    wrong = 0
    for name, make in (("rank", lambda: baselines.by_rank(kmers)), ("levels", lambda: baselines.by_levels(kmers, args.gamma))):
        if args.method not in (name, "both"):
            continue
        began = time.time()
        made = make()
        n, distinct, top = made.selectExpr("count(*)", "count(distinct hval)", "coalesce(max(hval) + 1, 0)").first()
        figures = {"baseline": name, "k": args.k, "n_kmers": n, "seconds": round(time.time() - began, 3), "ok": n == distinct == top}
        wrong += not figures["ok"]
        say(**figures)
        if args.csv:
            write_statistics(spark.createDataFrame([figures]).select(*figures), args.csv)
        if args.output:
            made.select("kmer", "hval", F.lit(args.k).alias("k")).write.mode("overwrite").parquet(f"{args.output}/{name}")
    return int(bool(args.check and wrong))


def run_baseline_query(args: argparse.Namespace) -> int:
    spark = session()
    try:
        table, given = spark.read.parquet(args.index), read_sequences(spark, args.query)
    except Exception as error:  # a path that can't be read
        print(str(error).splitlines()[0], file=sys.stderr)
        return BAD_INPUT
    first = table.select("k").first()
    n, seconds = timed(baselines.looked_up(sequences.kmers(given, first["k"]), table)) if first else (0, 0.0)
    figures = {"query": args.query, "baseline": args.index, "n_kmers": n, "ns_per_kmer": 1e9 * seconds / max(1, n)}
    say(**figures)
    if args.csv:
        write_statistics(spark.createDataFrame([figures]).select(*figures), args.csv)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kmerloom")
    tools = parser.add_subparsers(required=True)
    b = tools.add_parser("build", help="build an index of the k-mers of a FASTA or FASTQ file")
    b.add_argument("-i", "--input", required=True)
    b.add_argument("-k", type=int, required=True)
    b.add_argument("-m", type=int, required=True)
    b.add_argument("-s", "--seed", type=int, default=Options.seed)
    b.add_argument("-o", "--output")
    b.add_argument("--csv", help="a folder of CSV files that the figures are added to")
    b.add_argument("--layout", choices=LAYOUTS, default=LAYOUTS[0])
    b.add_argument("--hasher", default=Options.hasher)
    b.add_argument("--canonical", action="store_true")
    b.add_argument("--tile", type=int, help="cut sequences into tiles of so many k-mers, to spread very long ones")
    b.add_argument("--check", action="store_true")
    b.add_argument("--verbose", action="store_true")
    b.set_defaults(run=run_build)
    q = tools.add_parser("query", help="look up the k-mers of a FASTA or FASTQ file")
    q.add_argument("-i", "--index", required=True)
    q.add_argument("-q", "--query", required=True)
    q.add_argument("-o", "--output")
    q.add_argument("--tile", type=int, help="cut sequences into tiles of so many k-mers")
    q.add_argument("--csv", help="a folder of CSV files that the figures are added to")
    q.set_defaults(run=run_query)
    w = tools.add_parser("baseline", help="hash the whole k-mer set of a file by rank and by levels")
    w.add_argument("-i", "--input", required=True)
    w.add_argument("-k", type=int, required=True)
    w.add_argument("-g", "--gamma", type=float, default=1.0)
    w.add_argument("--method", choices=["rank", "levels", "both"], default="both")
    w.add_argument("-o", "--output", help="a folder to save the tables in, by method")
    w.add_argument("--check", action="store_true", help="fail if codes aren't those from 0 on, each once")
    w.add_argument("--csv", help="a folder of CSV files that the figures are added to")
    w.set_defaults(run=run_baseline)
    x = tools.add_parser("baseline-query", help="look up the k-mers of a file in a saved baseline")
    x.add_argument("-i", "--index", required=True, help="a folder that baseline -o wrote for a method")
    x.add_argument("-q", "--query", required=True)
    x.add_argument("--csv", help="a folder of CSV files that the figures are added to")
    x.set_defaults(run=run_baseline_query)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
