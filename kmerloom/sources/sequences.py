"""FASTA and FASTQ files as DataFrames (seq_id, name, seq), and back.

FASTA records are cut by Spark's own text source with the mark between two records as the line separator, so plain files are
read in splits, from any file system that Spark reads, gzip included. seq_id is unique and the same on every read of
unchanged files; it ascends in a file but isn't dense.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.sources import fastq


def _numbered(df: DataFrame, name: Column, seq: Column) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("seq_id"), name.alias("name"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records that begin with '>' at the start of a line; sequences over several lines are joined."""
    records = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    parts = records.select(F.split(body, "\n", 2).alias("p")).where(F.length(F.trim(F.array_join("p", ""))) > 0)
    return _numbered(parts, F.split(F.col("p")[0], "[ \t]")[0], F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), "[ \t\n]", ""))


def read_fastq(spark: SparkSession, path: str | list[str], range_bytes: int = fastq.RANGE) -> DataFrame:
    """Records of a header '@name', a sequence of one or more lines, '+' with or without the name again, and as many quality characters.

    Line ends may be CRLF. All files are one scan: large plain files of four-line records are read in ranges of `range_bytes`, others
    whole, small ones together; see sources.fastq. A record that breaks these rules fails the job: none is dropped.
    """
    spark.dataSource.register(fastq.FastqSource)
    listed = spark.read.format("binaryFile").load(path).select("path", "length").sort("path")
    files = [(r["path"], r["length"]) for r in listed.collect()]  # names and sizes of files, not their contents
    records = spark.read.format(fastq.NAME).option("files", json.dumps(files)).option("range", range_bytes).load()
    return _numbered(records, F.col("name"), F.col("seq"))


def write_fastq(contigs: DataFrame, path: str, compression: str = "none", quality: str = "I") -> None:
    """A folder of FASTQ files of four lines a record, each base of the one quality. Sequences must be bases: a line that begins with '+' would end them."""
    seq = F.coalesce("seq", F.lit(""))
    lines = contigs.select(F.concat_ws("\n", F.concat(F.lit("@"), F.coalesce("name", F.col("seq_id").cast("string"))), seq, F.lit("+"), F.repeat(F.lit(quality), F.length(seq))).alias("value"))
    lines.write.mode("overwrite").option("compression", compression).text(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """FASTQ if the name says so (.fq, .fastq, .gz after it or not), else FASTA."""
    plain = path.removesuffix(".gz")
    return read_fastq(spark, path) if plain.endswith((".fq", ".fastq")) else read_fasta(spark, path)


def write_fasta(contigs: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of FASTA files, one sequence a line."""
    lines = contigs.select(F.concat(F.lit(">"), F.coalesce("name", F.col("seq_id").cast("string")), F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value"))
    lines.write.mode("overwrite").option("compression", compression).text(path)


def from_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Any text column as sequences."""
    from kmerloom.functions.dna import text_as_dna

    return docs.select(F.col(key).cast("long").alias("seq_id"), F.col(key).cast("string").alias("name"), text_as_dna(F.col(text)).alias("seq"))


def write_statistics(row: DataFrame, path: str) -> None:
    """Rows of figures appended to a folder of CSV files with a header."""
    row.coalesce(1).write.mode("append").option("header", True).csv(path)
