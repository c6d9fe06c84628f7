import gzip

import pytest

from kmerloom.operators import lookup
from kmerloom.operators.index import build
from kmerloom.plans.config import Options
from kmerloom.sources import fastq
from kmerloom.sources import sequences as files
from kmerloom.streaming import lookup as streaming


def rows(df):
    return sorted((r.name, r.seq) for r in df.collect())


def test_fasta(spark, tmp_path):
    text = ">a first > one\nACGT\nacgt\n\n>b\r\nGG\r\nTT\r\n>c\n>d\nAAA"
    (tmp_path / "x.fa").write_bytes(text.encode())
    want = [("a", "ACGTacgt"), ("b", "GGTT"), ("c", ""), ("d", "AAA")]
    got = files.read_sequences(spark, str(tmp_path / "x.fa"))
    assert rows(got) == want and len({r.seq_id for r in got.collect()}) == 4
    (tmp_path / "x.fa.gz").write_bytes(gzip.compress(text.encode()))
    assert rows(files.read_sequences(spark, str(tmp_path / "x.fa.gz"))) == want


def test_fasta_in_many_splits(spark, tmp_path):
    want = [(f"s{i}", "ACGT" * (i % 50) + "A") for i in range(2000)]
    (tmp_path / "y.fa").write_text("".join(f">{n}\n{s}\n" for n, s in want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = files.read_fasta(spark, str(tmp_path / "y.fa"))
        assert got.rdd.getNumPartitions() > 5 and rows(got) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fastq_with_marks_in_qualities(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@r1 x\nACGT\n+\n@@+I\n@r2\nGGG\n+\n>+@\n@r3\nTT\n+\nII\n")
    assert rows(files.read_sequences(spark, str(tmp_path / "x.fastq"))) == [("r1", "ACGT"), ("r2", "GGG"), ("r3", "TT")]


def test_fastq_forms(spark, tmp_path):
    """A named plus line, CRLF, sequences and qualities of several lines, blank lines between records, no line end at the end; gzip; several files."""
    given = "@r1 first\r\nACGT\r\n+r1 first\r\nIIII\r\n@r2\nAC\nGTT\n+\n@+\n+@I\n\n@r3\n\n+\n\n@r4\nGG\n+r4\n@@"
    want = [("r1", "ACGT"), ("r2", "ACGTT"), ("r3", ""), ("r4", "GG")]
    (tmp_path / "x.fastq").write_bytes(given.encode())
    assert rows(files.read_sequences(spark, str(tmp_path / "x.fastq"))) == want
    folder = tmp_path / "more"
    folder.mkdir()
    (folder / "a.fq.gz").write_bytes(gzip.compress(given.encode()))
    (folder / "b.fq").write_text("".join(f"@s{i}\n{'ACGT' * (i % 9 + 1)}\n+\n{'@+>I' * (i % 9 + 1)}\n" for i in range(3000)))
    got = files.read_fastq(spark, str(folder))
    assert rows(got) == sorted(want + [(f"s{i}", "ACGT" * (i % 9 + 1)) for i in range(3000)]) and len({r.seq_id for r in got.collect()}) == 3004


@pytest.mark.parametrize("broken", ["@r1\nACGT\n+\nII\n", "r1\nACGT\n+\nIIII\n", "@r1\nAC\n+\nIIII\n@r2\nA\n+\nI\n", "@r1\nACGT\n"])
def test_broken_fastq_is_refused(spark, tmp_path, broken):
    (tmp_path / "x.fq").write_text(broken)
    with pytest.raises(Exception, match="FASTQ"):
        files.read_fastq(spark, str(tmp_path / "x.fq")).collect()


def test_round_trip(spark, tmp_path):
    given = spark.createDataFrame([(1, "x", "ACGT"), (2, "y", ""), (3, None, "GG")], "seq_id long, name string, seq string")
    files.write_fasta(given, str(tmp_path / "out"), "gzip")
    assert rows(files.read_fasta(spark, str(tmp_path / "out"))) == [("3", "GG"), ("x", "ACGT"), ("y", "")]


def test_stream(spark, tmp_path):
    given = spark.createDataFrame([(i, "ACGTTGCAAGCTTACGATCGATTTAGC"[i:] + "GATTACA") for i in range(9)], "seq_id long, seq string")
    index = build(given, Options(k=7, m=4))
    given.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.written(source, index, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert set(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == set(map(tuple, lookup.by_super_kmer(given, index).collect()))


def test_fastq_in_ranges(spark, tmp_path):
    """A plain file cut into many ranges, qualities that begin with every mark, gives each record once, wherever ranges begin."""
    want = [(f"s{i}", "ACGT" * (i % 11) + "A") for i in range(700)]
    marks = ["@", "+", "I", "@+", "+@", ">@"]
    text = "".join(f"@{n} more\n{s}\n+{n if i % 3 else ''}\n{(marks[i % 6] * len(s))[: len(s)]}\n" + "\n" * (i % 50 == 7) for i, (n, s) in enumerate(want))
    (tmp_path / "x.fq").write_text(text)
    for size in (97, 1000, 20_011):
        got = files.read_fastq(spark, str(tmp_path / "x.fq"), size)
        assert rows(got) == sorted(want) and got.rdd.getNumPartitions() >= len(text) // size
    crlf = text.replace("\n", "\r\n")
    (tmp_path / "x.fq").write_bytes(crlf.encode())
    assert rows(files.read_fastq(spark, str(tmp_path / "x.fq"), 997)) == sorted(want)


def test_fastq_ranges_refuse_longer_records(spark, tmp_path, monkeypatch):
    """A record of more than four lines behind a head of four-line records fails the read; at the head, the file is read whole."""
    plain = "".join(f"@s{i}\nACGT\n+\n@@@@\n" for i in range(400))
    long_ = "@r\nAC\nGT\n+\n@I\n+I\n"
    for k, place in enumerate((len(plain), 4096, 8000)):
        cut = plain.index("@s", place) if place < len(plain) else place
        (tmp_path / f"{k}.fq").write_text(plain[:cut] + long_ + plain[cut:])
        monkeypatch.setattr(fastq, "HEAD", 1024)
        name, found = f"file://{tmp_path}/{k}.fq", []
        length = len(plain) + len(long_)
        with pytest.raises(ValueError, match="FASTQ"):
            for s in range(0, length, 256):
                found += fastq.ranged(name, s, min(length, s + 256))
        assert all(n.startswith("s") for n, _ in found)
    (tmp_path / "head.fq").write_text(long_ + plain)
    assert len(rows(files.read_fastq(spark, str(tmp_path / "head.fq"), 256))) == 401


def test_many_fastq_files_are_one_scan(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(1000):
        (folder / f"{i}.fq").write_text(f"@r{i}\nACGT\n+\nIIII\n")
    got = files.read_fastq(spark, str(folder))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0 and got.rdd.getNumPartitions() == 1
    assert rows(got) == sorted((f"r{i}", "ACGT") for i in range(1000))


def test_fastq_round_trip(spark, tmp_path):
    given = spark.createDataFrame([(1, "x", "ACGT"), (2, "y", ""), (3, None, "GG")], "seq_id long, name string, seq string")
    for compression in ("none", "gzip"):
        files.write_fastq(given, str(tmp_path / compression), compression)
        assert rows(files.read_fastq(spark, str(tmp_path / compression))) == [("3", "GG"), ("x", "ACGT"), ("y", "")]
