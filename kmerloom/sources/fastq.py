"""FASTQ as a Spark data source: all files in one scan, plain files in byte ranges that begin at records.

A record of four lines can be told from the middle of a file: a line that begins with '@' and whose next but one begins with '+' is a
header, since a quality line that begins with '@' has a header and then bases after it. So a range of a plain file begins
at the first such line in it, ends with the last record that begins in it, and looks at the one after that. Should a later
record have more lines, so that the next range would pass it over, the range before fails; it is never read wrongly. Files that are compressed,
smaller than a range, or whose head has records of more lines are read whole by one task.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "kmerloom_fastq"
SCHEMA = "name string, seq string"
#: Bytes of a range, bytes of a file's head that tell its form, and records given out at a time.
RANGE, HEAD, RECORDS = 64 << 20, 1 << 20, 4096


def opened(path: str) -> io.BufferedReader:
    """A file by its URI."""
    from pyarrow import fs

    path = path.replace("s3a://", "s3://", 1)
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    system, inside = fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(inside), 1 << 20)


def _line(file: io.BufferedReader) -> str | None:
    """The next line without its end, None at the end of the file."""
    line = file.readline()
    return line.decode("utf-8").rstrip("\r\n") if line else None


def _name(header: str) -> str:
    return (header[1:].split() or [""])[0]


def records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(name, seq) of records of any number of lines: header, sequence lines, plus line, as many quality characters."""
    name, seq, quality = None, [], -1  # quality: characters still to come, -1 before the plus line
    for line in lines:
        if quality > 0:
            quality -= len(line)
            if quality < 0:
                raise ValueError(f"FASTQ record {name!r} has more quality characters than bases")
        elif name is not None:
            if line.startswith("+"):
                quality = sum(map(len, seq))
            else:
                seq.append(line.strip())
        elif line.startswith("@"):
            name, seq, quality = _name(line), [], -1
        elif line.strip():
            raise ValueError(f"a FASTQ record begins with {line[:40]!r}")
        if quality == 0:
            yield name, "".join(seq)
            name, quality = None, -1
    if name is not None:
        raise ValueError(f"FASTQ record {name!r} ends too early")


def whole(path: str) -> Iterator[tuple[str, str]]:
    with opened(path) as raw, gzip.open(raw) if path.endswith(".gz") else raw as file:
        yield from records(iter(lambda: _line(file), None))


def four_lines(head: bytes) -> bool:
    """Whether the whole records in the head of a file have four lines each."""
    lines = [x for x in head.decode("utf-8", "replace").replace("\r", "").split("\n")[:-1]]
    at = 0
    while at + 4 <= len(lines):
        if not lines[at].strip():
            at += 1
            continue
        if not (lines[at].startswith("@") and lines[at + 2].startswith("+") and len(lines[at + 1].strip()) == len(lines[at + 3])):
            return False
        at += 4
    return True


def ranged(path: str, start: int, end: int) -> Iterator[tuple[str, str]]:
    """The records of four lines that begin in [start, end) of a file."""
    with opened(path) as file:
        if start:
            file.seek(start - 1)
            file.readline()
            while True:  # to the first header
                at = file.tell()
                ahead = [_line(file) for _ in range(3)]
                if ahead[0] is None or at >= end:
                    return
                if ahead[0].startswith("@") and (ahead[2] or "").startswith("+"):
                    file.seek(at)
                    break
                file.seek(at)
                file.readline()
        while True:
            at = file.tell()
            header = _line(file)
            if header is None:
                return
            if not header.strip():
                continue
            seq, plus, quality = (_line(file) for _ in range(3))
            if not header.startswith("@"):
                raise ValueError(f"a FASTQ record begins with {header[:40]!r}")
            if plus is None or not plus.startswith("+"):
                raise ValueError(f"FASTQ record {_name(header)!r} isn't of four lines, as those at the head of {path} are")
            if len(seq.strip()) != len(quality or ""):
                raise ValueError(f"FASTQ record {_name(header)!r} has {len(quality or '')} quality characters for {len(seq.strip())} bases")
            if at >= end:
                return  # the next range begins with this record, which had to be seen to be of four lines
            yield _name(header), seq.strip()


@dataclass
class Span(InputPartition):
    """Files that one task reads: (path, start, end), or -1 for the whole."""

    spans: list[tuple[str, int, int]]


class FastqReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], size: int):
        self.files, self.size = files, size

    def partitions(self) -> list[Span]:
        """Ranges of large plain files, and small files together up to the size of a range."""
        out, few, held = [], [], 0
        for path, length in self.files:
            if length > self.size and not path.endswith(".gz"):
                with opened(path) as file:
                    head = file.read(HEAD)
                if four_lines(head):
                    out += [Span([(path, s, min(s + self.size, length))]) for s in range(0, length, self.size)]
                    continue
            if few and held + length > self.size:
                out, few, held = [*out, Span(few)], [], 0
            few, held = [*few, (path, 0, -1)], held + length
        return [*out, Span(few)] if few else out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        names, seqs, held = [], [], 0
        for path, start, end in partition.spans:
            for name, seq in whole(path) if end < 0 else ranged(path, start, end):
                names.append(name)
                seqs.append(seq)
                held += len(seq)
                if len(names) >= RECORDS or held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.string())], names=["name", "seq"])
                    names, seqs, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.string())], names=["name", "seq"])


class FastqSource(DataSource):
    """Options: `files`, a JSON list of [path, length]; `range`, the bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastqReader:
        return FastqReader([tuple(x) for x in json.loads(self.options["files"])], int(self.options.get("range", RANGE)))
