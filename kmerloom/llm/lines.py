"""Taking lines, or parts of lines, out of documents: rows with a key, and the texts rebuilt from what stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = [T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("n_lines", T.LongType()), ("n_removed", T.LongType()), ("chars_removed", T.LongType()),
    ("removed_spans", T.StringType()), ("kept_text", T.StringType()))]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), text_key (a hash that tells apart rows with one doc_id), and the whole row in `row`."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))


def place():
    """Orders lines in the corpus; documents without an id go last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line_no")


def whole_line(line: str) -> list[str]:
    return [line]


def rebuilt(given: DataFrame, gone: DataFrame, counts: Callable[[str], bool], whole_rows: bool = False, units: Callable[[str], list[str]] = whole_line) -> DataFrame:
    """Each row of `given` (from keyed()) without the lines, or `units` of lines, that `gone` (doc_id, text_key, line_no) lists by their number in the text.

    A line without any unit left goes with its line feed.

    Returned: doc_id, n_lines (units that `counts`), n_removed, chars_removed, removed_spans (start:end in code points
    of the original text, without the line feed, comma-joined), kept_text; and `row` if whole_rows.
    """
    listed = gone.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("lines_gone"))
    d, r = given.alias("d"), listed.alias("r")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_key") == F.col("r.text_key"))
    joined = d.join(r, same, "left").select("d.doc_id", "d.text", "r.lines_gone", *(["d.row"] if whole_rows else []))
    schema = T.StructType(RESULT + ([joined.schema["row"]] if whole_rows else []))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lines_gone in zip(batch.column(1), batch.column(2), strict=True):
                out, spans, kept, at, j, n = set(lines_gone.as_py() or ()), [], [], 0, 0, 0
                for line in text.as_py().split("\n"):
                    left = []
                    for unit in units(line):
                        n += counts(unit)
                        if j in out:
                            spans.append((at, at + len(unit)))
                        else:
                            left.append(unit)
                        at += len(unit)
                        j += 1
                    at += 1
                    if left:
                        kept.append("".join(left))
                rows.append((n, len(out), sum(b - a for a, b in spans), ",".join(f"{a}:{b}" for a, b in spans), "\n".join(kept)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column(3)] if whole_rows else []), names=schema.names)

    return joined.mapInArrow(keep, schema)
