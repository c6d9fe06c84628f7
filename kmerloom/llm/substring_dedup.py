"""Substring dedup by line hashing: units are normalised and digested, digests are grouped globally, the earliest stays.

A unit is a sentence of a line, or a line without sentence ends, so that a passage is found also where it begins in the middle
of a line. Units of a few words recur by chance and stay. A line of several sentences is a unit of its own besides, so that a
repeated line goes with its short sentences too.

Only digests and places are shuffled for the grouping, pre-aggregated on the map side, so a unit that a third of all
documents share costs one row a task there; the join that finds its later occurrences is a plain equi-join, which
adaptive execution splits where a digest is hot. Texts move once, to meet the list of their repeated lines.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import lines as L
from kmerloom.llm.common import staged

#: Least words of a unit that is compared.
LEAST_WORDS = 9
#: Least words of a line of several sentences that is compared as a whole.
LINE_WORDS = 14
DIGESTS = "doc_id long, text_key long, line_no int, n_units int, digest binary"


def normalised(line: str) -> str:
    """Lower case, runs of ASCII white space as one space, none at the ends. Equal to the SQL form used in tests."""
    line = line.lower()
    for space in "\t\v\f\r":
        line = line.replace(space, " ")
    return " ".join(x for x in line.split(" ") if x)


def sentences(line: str) -> list[str]:
    """A line cut after each full stop, exclamation or question mark that a space follows, the space included; end to end they are the line."""
    return re.split(r"(?<=[.!?] )", line)


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """`docs` (doc_id, text) with every sentence of a line, and every line of several, removed that occurs earlier, by (doc_id, place in the text); one row per row.

    Lines stand between line feeds; see sentences() for their units, which are equal if they are so once normalised. Units of
    fewer than `least_words` words, blank ones among them, stay unless they are of a line of `line_words` words or more, in
    more than one unit, that as a whole equals an earlier one of those. Returned: doc_id, n_lines (units of at least
    `least_words`), n_removed (units, of any length), chars_removed, removed_spans (start:end in code points of the original text, comma-joined), kept_text
    (what stays; a line of which nothing stays goes with its line feed).

    A null text counts as empty. Rows that repeat a doc_id are ordered by a hash of their text; wholly equal rows count
    as one and are each returned. Rows without a doc_id come after all others. Other columns are ignored. An empty table
    gives an empty result.
    """
    counts = lambda unit: len(normalised(unit).split(" ")) >= least_words if unit.strip() else least_words <= 0

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, line_no, n_units, digest = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                j = 0
                for line in text.as_py().split("\n"):
                    parts = sentences(line)
                    found = [(j + k, 1, normalised(part)) for k, part in enumerate(parts) if counts(part)]
                    if len(parts) > 1 and (whole := normalised(line)) and len(whole.split(" ")) >= line_words:
                        found.append((j, len(parts), "\n" + whole))  # a line feed, so unlike any sentence
                    for first, n, words in found:
                        row.append(i)
                        line_no.append(first)
                        n_units.append(n)
                        digest.append(hashlib.md5(words.encode()).digest())
                    j += len(parts)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(line_no, pa.int32()), pa.array(n_units, pa.int32()), pa.array(digest, pa.binary())], names=["doc_id", "text_key", "line_no", "n_units", "digest"])

    given = L.keyed(docs)
    lines = given.select("doc_id", "text_key", "text").mapInArrow(digests, DIGESTS).withColumn("place", L.place())
    # Written out: its size is known, so that it is broadcast only if small, and else adaptive execution can split a hot digest's join.
    first = staged(lines.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "digests")
    units = F.explode(F.sequence("line_no", F.col("line_no") + F.col("n_units") - 1)).alias("line_no")
    repeats = lines.join(first, "digest").where(F.col("place") != F.col("first")).select("doc_id", "text_key", units)
    return L.rebuilt(given, repeats, counts, units=sentences)


#: The same rows in SQL.
SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents
), cut AS (
  SELECT *, string_split(regexp_replace(line, '([.!?]) ', '\1 ' || chr(1), 'g'), chr(1)) AS parts FROM lines
), whole AS (
  SELECT *, trim(regexp_replace(lower(line), '[ \t-\r]+', ' ', 'g')) AS line_words FROM cut
), lined AS (
  SELECT *, len(parts) > 1 AND line_words <> '' AND len(string_split(line_words, ' ')) >= {LINE_WORDS} AS line_counts FROM whole
), judged AS (
  SELECT *, line_counts AND row_number() OVER (PARTITION BY line_counts, md5(line_words) ORDER BY doc_id, line_no) > 1 AS line_gone FROM lined
), units AS (
  SELECT doc_id, line_no, line_gone, len(parts) AS n, unnest(parts) AS unit, unnest(range(len(parts))) AS k FROM judged
), said AS (
  SELECT *, trim(regexp_replace(lower(unit), '[ \t-\r]+', ' ', 'g')) AS words,
    sum(length(unit) + CASE WHEN k = n - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no, k) - length(unit) - CASE WHEN k = n - 1 THEN 1 ELSE 0 END AS unit_start FROM units
), counted AS (
  SELECT *, words <> '' AND len(string_split(words, ' ')) >= {LEAST_WORDS} AS counts FROM said
), marked AS (
  SELECT *, line_gone OR (counts AND row_number() OVER (PARTITION BY md5(words) ORDER BY doc_id, line_no, k) > 1) AS gone FROM counted
), by_line AS (
  SELECT doc_id, line_no, sum(CASE WHEN counts THEN 1 ELSE 0 END) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed, sum(CASE WHEN gone THEN length(unit) ELSE 0 END) AS chars_removed,
    string_agg(unit_start || ':' || (unit_start + length(unit)), ',' ORDER BY k) FILTER (WHERE gone) AS spans, string_agg(unit, '' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id, line_no
)
SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, sum(n_removed)::BIGINT AS n_removed, sum(chars_removed)::BIGINT AS chars_removed,
  coalesce(string_agg(spans, ',' ORDER BY line_no) FILTER (WHERE spans IS NOT NULL), '') AS removed_spans,
  coalesce(string_agg(kept, chr(10) ORDER BY line_no) FILTER (WHERE kept IS NOT NULL), '') AS kept_text
FROM by_line GROUP BY doc_id
"""
