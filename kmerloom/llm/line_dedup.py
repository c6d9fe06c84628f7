"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens, then by its leading tokens, to a leaf; tokens with a digit are fields on
the way. In the leaf its variable fields are generalised by what stands at each position in the leaf's other lines: a token
is constant if enough documents have it there, else a field. How many are enough is asked at several levels, so that a
field with a few frequent values is one too at the next level. A template with enough constant tokens that many documents
have recurs: the earliest document with it keeps its lines, the others lose theirs. A long line that is the same token for
token recurs from two documents on.

No leaf is held by one task, however full: documents are counted by leaf, by (leaf, position, token) and by template, each
a map-side aggregation of 64-bit hashes; lines of leaves with too few documents leave after the first. A line has
no more templates than there are levels, so the work is linear in the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import lines as L
from kmerloom.llm import textvec as V
from kmerloom.llm.common import WORD, discarded, in_chunks, staged, utf8_parts
from kmerloom.llm.jaccard_join import ranges

COUNTS = "item long, n_docs long"
LINES = "doc_id long, text_key long, leaf long, n int, numbers binary, tokens binary"  # and n_docs of the leaf
LONG = "doc_id long, text_key long, line_no int, template long"
PLACES = "doc_id long, text_key long, line_no int, item long, n int, leading int, fields int"

#: Tree depth below the token count; documents from which on a template recurs, and one that has words as fields.
LEADING, LEAST_DOCS, FIELD_DOCS = 2, 10, 30
#: A token is constant at a level if at least so many documents of the leaf have it at its position.
LEVELS = tuple(LEAST_DOCS * 3**i for i in range(9))
#: Least tokens of a long line, and the documents from which on it recurs as it stands.
LONG_TOKENS, LONG_DOCS = 20, 2
ALWAYS = 1 << 62

DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


@dataclass
class Parsed:
    """Lines with a token of a batch of texts: text, line number, number of tokens, leaf and whole hash of each; its tokens (0: a field) from `first` on."""

    doc: np.ndarray
    number: np.ndarray
    n: np.ndarray
    leaf: np.ndarray
    whole: np.ndarray
    first: np.ndarray
    token: np.ndarray


def parse(data: np.ndarray, bounds: np.ndarray) -> Parsed:
    w = V.words(data, bounds)
    m = len(w.start)
    feeds = np.flatnonzero(data == 10)
    before = np.searchsorted(feeds, w.start)
    opens = np.append(True, (w.doc[1:] != w.doc[:-1]) | (before[1:] != before[:-1]))[:m]
    first = np.flatnonzero(opens)
    n = np.diff(np.append(first, m))
    position = np.arange(m) - np.repeat(first, n)
    verbatim = V.spans_hash(V.prefix_hash(data), w.start, w.end, data)
    digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
    token = np.where(digits[w.end] > digits[w.start], 0, (verbatim >> V.U64(33)) + V.U64(1)).astype(np.uint32)
    placed = lambda t: V.mix(t.astype(V.U64) + V.mix(position.astype(V.U64) + V.U64(1)))
    summed = lambda h: np.add.reduceat(h, first) if m else h
    leaf = V.mix(summed(np.where(position < LEADING, placed(token), V.U64(0))) + V.mix(n.astype(V.U64)))
    whole = V.mix(summed(placed(verbatim)) + V.mix(n.astype(V.U64) + V.U64(V.BASE)))
    return Parsed(w.doc[first], before[first] - np.searchsorted(feeds, bounds[:-1])[w.doc[first]], n, leaf, whole, first, token)


def per_document(doc: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
    """(item, n_docs): how many of these documents have each item."""
    order = np.lexsort((item, doc))
    doc, item = doc[order], item[order]
    fresh = np.append(True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]))[: len(item)]
    item, n = np.unique(item[fresh], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(item.view(np.int64)), pa.array(n, pa.int64())], names=["item", "n_docs"])


def items(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of LINES: (row, line in its batch, item) of each token that isn't a leading one or a field, and the tokens of each line as counts of leading words and of fields."""
    leaf, n = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy().astype(np.int64)
    token = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint32)
    lines = np.array([len(x) // 4 for x in batch.column(4).to_pylist()], np.int64)
    size = np.repeat(n, lines)
    line = np.repeat(np.arange(len(size)), size)
    position = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(np.arange(len(batch)), lines)
    some = (position >= LEADING) & (token > 0)
    item = V.mix(leaf[row][line[some]] + V.mix(token[some].astype(V.U64) + (position[some].astype(V.U64) << V.U64(32))))
    kinds = np.stack([np.bincount(line[(position < LEADING) & (token > 0)], minlength=len(size)), np.bincount(line[token == 0], minlength=len(size))])
    return row, line[some], item, kinds


def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item) of rows of LINES: each item of items() once a document and leaf, uncombined, so rows are in proportion to tokens in whatever order they stand."""
    for batch in in_chunks(batches, column="tokens"):
        row, line, item, _ = items(batch)
        row = row[line]
        order = np.lexsort((item, row))
        row, item = row[order], item[order]
        fresh = np.append(True, (item[1:] != item[:-1]) | (row[1:] != row[:-1]))[: len(item)]
        yield pa.RecordBatch.from_arrays([pa.array(item[fresh].view(np.int64))], names=["item"])


def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, line_no, template) of rows of LINES: each line with no other fields than tokens with a digit."""
    for batch in in_chunks(batches, column="tokens"):
        n = batch.column(3).to_numpy().astype(np.int64)
        token, number = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in ((5, np.uint32), (4, np.int32)))
        row = np.repeat(np.arange(len(batch)), [len(x) // 4 for x in batch.column(4).to_pylist()])
        first = np.cumsum(n[row]) - n[row]
        position = np.arange(len(token)) - np.repeat(first, n[row])
        whole = V.mix(np.add.reduceat(V.mix(token.astype(V.U64) + V.mix(position.astype(V.U64) + V.U64(7))), first) + batch.column(2).to_numpy().view(np.uint64)[row])
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number), pa.array(whole.view(np.int64))], names=[x.split()[0] for x in LONG.split(", ")])


def templates(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, template) of `lines`, a row for each template of a line that has words as fields."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, column="tokens"):
            row, line, item, (leading, fields) = items(batch)
            number = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int32)
            every = np.concatenate([np.arange(len(row)), line])  # each line's leaf, then its tokens
            at, own = pa.array(row[every]), len(row)
            only = lambda x: pa.array(np.append(x, np.zeros(len(line), np.int64)), pa.int32(), mask=np.arange(len(every)) >= own)
            item = np.concatenate([batch.column(2).to_numpy()[row], item.view(np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number[every]), pa.array(item), only(batch.column(3).to_numpy()[row]), only(leading), only(fields)], names=[x.split()[0] for x in PLACES.split(", ")])

    met = lines.mapInArrow(places, PLACES).join(frequent, "item")
    at = lambda least: F.when(F.col("n_docs") >= least, F.col("item"))
    counted = met.groupBy("doc_id", "text_key", "line_no").agg(
        F.max("n").alias("n"), F.max("leading").alias("leading"), F.max("fields").alias("fields"),
        *(x for i, least in enumerate(LEVELS) for x in (F.bit_xor(at(least)).alias(f"template_{i}"), (F.count(at(least)) - 1).alias(f"constant_{i}"))),
    )
    level = lambda i: F.struct(F.col(f"template_{i}").alias("template"), (F.col(f"constant_{i}") + F.col("leading")).cast("int").alias("constant"))
    each = counted.select("doc_id", "text_key", "line_no", "n", "fields", F.explode(F.array_distinct(F.array(*map(level, range(len(LEVELS)))))).alias("t"))
    return each.where("2 * (t.constant + fields) >= n and t.constant >= 2 and t.constant + fields < n").select("doc_id", "text_key", "line_no", "t.template")


def deduped(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """`docs` (doc_id, text) without the lines whose template recurs, but in the earliest document that has it; one row per row.

    Tokens are runs of other characters than white space. A template recurs in LEAST_DOCS documents, one with words as
    fields in FIELD_DOCS; half of its tokens at least are constant or have a digit, and two, or all words of a line, are constant.
    Lines of at least LONG_TOKENS tokens also go where the same tokens stand as a line of an earlier document, be it only one.

    Columns as of lines.rebuilt(): doc_id, n_lines (lines with a token), n_removed, chars_removed, removed_spans, kept_text;
    with `row`, the whole row, if whole_rows. Lines without tokens stay. A null text counts as empty. Rows that repeat a
    doc_id count each, and all rows of the earliest doc_id keep their lines; rows without a doc_id come after all others.
    Other columns are ignored. An empty table gives an empty result.
    """
    given = L.keyed(docs)
    texts = given.select("doc_id", "text_key", "text")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            p = parse(*utf8_parts(batch.column(2)))
            yield per_document(p.doc, p.leaf)

    def of_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            p = parse(*utf8_parts(batch.column(2)))
            order = np.lexsort((p.number, p.leaf, p.doc))
            doc, leaf = p.doc[order], p.leaf[order]
            cuts = np.append(np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (leaf[1:] != leaf[:-1]))[: len(doc)]), len(doc))
            # each group's lines are of one number of tokens, so they stand end to end
            token = p.token[ranges(p.first[order], p.n[order])]
            ends = np.append(0, np.cumsum(p.n[order]))[cuts]
            at, head = pa.array(doc[cuts[:-1]]), order[cuts[:-1]]
            number = p.number[order].astype(np.int32)
            binary = lambda x, c: pa.array([x[a:b].tobytes() for a, b in zip(c[:-1].tolist(), c[1:].tolist(), strict=True)], pa.binary())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(p.leaf[head].view(np.int64)), pa.array(p.n[head].astype(np.int32)), binary(number, cuts), binary(token, ends)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in LINES.split(", ")])

    def long_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            p = parse(*utf8_parts(batch.column(2)))
            own = np.flatnonzero(p.n >= LONG_TOKENS)
            at = pa.array(p.doc[own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(p.number[own].astype(np.int32)), pa.array(p.whole[own].view(np.int64))], names=[x.split()[0] for x in LONG.split(", ")])

    often = lambda counts: counts.groupBy("item").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= LEAST_DOCS)
    live = staged(often(texts.mapInArrow(leaves, COUNTS)), "leaves")
    # A leaf's lines of a document are one row, so that documents are counted without another shuffle.
    found = texts.mapInArrow(of_leaves, LINES).join(live.withColumnRenamed("item", "leaf"), "leaf")
    lines = staged(found.select("doc_id", "text_key", "leaf", "n", "numbers", "tokens", "n_docs"), "lines")
    # Leaves of fewer documents can't have a template with words as fields.
    full = lines.where(F.col("n_docs") >= FIELD_DOCS)
    frequent = staged(often(full.mapInArrow(of_items, "item long").withColumn("n_docs", F.lit(1))).unionByName(live.where(F.col("n_docs") >= FIELD_DOCS).select("item", F.lit(ALWAYS).alias("n_docs"))), "tokens")
    least = lambda df, n: df.withColumn("least_docs", F.lit(n))
    placed = staged(least(templates(full, frequent), FIELD_DOCS).unionByName(least(lines.mapInArrow(masked, LONG), LEAST_DOCS)).unionByName(least(texts.mapInArrow(long_lines, LONG), LONG_DOCS)), "templates")
    for done in (live, lines, frequent):  # only the templates are read from here on
        discarded(done)
    rank = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    once = placed.groupBy("template", rank.alias("rank"), "text_key").agg(F.max("least_docs").alias("least_docs"))
    counted = once.groupBy("template").agg(F.count("*").alias("n_docs"), F.min("rank").alias("first"), F.max("least_docs").alias("least_docs"))
    # Written out: its size is known, so that it is broadcast only if small, and else a hot template's join can be split.
    recurring = staged(counted.where("n_docs >= least_docs").select("template", "first"), "recurring")
    gone = placed.join(recurring, "template").where(rank != F.col("first")).select("doc_id", "text_key", "line_no")
    return L.rebuilt(given, gone, lambda line: bool(line.strip(" \t\n\v\f\r")), whole_rows)


#: The same rows in SQL, templates spelled out.
SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents
), split AS (
  SELECT doc_id, line_no, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS line_start, regexp_extract_all(line, '{WORD}') AS words FROM lines
), parsed AS (
  SELECT *, len(words) AS n, list_transform(words, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN NULL ELSE x END) AS tokens FROM split WHERE len(words) > 0
), leafed AS (
  SELECT *, n || chr(10) || coalesce(tokens[1], ' ') || chr(10) || coalesce(tokens[2], ' ') AS leaf,
    len(list_filter(tokens, lambda x: x IS NULL)) AS fields, len(list_filter(tokens[1:{LEADING}], lambda x: x IS NOT NULL)) AS leads FROM parsed
), live AS (
  SELECT l.* FROM leafed l JOIN (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}) USING (leaf)
), placed AS (
  SELECT doc_id, line_no, leaf, unnest(tokens) AS token, unnest(range(n)) AS position FROM live
), frequent AS (
  SELECT leaf, position, token, count(DISTINCT doc_id) AS n_docs FROM placed WHERE position >= {LEADING} AND token IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}
), levels AS (
  SELECT unnest([{", ".join(map(str, LEVELS))}]) AS least
), constants AS (
  SELECT doc_id, line_no, least, count(*) AS constant, string_agg(position || ':' || token, ' ' ORDER BY position) AS said
  FROM placed JOIN frequent USING (leaf, position, token) JOIN levels ON n_docs >= least GROUP BY ALL
), leveled AS (
  SELECT DISTINCT doc_id, line_no, n, fields, leaf || chr(10) || coalesce(said, '') AS template, coalesce(constant, 0) + leads AS constant
  FROM live CROSS JOIN levels LEFT JOIN constants USING (doc_id, line_no, least)
), templates AS (
  SELECT doc_id, line_no, template, CASE WHEN constant + fields < n THEN {FIELD_DOCS} ELSE {LEAST_DOCS} END AS least_docs FROM leveled
  WHERE 2 * (constant + least(fields, n - constant)) >= n AND constant >= least(n - fields, 2)
  UNION ALL SELECT doc_id, line_no, 'whole ' || array_to_string(words, ' '), {LONG_DOCS} FROM parsed WHERE n >= {LONG_TOKENS}
), recurring AS (
  SELECT template, min(doc_id) AS first FROM templates GROUP BY template HAVING count(DISTINCT doc_id) >= max(least_docs)
), dropped AS (
  SELECT DISTINCT doc_id, line_no FROM templates JOIN recurring USING (template) WHERE doc_id <> first
), marked AS (
  SELECT p.*, len(words) AS n, d.line_no IS NOT NULL AS gone FROM split p LEFT JOIN dropped d USING (doc_id, line_no)
)
SELECT doc_id, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_removed,
  sum(CASE WHEN gone THEN length(line) ELSE 0 END)::BIGINT AS chars_removed,
  coalesce(string_agg(line_start || ':' || (line_start + length(line)), ',' ORDER BY line_no) FILTER (WHERE gone), '') AS removed_spans,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS kept_text
FROM marked GROUP BY doc_id
"""
