"""Filter interaction audit by a packed bitmap index: what each filter removes after every set of other filters.

Each partition packs, batch by batch, one bit a document: which filters it fails, its labels, its part. Every figure of
an order of filters is a popcount of AND and AND-NOT of such bitmaps, for each set of filters that can stand before another
(16 sets a filter); the counts of the partitions are added up. The orders are then read off the sums, which are a
few hundred rows a part however many documents there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import staged

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
SETS, COUNTS = 1 << len(FILTERS), ("kept", "removed", "redundant", "good", "toxic")
#: Parts whose counts a task holds before it gives them out.
HELD_PARTS = 4096

#: The filters' limits and characters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 100, 80, 10
CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"

FACTS = "doc_id long, digest binary, part string, fails int"
SUMS = "part string, before int, filter int, kept long, removed long, redundant long, good long, toxic long"


def failures(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # of bytes: at space and \\t..\\r
    few = len(words) < LEAST_WORDS
    same = 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)
    shouts = 100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS_PERCENT * n_chars
    marked = len(text.translate(None, MARKS)) < len(text)
    return few | same << 1 | shouts << 2 | marked << 3


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, part, fails) of each document: 128 bits of its text, its lang, and its failures of A to D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.utf8_length(batch.column(1)).to_pylist()
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            fails, digests = [], []
            for text, n in zip(texts, lengths, strict=True):
                text = text.as_py()
                fails.append(failures(text, n))
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), batch.column(2), pa.array(fails, pa.int32())], names=["doc_id", "digest", "part", "fails"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")]
    return docs.select(*columns).mapInArrow(run, FACTS)


def known(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """facts() with the failure of E and the labels: (part, fails, good, toxic).

    E is failed by each document that isn't the first of its text. The firsts are found by an aggregation (so a text that a
    third of all documents share is one row a task) and met by their doc_id, which is different for every row of a hot text.
    """
    of = staged(facts(docs), "facts")
    named = of.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(0).alias("again"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    joined = named.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    fails = (F.col("fails") + 16 * F.coalesce("again", F.lit(1))).cast("int").alias("fails")
    nameless = of.where("doc_id is null").select("part", "fails", F.lit(0).alias("good"), F.lit(0).alias("toxic"))  # they meet nothing
    return joined.select("part", fails, F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).unionByName(nameless)


def _packed(bits: np.ndarray) -> np.ndarray:
    """A bit a document, in 64-bit words."""
    packed = np.packbits(bits)
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


class Bitmaps:
    """The bitmap index of a batch of documents: one bitmap a filter and a label, over its documents in their order."""

    def __init__(self, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray):
        self.fails = [_packed((fails >> f) & 1) for f in range(len(FILTERS))]
        self.good, self.toxic = _packed(good), _packed(toxic)
        #: For each set of filters, the documents that fail any of it.
        self.any = [np.zeros_like(self.good)]
        for s in range(1, SETS):
            low = (s & -s).bit_length() - 1
            self.any.append(self.any[s & (s - 1)] | self.fails[low])

    def counts(self, part: np.ndarray) -> np.ndarray:
        """[set, filter, COUNTS] within the documents of the bitmap `part`, for the filters outside each set."""
        out = np.zeros((SETS, len(FILTERS), len(COUNTS)), np.int64)
        for s in range(SETS):
            left = part & ~self.any[s]
            for f, fails in enumerate(self.fails):
                if not s >> f & 1:
                    gone = left & fails
                    out[s, f] = _count(left & ~fails), _count(gone), _count(part & fails & self.any[s]), _count(gone & self.good), _count(gone & self.toxic)
        return out


def summed(documents: DataFrame) -> DataFrame:
    """(part, before, filter, kept, removed, redundant, good, toxic) of (part, fails, good, toxic): figures of `filter` right after the set `before` of others."""

    def rows(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        s, f = np.nonzero([[not s >> f & 1 for f in range(len(FILTERS))] for s in range(SETS)])
        counts = np.concatenate([x[s, f] for x in held.values()]) if held else np.zeros((0, len(COUNTS)), np.int64)
        parts = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), len(s))))
        columns = [parts, pa.array(np.tile(s, len(held)), pa.int32()), pa.array(np.tile(f, len(held)), pa.int32()), *(pa.array(c) for c in counts.T)]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SUMS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            index = Bitmaps(*(batch.column(i).to_numpy() for i in (1, 2, 3)))
            parts = batch.column(0).dictionary_encode()
            place = parts.indices.to_numpy()
            for i, name in enumerate(parts.dictionary.to_pylist()):
                counts = index.counts(_packed(place == i))
                held[name] = held[name] + counts if name in held else counts
            if len(held) > HELD_PARTS:
                yield rows(held)
                held = {}
        yield rows(held)

    made = documents.select("part", "fails", "good", "toxic").mapInArrow(run, SUMS)
    return made.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step: what the step's filter does there. See summed().

    Columns: part (lang; null counts as the empty string), filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (what the filter removes, over all orders).

    A null text counts as empty. A document without a doc_id has no smaller one, so it never fails E; nor do rows that repeat
    the smallest doc_id of their text. Labels that repeat a doc_id count once, quality=1 and toxic=1 if any says so. An
    empty table has no parts and gives no rows. Other columns are ignored.
    """
    sums = summed(known(docs, labels))
    weight = {s: factorial(bin(s).count("1")) * factorial(len(FILTERS) - 1 - bin(s).count("1")) for s in range(SETS - 1)}
    times = F.element_at(F.create_map(*(F.lit(x) for pair in weight.items() for x in pair)), F.col("before"))
    # a row a part and filter: few, and joined by hash like any other
    alone = F.col("before") == F.expr(f"{ALL} - shiftleft(1, filter)")
    whole = sums.groupBy("part", "filter").agg(F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * times).cast("long").alias("shapley"))
    steps = [("".join(FILTERS[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in permutations(range(len(FILTERS))) for k in range(len(FILTERS))]
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")  # 600 rows
    made = sums.join(whole, ["part", "filter"]).join(F.broadcast(orders), ["before", "filter"])
    return made.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


#: The same rows in SQL.
SQL = r"""
WITH given AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM given
), failed AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END AS a, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 1 ELSE 0 END AS c,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d, CASE WHEN doc_id > first THEN 1 ELSE 0 END AS e FROM worded
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), facts AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM failed LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM facts GROUP BY part, fails
), filters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT p.name || q.name || r.name || s.name || t.name AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM filters p, filters q, filters r, filters s, filters t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31
), steps AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest(bits) AS bit, unnest([0, bits[1], bits[1] + bits[2], bits[1] + bits[2] + bits[3], 31 - bits[5]]) AS before FROM orders
), sums AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM sums
"""
