"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Every document is tokenised whole. A document longer than a sequence is cut into full sequences and a remainder;
the remainders of one group are packed by first-fit decreasing. Groups are dealt by a seeded hash, their number
follows the number of documents, so each packing task holds a bounded number of (id, length) records and never texts.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 2048
END_ID = 1

#: Blanks in a row that are tokenised as one piece of their own: the pattern's engine fails at about a million of them.
LONG_BLANK = 1 << 15
#: White space of the pattern.
BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_BLANK)

TOKENS = "doc_id long, doc_tokens long, crcs array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Free space of up to `size` bins; `first_fit(n)` finds the leftmost bin with n free in O(log size)."""

    def __init__(self, size: int, capacity: int):
        self.leaves = 1 << max(0, (size - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, need: int) -> tuple[int, int]:
        """Takes `need` from the leftmost bin that has it; returns the bin and the free space it had before."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < need:
                at += 1
        had = best[at]
        bin_, best[at] = at - self.leaves, had - need
        at //= 2
        while at:
            best[at] = max(best[2 * at], best[2 * at + 1])
            at //= 2
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item; ties keep the given order. Items over the capacity are refused."""
    if len(lengths) and lengths.max() > capacity:
        raise ValueError("an item is larger than a bin")
    tree = TournamentTree(max(1, len(lengths)), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], had = tree.first_fit(int(lengths[i]))
        offsets[i] = capacity - had
    return bins, offsets


def byte_bpe(ranks: str, added: dict[str, int] | None = None):
    """The encoder of a byte-level BPE vocabulary's rank file (`.tiktoken`): text -> ids; strings of `added` tokens are one id, all else is ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens=added or {})

    def by_runs(text: str) -> list[int]:
        out, at = [], 0
        for run in BLANKS.finditer(text):
            # the pattern takes a run of blanks up to its last one, which it leaves to what follows; at the end the whole run
            end = run.end() - (run.end() < len(text))
            out += encoding.encode_ordinary(text[at : run.start()])
            out += encoding._encode_single_piece(text[run.start() : end])
            at = end
        return out + encoding.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        special = [x for x in added or () if x in text]
        if len(text) >= LONG_BLANK and BLANKS.search(text):
            parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text) if special else [text]
            return [i for part in parts for i in ([added[part]] if part in special else by_runs(part))]
        return encoding.encode(text, allowed_special="all") if special else encoding.encode_ordinary(text)

    return encode


def encoder(vocabulary: str, ranks: str | None = None):
    """Text -> the ids that `tokenizers` gives with the vocabulary file (`.json`) and add_special_tokens=False.

    The `ranks` of the same vocabulary (`.tiktoken`) are about five times as fast. The strings of the vocabulary's added
    tokens, such as <|endoftext|>, are those tokens in either case.
    """
    if not ranks:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    with open(vocabulary, encoding="utf-8") as file:
        added = {x["content"]: int(x["id"]) for x in json.load(file).get("added_tokens", [])}
    return byte_bpe(ranks, added)


def tokenised(docs: DataFrame, vocabulary: str, ranks: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per row of `docs`: its token count (with the closing id) and the CRC-32 of each run of `sequence` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            totals, crcs = [], []
            for text in batch.column(1):
                ids = array("I", encode(text.as_py()))
                ids.append(end_id)
                raw = memoryview(np.asarray(ids, dtype="<u4").tobytes())
                totals.append(len(ids))
                crcs.append([zlib.crc32(raw[i : i + 4 * sequence]) for i in range(0, len(raw), 4 * sequence)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, TOKENS)


def packed(docs: DataFrame, vocabulary: str, ranks: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, group_docs: int = 4096, seed: int = 17) -> DataFrame:
    """Pack all `docs` (columns doc_id, text) into sequences of at most `sequence` tokens; one row per piece. See encoder() for the vocabulary's files.

    A group holds about `group_docs` documents. A null or empty text is one token, the closing id. Rows that repeat a
    doc_id, or have none, are packed each for itself. An empty table gives no pieces. Other columns are ignored.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def pack(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "doc_tokens"], kind="stable", na_position="last").reset_index(drop=True)
        totals = rows["doc_tokens"].to_numpy()
        counts = rows["crcs"].map(len).to_numpy()
        doc = np.repeat(np.arange(len(rows)), counts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = nth * sequence
        length = np.minimum(sequence, totals[doc] - start)
        bins, offsets = first_fit_decreasing(length, sequence)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].astype("Int64").take(doc).reset_index(drop=True), "start": start, "length": length,
                "ids_crc32": np.concatenate([np.asarray(x, np.int64) for x in rows["crcs"]]), "doc_tokens": totals[doc],
                "sequence_id": (int(group[0]) << 32) + bins, "offset": offsets,
            }
        )

    dealt = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", F.element_at("crcs", 1)), F.lit(groups))
    return tokenised(docs, vocabulary, ranks, sequence, end_id).withColumn("packing_group", dealt).groupBy("packing_group").applyInPandas(pack, PIECES)
