"""Quality rules by tokeniser fertility: characters per token, byte-fallback share and token entropy, with bands per script.

Public vocabularies are only read, never trained. Text in a language the vocabulary knows gives long tokens of many
kinds; markup debris, symbol noise and looped text give short or few kinds of tokens; unknown characters fall back to
bytes. Each document is measured whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import textvec
from kmerloom.llm.common import in_chunks, utf8_parts
from kmerloom.llm.packing import byte_bpe

MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, entropy_share double, script string, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Band:
    """Limits of one script; a document outside any of them is rejected."""

    least_chars_per_token: float
    most_chars_per_token: float
    most_byte_share: float
    least_entropy: float


#: Bands by script; scripts that the vocabularies hardly cover have short tokens and many byte pieces.
BANDS = {
    "Latin": Band(2.05, 9.0, 0.10, 0.72),
    "Cyrillic": Band(0.8, 9.0, 0.10, 0.60),
    "Greek": Band(0.6, 9.0, 0.10, 0.55),
    "Arabic": Band(0.5, 9.0, 0.15, 0.55),
    "Hebrew": Band(0.5, 9.0, 0.15, 0.55),
    "Han": Band(0.3, 9.0, 0.60, 0.50),
    "Other": Band(0.2, 9.0, 0.90, 0.40),
}
#: The most different tokens over which entropy is compared, and the base rule's limits.
ENTROPY_TOKENS = 256
LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50

#: Word separators aren't measured: the vocabulary has no piece for line feeds and tabs.
SEPARATORS = " \t\n\v\f\r"
TO_SPACES = str.maketrans(SEPARATORS, " " * 6)
SCRIPTS = {name: regex.compile(rf"\p{{{name}}}") for name in ("Cyrillic", "Greek", "Arabic", "Hebrew", "Han")}
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def script_of(text: str) -> str:
    """The script of most letters; texts without letters count as Latin, of which the vocabularies ask most."""
    if text.isascii():
        return "Latin"
    letters = Counter(text)
    by = Counter()
    for char, n in letters.items():
        if char.isalpha():
            by["Latin" if ord(char) < 0x250 else next((k for k, p in SCRIPTS.items() if p.match(char)), "Other")] += n
    return max(sorted(by), key=by.get, default="Latin")


class ByteFallback:
    """Share of byte pieces among the pieces of a text under a SentencePiece vocabulary with byte fallback."""

    def __init__(self, model: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes = {i for i in range(self.pieces.get_piece_size()) if self.pieces.is_byte(i)}
        self.seen: dict[str, bool] = {}

    def falls(self, char: str) -> bool:
        if char not in self.seen:
            self.seen[char] = any(i in self.bytes for i in self.pieces.encode(char))
        return self.seen[char]

    def share(self, text: str) -> float:
        # Byte pieces only come from characters that have no piece; texts without any need no second tokenisation.
        if not any(self.falls(c) for c in set(text) if c not in SEPARATORS):
            return 0.0
        ids = self.pieces.encode(text.translate(TO_SPACES))
        return sum(i in self.bytes for i in ids) / max(1, len(ids))


def entropy_share(ids: np.ndarray) -> float:
    """Entropy of the token kinds in bits over the most that so many tokens (up to ENTROPY_TOKENS) could have; 1 at most."""
    if len(ids) < 2:
        return 1.0
    n = np.unique(ids, return_counts=True)[1] / len(ids)
    return min(1.0, float(-(n * np.log2(n)).sum() / np.log2(min(len(ids), ENTROPY_TOKENS))))


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The plain counts of each text of a batch. Words and windows are compared by 64-bit hashes."""
    n, w = len(bounds) - 1, textvec.words(data, bounds)
    prefix = textvec.prefix_hash(data)
    hashes = textvec.spans_hash(prefix, w.start, w.end, data)
    chars = textvec.code_points(data)
    count = np.diff(w.bounds)
    out = {
        "n_words": count,
        "word_chars": np.bincount(w.doc, chars[w.end] - chars[w.start], n).astype(np.int64),
        "n_symbols": np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[data])])[bounds]).astype(np.int64),
    }

    # lines: text bounds and line feeds cut; a line counts if a word begins in it
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate([bounds[:-1], feeds + 1])
    ends = np.concatenate([bounds[1:], feeds])
    doc = np.concatenate([np.arange(n), np.searchsorted(bounds, feeds, "right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends = np.where(last, bounds[1:][doc], np.append(starts[1:], 1) - 1)
    worded = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, doc = starts[worded], ends[worded], doc[worded]
    line = textvec.spans_hash(prefix, starts, ends, data)
    order = np.lexsort((line, doc))
    again = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][again], minlength=n).astype(np.int64)

    # three-word windows found twice or more in their text cover their words
    m = len(hashes)
    covered = np.zeros(m + 3, np.int64)
    if m >= 3:
        window = textvec.mix(textvec.mix(textvec.mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:])
        at = np.flatnonzero(w.doc[:-2] == w.doc[2:])
        order = at[np.lexsort((window[at], w.doc[at]))]
        same = (window[order][1:] == window[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        np.add.at(covered, order[twice], 1)
        np.subtract.at(covered, order[twice] + 3, 1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(covered)[:m] > 0], minlength=n).astype(np.int64)
    return out


def judged(docs: DataFrame, tokens_file: str, pieces_file: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    """Measure every whole text of `docs` (doc_id, text) and give the verdict `kept`; one row per row.

    Null and empty texts have no words and fail the base rule. Repeated rows are measured each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fallback = byte_bpe(tokens_file), ByteFallback(pieces_file)
        for batch in in_chunks(batches, 1 << 20):
            counts = base_counts(*utf8_parts(batch.column(1)))
            failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEAT_PERCENT * counts["n_words"])
            rows = []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                ids = np.asarray(encode(text), np.int32)
                fertility, share, entropy, script = len(text) / max(1, len(ids)), fallback.share(text), entropy_share(ids), script_of(text)
                band = bands[script]
                fits = band.least_chars_per_token <= fertility <= band.most_chars_per_token and share <= band.most_byte_share and entropy >= band.least_entropy
                rows.append((len(ids), fertility, share, entropy, script, bool(failed[i]), bool(fits and not failed[i])))
            columns = [pa.array(x) for x in zip(*rows, strict=True)]
            columns[0] = columns[0].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in counts.values()), *columns], names=[x.split()[0] for x in MEASURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, MEASURES)
