"""Language ID by multilingual mixture inference.

Each language has n-gram likelihoods, counted over all training documents as a Spark aggregation. Every document is a
mixture: expectation-maximisation estimates each language's share of its n-grams, and a penalised likelihood selects how
many languages it has. The model that tasks are sent has languages x BINS numbers, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm import textvec as V
from kmerloom.llm.common import in_chunks, utf8_parts

GRAM, BINS = 3, 1 << 16
SMOOTHING = 0.1
#: Overlapping n-grams repeat evidence: log-likelihoods are divided by this. A further language costs half a logarithm of the n-grams, as often as PENALTY says.
OVERLAP, PENALTY = 3.0, 4.0
STEPS, CLOSE = 40, 1e-3
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, n_langs long, mixture string"

#: Bytes that count as spaces between words: ASCII other than letters.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[i for i in range(128) if not chr(i).isalpha()]] = 32


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the n-grams of each text, end to end, and where each text's begin (length n + 1): bytes of the lower-cased text between two spaces."""
    padded = pc.binary_join_element_wise("", pc.utf8_lower(texts), "", " ")
    data, bounds = utf8_parts(padded)
    data = PLAIN[data].astype(V.U64)
    n = max(0, len(data) - GRAM + 1)
    code = np.zeros(n, V.U64)
    for j in range(GRAM):
        code = (code << V.U64(8)) | data[j : j + n]
    bins = (V.mix(code) & V.U64(BINS - 1)).astype(np.int32)
    inside = np.ones(n + GRAM, bool)
    for j in range(1, GRAM):  # those that would reach into the next text
        ends = bounds[1:] - j
        inside[ends[ends >= 0]] = False
    inside = inside[:n]
    return bins[inside], np.concatenate([[0], np.cumsum(inside)])[np.minimum(bounds, n)]


def counted(docs: DataFrame) -> DataFrame:
    """(lang, bin, n): n-gram counts of the languages of all rows of `docs` (lang, text) with a lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in in_chunks(batches, 1 << 20):
            bins, at = grams(batch.column(1))
            langs = batch.column(0).dictionary_encode()
            own = np.repeat(langs.indices.to_numpy(), np.diff(at))
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                totals[lang] = totals.get(lang, 0) + np.bincount(bins[own == i], minlength=BINS)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bin", "n"])

    rows = docs.where("lang is not null").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Mixture:
    """Languages and their likelihoods of each bin."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = counts + SMOOTHING
        self.likelihood = (p / p.sum(1, keepdims=True) * BINS).astype(np.float32)

    @classmethod
    def learned(cls, docs: DataFrame) -> Mixture:
        """From the documents of `docs` with a lang; what reaches the driver is at most a number a language and bin."""
        rows = counted(docs).toArrow()
        names = rows["lang"].combine_chunks().dictionary_encode() if len(rows) else pa.array([], pa.string()).dictionary_encode()
        known = names.dictionary.to_pylist()
        langs = sorted(known)
        place = np.array([langs.index(x) for x in known], np.int64)
        counts = np.zeros((len(langs), BINS))
        if langs:
            counts[place[names.indices.to_numpy()], rows["bin"].to_numpy()] = rows["n"].to_numpy()
        return cls(langs, counts)

    @staticmethod
    def shares(p: np.ndarray) -> tuple[np.ndarray, float]:
        """EM for the mixture shares of the rows of p; the shares and the log-likelihood."""
        share = np.full(len(p), 1 / len(p), np.float32)
        if len(p) > 1:
            for _ in range(STEPS):
                weight = share @ p
                new = share * (p @ (1 / weight)) / p.shape[1]
                done = np.abs(new - share).max() < CLOSE
                share = new
                if done:
                    break
        return share, float(np.log(share @ p).sum(dtype=np.float64))

    def infer(self, bins: np.ndarray) -> tuple[str, float, list[tuple[str, float]]]:
        """(language, its share among all languages, the selected languages with their shares)."""
        p = self.likelihood[:, bins]
        every, _ = self.shares(p)
        order = np.argsort(-every, kind="stable")
        cost = PENALTY * np.log(max(2, len(bins))) / 2
        best, chosen = None, None
        for m in range(1, len(order) + 1):
            share, fit = self.shares(p[order[:m]])
            value = fit / OVERLAP - cost * m
            if best is not None and value <= best:
                break
            best, chosen = value, share
        mix = sorted(((self.langs[i], float(s)) for i, s in zip(order, chosen, strict=False)), key=lambda x: -x[1])
        lang = mix[0][0]
        return lang, min(1.0, max(0.0, float(every[self.langs.index(lang)]))), mix


def held_out():
    """Whether crc32 of the doc_id as text is 0 modulo 5; rows without a doc_id are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identified(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """The language of every whole text of `docs` (doc_id, text, lang), learned from the rows that aren't held out.

    Returned: doc_id, held_out, lang_pred, score (the share of the text's n-grams that EM gives lang_pred among all
    languages, 0 to 1), n_langs and mixture (the selected languages with shares, largest first); the whole row as `row` if
    whole_rows. A text that is null or
    has no letter is `und` with score 0, and so is every text if no row has a lang to learn from. lang, source and doc_id
    don't enter a prediction. Rows that repeat a doc_id are predicted each. Other columns are ignored. An empty table
    gives an empty result.
    """
    rows = docs.select(*([F.struct("*").alias("row")] if whole_rows else []), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", F.col("lang").cast("string").alias("lang"))
    model = Mixture.learned(rows.where(~F.col("held_out")))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in in_chunks(batches, column="text"):
            texts = batch.column(2).fill_null("")
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            bins, at = grams(texts)
            rows = []
            for i in range(len(batch)):
                if not (lettered[i] and model.langs):
                    rows.append(("und", 0.0, 0, ""))
                    continue
                lang, score, mix = model.infer(bins[at[i] : at[i + 1]])
                rows.append((lang, score, len(mix), ",".join(f"{k}:{v:.3f}" for k, v in mix)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.string()]
            columns = [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column(3)] if whole_rows else []), names=schema.names)

    given = rows.select("doc_id", "held_out", "text", *(["row"] if whole_rows else []))
    schema = T.StructType([*T._parse_datatype_string(PREDICTED), *([given.schema["row"]] if whole_rows else [])])
    return given.mapInArrow(predict, schema)
