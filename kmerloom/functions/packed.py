"""k-mers as numbers, two bits a base, the first base highest; their order is that of the text.

Up to 31 bases are one long that isn't negative. Longer k-mers are a struct of two: `hi` has all but the last 32 bases,
`lo` those 32, with the highest bit turned, so that signed numbers compare as the text does. Runs of bases travel as words of
32 bases; columns of Spark's own functions cut k-mers out of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
#: Bases of a word, and most bases of a k-mer that is one long.
WORD, SINGLE = 32, 31
TURN = -(1 << 63)


def sql_type(k: int) -> str:
    return "long" if k <= SINGLE else "struct<hi:long,lo:long>"


def arrow_type(k: int) -> pa.DataType:
    return pa.int64() if k <= SINGLE else pa.struct([("hi", pa.int64()), ("lo", pa.int64())])


def words_at(code: np.ndarray) -> np.ndarray:
    """The word of the 32 bases from each place on, beyond the end as A; by doubling, so in five steps."""
    n, out = len(code), np.zeros(len(code) + WORD, U64)
    out[:n] = code & 3
    done = 1
    while done < WORD:
        out[: len(out) - done] = out[: len(out) - done] << U64(2 * done) | out[done:]
        done *= 2
    return out


def prefixes(words: np.ndarray, bases: int) -> np.ndarray:
    """The first `bases` bases of words, as numbers."""
    return words >> U64(2 * (WORD - bases)) if bases else np.zeros_like(words)


def kmers_at(words: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    """The k-mers that begin at the places `at`, of words_at()."""
    if k <= SINGLE:
        return pa.array(prefixes(words[at], k).view(np.int64))
    hi = prefixes(words[at], k - WORD).view(np.int64)
    lo = (words[at + (k - WORD)] ^ U64(1 << 63)).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])


def _word_from(words: str, place: str) -> str:
    """SQL of the 32 bases from base `place` on of an array of words."""
    rest = f"get({words}, cast({place} div {WORD} as int) + 1)"
    shift = f"cast(2 * ({place} % {WORD}) as int)"
    return f"(shiftleft(get({words}, cast({place} div {WORD} as int)), {shift}) | if({place} % {WORD} = 0, 0L, shiftrightunsigned(coalesce({rest}, 0L), 64 - {shift})))"


def kmer_of(words: str, place: str, k: int) -> Column:
    """The k-mer from base `place` on of the column `words`, an array of words; both are SQL."""
    if k <= SINGLE:
        return F.expr(f"shiftrightunsigned({_word_from(words, place)}, {2 * (WORD - k)})")
    hi = f"shiftrightunsigned({_word_from(words, place)}, {2 * (2 * WORD - k)})" if k > WORD else "0L"
    lo = _word_from(words, f"({place} + {k - WORD})")
    return F.expr(f"named_struct('hi', {hi}, 'lo', {lo} ^ (-9223372036854775807L - 1L))")


def mmer_of(kmer: str, place: str, k: int, m: int) -> str:
    """SQL of the m bases, 31 at most, from base `place` on of the k-mer `kmer`, as a number."""
    behind, mask = f"cast(2 * ({k - m} - {place}) as int)", f"{(1 << 2 * m) - 1}L"
    if k <= SINGLE:
        return f"(shiftrightunsigned({kmer}, {behind}) & {mask})"
    last = f"({kmer}.lo ^ (-9223372036854775807L - 1L))"
    low = f"if({behind} = 0, {last}, shiftrightunsigned({last}, {behind}) | shiftleft({kmer}.hi, 64 - {behind}))"
    return f"(if({behind} >= 64, shiftrightunsigned({kmer}.hi, {behind} - 64), {low}) & {mask})"


def _letters(word: Column) -> Column:
    """The letters of a number of eight bases, as a number of eight bytes."""
    ones = 0x0101010101010101
    for factor, mask in ((1 + (1 << 24), 0x000000FF000000FF), (1 + (1 << 12), 0x000F000F000F000F), (1 + (1 << 6), 0x0303030303030303)):
        word = (word * factor).bitwiseAND(mask)
    low, high = word.bitwiseAND(ones), F.shiftright(word, 1).bitwiseAND(ones)
    # A, C, G and T are 65, 65 + 2, 65 + 6 and 65 + 2 + 6 + 11
    return F.lit(65 * ones) + low * 2 + high * 6 + low.bitwiseAND(high) * 11


def to_text(kmer: Column, k: int) -> Column:
    def text(number: Column, bases: int) -> Column:
        """By words of eight bases, which are spread to a byte each and become the letters' codes: several times as fast as digits of conv()."""
        if not bases:
            return F.lit("")
        n_words = -(-bases // 8)
        codes = F.concat(*(F.hex(_letters(F.shiftrightunsigned(number, 16 * i).bitwiseAND(0xFFFF))) for i in reversed(range(n_words))))
        return F.substring(F.unhex(codes).cast("string"), 8 * n_words - bases + 1, bases)

    if k <= SINGLE:
        return text(kmer, k)
    # by halves, as conv() takes the word 1 << 63 (G and 31 As) for another one
    last, half = kmer["lo"].bitwiseXOR(F.lit(TURN)), WORD // 2
    return F.concat(text(kmer["hi"], k - WORD), text(F.shiftrightunsigned(last, 2 * half), half), text(last.bitwiseAND((1 << 2 * half) - 1), half))


def from_text(kmer: Column, k: int) -> Column:
    """The number of a text of k bases."""

    def number(text: Column) -> Column:
        return F.conv(F.translate(text, "ACGT", "0123"), 4, -10).cast("long")

    if k <= SINGLE:
        return number(kmer)
    hi = number(F.substring(kmer, 1, k - WORD)) if k > WORD else F.lit(0).cast("long")
    return F.when(kmer.isNotNull(), F.struct(hi.alias("hi"), number(F.substring(kmer, k - WORD + 1, WORD)).bitwiseXOR(F.lit(TURN)).alias("lo")))


def _reversed_bases(word: str) -> str:
    """SQL of a word of 32 bases with their order turned round: neighbours are swapped, then pairs, and so on."""
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        word = f"(shiftleft({word} & {mask}L, {bits}) | (shiftrightunsigned({word}, {bits}) & {mask}L))"
    return f"(shiftleft({word}, 32) | shiftrightunsigned({word}, 32))"


def reverse_complement(kmer: str, k: int) -> Column:
    """The reverse complement of `kmer`, which is SQL."""
    if k <= SINGLE:
        return F.expr(f"shiftrightunsigned(~{_reversed_bases(kmer)}, {2 * (WORD - k)})")
    rest, last = k - WORD, f"({kmer}.lo ^ (-9223372036854775807L - 1L))"  # the last 32 bases; the rest are in front
    first = f"(shiftleft({kmer}.hi, {2 * (WORD - rest)}) | shiftrightunsigned({last}, {2 * rest}))" if rest else last
    hi = f"shiftrightunsigned(~{_reversed_bases(last)}, {2 * (WORD - rest)})" if rest else "0L"
    return F.expr(f"named_struct('hi', {hi}, 'lo', ~{_reversed_bases(first)} ^ (-9223372036854775807L - 1L))")


def canonical(kmer: str, k: int) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(F.col(kmer), reverse_complement(kmer, k))
