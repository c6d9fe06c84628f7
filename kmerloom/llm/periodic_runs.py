"""Periodic runs of words by block matching, and texts without the repetitions.

A run is a maximal stretch of words with smallest period q and at least four periods (and six words). For each power of
two b, a run with b <= q < 2b holds a whole aligned block of b words whose copy stands q words on. So the aligned
blocks of b words are the keys, as sequences of up to 16 numbers of words or of equal
parts, of an Aho-Corasick automaton, the document is searched for them, and each occurrence b to 2b - 1 words after a block seeds an exact extension to both sides with their distance as the
period. Each document is one row of one task; nothing is shuffled.

What keeps this near linear: a run of that scale shows in at least 2b + 1 successive places whose next few words come
again within 2b words, so only such stretches are searched (hashes of these words only widen a stretch, they never narrow
it); the inside of runs already found is left out, since runs of larger periods reach into it by less than 4b words; and
seeds that lie in a found run whose period divides their distance are passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least words of a run, and least periods.
LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Words that are hashed together to find stretches; below this scale all distances are compared instead.
GRAM = 4
#: Numbers of a key: a block of more words is a sequence of so many names of its equal parts.
KEY = 16

ROWS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def recurs_at_once(ids: np.ndarray, size: int) -> np.ndarray:
    """For each place whether its `size` words begin again less than 2 * size words on; `size` is a small power of two."""
    out = np.zeros(len(ids), bool)
    for d in range(1, 2 * size):
        same, width = ids[:-d] == ids[d:], 1
        while width < size:
            same, width = same[:-width] & same[width:], 2 * width
        out[: len(same)] |= same
    return out


def recurs_after(ids: np.ndarray) -> np.ndarray:
    """For each place the distance to the next place where the same GRAM words begin, by hash; very large where there is none."""
    n = len(ids) - GRAM + 1
    out = np.full(max(n, 0), 1 << 40, np.int64)
    if n > 1:
        hashes = np.zeros(n, np.uint64)
        for j in range(GRAM):
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[j : j + n].astype(np.uint64)
        low = np.uint64((1 << n.bit_length()) - 1)  # the place, below the hash's other bits
        order = np.sort((hashes ^ (hashes >> np.uint64(31))) & ~low | np.arange(n, dtype=np.uint64))
        same = (order[1:] ^ order[:-1]) & ~low == 0
        place = (order & low).astype(np.int64)
        out[place[:-1][same]] = (place[1:] - place[:-1])[same]
    return out


def stretches(near: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal [first, end) of true places, of at least `least`."""
    if np.count_nonzero(near) < least:
        return []
    bounded = np.concatenate([[False], near, [False]])
    edge = np.flatnonzero(bounded[1:] != bounded[:-1])
    first, end = edge[::2], edge[1::2]
    fit = end - first >= least
    return list(zip(first[fit].tolist(), end[fit].tolist(), strict=True))


def names(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for the `width` (a power of two) words from each place on, equal for equal words only: names of halves, paired."""
    done = 1
    while done < width:
        pairs = ids[:-done].astype(np.int64) << 32 | ids[done:]
        ids = np.unique(pairs, return_inverse=True)[1]
        done *= 2
    return ids


def matched_blocks(ids: np.ndarray, first: int, end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of aligned blocks of `size` words in [first, end) and their occurrences size to 2 * size - 1 words after them."""
    places = np.arange(-(-first // size) * size, end - size + 1, size)
    if not len(places):
        return places, places
    width = max(1, size // KEY)
    named = names(ids[first:end], width)
    blocks, owners = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), []
    for p in places.tolist():
        key = tuple(named[p - first : p - first + size : width].tolist())
        k = blocks.get(key, -1)
        if k < 0:
            k = len(owners)
            blocks.add_word(key, k)
            owners.append([])
        owners[k].append(p)
    blocks.make_automaton()
    found: list[list[int]] = [[] for _ in owners]
    back = first - (size // width - 1) * width
    for phase in range(width):
        for last, k in blocks.iter(tuple(named[phase::width].tolist())):
            found[k].append(back + phase + last * width)
    seeds, distances = [], []
    for at, where in zip(owners, found, strict=True):
        at, where = np.asarray(at), np.sort(where)
        low, high = np.searchsorted(where, at + size), np.searchsorted(where, at + 2 * size)
        n = high - low
        if n.any():
            place = np.repeat(at, n)
            seeds.append(place)
            distances.append(where[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)] - place)
    return (np.concatenate(seeds), np.concatenate(distances)) if seeds else (places[:0], places[:0])


def _agreeing(ids: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words from a and b on (step 1) or before them (step -1) agree, up to `most`."""
    done, width = 0, 32
    while done < most:
        n = min(width, most - done)
        x, y = (ids[a + done : a + done + n], ids[b + done : b + done + n]) if step > 0 else (ids[a - done - n : a - done][::-1], ids[b - done - n : b - done][::-1])
        other = x != y
        if other.any():
            return done + int(other.argmax())
        done, width = done + n, width * 2
    return most


def extended(ids: np.ndarray, place: int, distance: int) -> tuple[int, int]:
    """The maximal [start, end) around `place` in which words `distance` apart are equal; words place and place + distance are."""
    right = _agreeing(ids, place, place + distance, len(ids) - place - distance, 1)
    left = _agreeing(ids, place, place + distance, place, -1)
    return place - left, place + distance + right


def smallest(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no smaller period fits [start, end), of two periods at least: one would divide `period`."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            part = period // prime
            if np.array_equal(ids[start : end - part], ids[start + part : end]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers below 2**32, by start and period."""
    n, size, found, again = len(ids), 1, [], None
    longest = np.full(n, -1, np.int64)  # the longest run found so far over each word
    while LEAST_PERIODS * size <= n:
        gram = min(size, GRAM)
        if size < GRAM:
            near = recurs_at_once(ids, size)
        else:
            again = recurs_after(ids) if again is None else again
            near = again < 2 * size
            if np.count_nonzero(again < n) <= 2 * size:
                break  # no stretch of this scale or a larger one
        for start, length, _ in found:
            near[start + 4 * size : max(start + 4 * size, start + length - 4 * size)] = False
        here: dict[tuple[int, int], int] = {}
        table = np.asarray(found, np.int64).reshape(-1, 3)
        for first, end in stretches(near, 2 * size + 1):
            if (r := longest[first]) >= 0 and table[r, 0] <= first and end + gram - 1 <= table[r, 0] + table[r, 1]:
                continue  # a run that shows only inside another of smaller period is that one
            place, apart = matched_blocks(ids, first, min(n, end + gram - 1 + 2 * size), size)
            if len(table):
                known = table[longest[place]]
                inside = (longest[place] >= 0) & (known[:, 0] <= place) & (place + apart + size <= known[:, 0] + known[:, 1]) & (apart % known[:, 2] == 0)
                place, apart = place[~inside], apart[~inside]
            done: dict[int, int] = {}  # by distance, where its last extension ends
            for p, d in sorted(zip(place.tolist(), apart.tolist(), strict=True)):
                if done.get(d, 0) < p + d + size:
                    start, stop = extended(ids, p, d)
                    done[d] = stop
                    if stop - start >= max(LEAST_LENGTH, LEAST_PERIODS * d) and (start, d) not in here and smallest(ids, start, stop, d):
                        here[start, d] = stop - start
        for (start, period), length in here.items():
            over = longest[start : start + length]
            lengths = np.where(over >= 0, np.asarray([x[1] for x in found] or [0])[over], 0)
            over[lengths < length] = len(found)
            found.append((start, length, period))
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_tail(ids: np.ndarray, words: list[bytes], doc_id: int) -> tuple[np.ndarray, list[bytes]]:
    """The words of the query's test bed: in a tenth of all documents, by a hash of the doc_id, a tail repeats its first words."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return ids, words
    n, g = len(words), h // 10
    a = g % n
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return ids[place], [words[i] for i in place.tolist()]


def described(words: list[bytes], ids: np.ndarray) -> tuple:
    """ROWS of one text, without its doc_id."""
    every = runs(ids)
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in every:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in every).encode()).hexdigest()
    kept = words
    if every:
        kept = [words[i] for i in np.flatnonzero(np.cumsum(dropped)[:-1] == 0).tolist()]
    collapsed = hashlib.sha256(b" ".join(kept)).hexdigest()
    best = None
    for r in every:  # by start and period, so the first of equals stays
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (len(every), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, listed, collapsed)


def collapsed(docs: DataFrame, planted: bool = False) -> DataFrame:
    """The runs of each whole text of `docs` (doc_id, text), and digests of all of them and of the words outside repetitions; one row per row.

    `planted` repeats tails first, see repeated_tail(); a row without a doc_id keeps its words as they are. Null and empty
    texts have no words. The greatest run is the one of most periods, on ties the first, then the one of the smaller period.
    Repeated rows are read each for itself; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = text.as_py().split()  # of bytes: at space and \\t..\\r
                ids = numbered(words)
                if planted and doc_id is not None:
                    ids, words = repeated_tail(ids, words, doc_id)
                rows.append(described(words, ids))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in ROWS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ROWS)
