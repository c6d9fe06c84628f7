"""Segments, k-mers and super-k-mers of sequences: (seq_id, seq) in, one pass, no shuffle.

A segment is a maximal run of bases; whatever is not a base breaks, and no k-mer spans a break. Segments of a sequence
are numbered by the breaks before them. Batches of sequences are worked on end to end as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import dna, packed
from kmerloom.plans.config import Options

SUPER_KMERS = "seq_id long, seg_id long, start long, ap long, minimizer string, p1 int, size int, bases string"
PACKED_SUPER_KMERS = "seq_id long, seg_id long, start long, ap long, minimizer long, p1 int, size int, words array<long>"
KMERS = "seq_id long, seg_id long, pos long, kmer string"
TILES = "seq_id long, seg_id long, tile_start long, n_kmers long, seg string"
SEGMENTS = "seq_id long, seg_id long, seg_start long, seg string"
#: K-mers and bases that are made at a time, however long a sequence is.
PIECE = 1 << 18


def _chunks(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, bounds) of about `limit` bytes of sequences, one sequence at least."""
    for batch in batches:
        column = batch.column(1).cast(pa.large_string()).fill_null("")
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield ids[at:end], every[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
            at = end


class _Batch:
    """Codes of a batch and its segments: where each begins and ends, its sequence and number."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.code = dna.CODE_OF_BYTE[data]
        n = len(data)
        base = np.zeros(n + 2, np.int8)
        base[1:-1] = self.code != dna.BREAK
        edge = np.diff(base)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cuts = bounds[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
        cuts = cuts[(base[cuts] == 1) & (base[cuts + 1] == 1)]
        self.begin, self.end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
        self.seq = np.searchsorted(bounds, self.begin, "right") - 1
        first = np.searchsorted(self.begin, bounds[:-1])
        leading = np.zeros(len(bounds) - 1, np.int64)
        some = first < np.searchsorted(self.begin, bounds[1:])
        leading[some] = self.begin[first[some]] > bounds[:-1][some]  # a break at the start is an empty segment 0
        self.number = np.arange(len(self.begin)) - first[self.seq] + leading[self.seq]
        self.offset = self.begin - bounds[self.seq]

    def text(self, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Substrings as an Arrow column."""
        total = np.concatenate([[0], np.cumsum(lengths)])
        if len(starts) == 1:
            letters = dna.BASES[self.code[starts[0] : starts[0] + lengths[0]]]
        else:
            letters = dna.BASES[self.code[np.arange(total[-1]) - np.repeat(total[:-1], lengths) + np.repeat(starts, lengths)]]
        made = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(total.astype(np.int64)), pa.py_buffer(letters))
        return made.cast(pa.string())


def _pieces(counts: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, first, number) that cover counts[i] items of each owner i, about `limit` items at a time; large owners come in pieces."""
    owner, nth = _spread(np.zeros(len(counts), np.int64), -(-counts // limit))
    first = nth * limit
    number = np.minimum(limit, counts[owner] - first)
    ends = np.cumsum(number)
    at = 0
    while at < len(owner):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield owner[at:end], first[at:end], number[at:end]
        at = end


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, start + 0, 1, ..) for counts[i] items of each owner i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f[0] for f in fields])


def _contigs(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("seq"))


def segments(contigs: DataFrame, k: int = 1) -> DataFrame:
    """(seq_id, seg_id, seg_start, seg): the segments of at least k bases. A null sequence has none."""

    def run(batches):
        for ids, data, bounds in _chunks(batches):
            b = _Batch(data, bounds)
            fit = np.flatnonzero(b.end - b.begin >= k)
            ends = np.cumsum((b.end - b.begin)[fit])
            at = 0
            while at < len(fit):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
                f, at = fit[at:end], end
                yield _batch(SEGMENTS, ids[b.seq[f]], b.number[f], b.offset[f], b.text(b.begin[f], (b.end - b.begin)[f]))

    return _contigs(contigs).where("seq_id is not null").mapInArrow(run, SEGMENTS)


def _each_kmer(contigs: DataFrame, k: int, tile: int | None, schema: str, made) -> DataFrame:
    """Rows of `schema` for the k-mers, whose last column made(batch, places) gives, about PIECE at a time."""

    def rows(b: _Batch, ids: np.ndarray, numbers: np.ndarray, starts: np.ndarray):
        """Of a batch whose segments have these ids, numbers and first places."""
        for owner, first, number in _pieces(np.maximum(b.end - b.begin - k + 1, 0), PIECE):
            o, at = _spread(first + b.begin[owner], number)
            own = owner[o]
            yield _batch(schema, ids[own], numbers[own], at - b.begin[own] + starts[own], made(b, at))

    def run(batches):
        for ids, data, bounds in _chunks(batches, PIECE):
            b = _Batch(data, bounds)
            yield from rows(b, ids[b.seq], b.number, np.zeros(len(b.seq), np.int64))

    def run_tiles(batches):
        for batch in batches:
            seq_id, seg_id, start = (batch.column(i).to_numpy() for i in range(3))
            for b, row in _tile_batches(batch):
                yield from rows(b, seq_id[row], seg_id[row], start[row])

    if tile is None:
        return _contigs(contigs).where("seq_id is not null").mapInArrow(run, schema)
    return _spread_tiles(contigs, k, tile).mapInArrow(run_tiles, schema)


def kmers(contigs: DataFrame, k: int, tile: int | None = None) -> DataFrame:
    """(seq_id, seg_id, pos, kmer): every k-mer with its place in its segment, as text. `tile` as in packed_kmers()."""
    return _each_kmer(contigs, k, tile, KMERS, lambda b, at: b.text(at, np.full(len(at), k)))


def packed_kmers(contigs: DataFrame, k: int, tile: int | None = None) -> DataFrame:
    """kmers() with k-mers as numbers, see functions.packed. `tile` cuts sequences into tiles of so many k-mers that spread over all tasks."""

    def made(b: _Batch, at: np.ndarray) -> pa.Array:
        low, high = int(at[0]), int(at[-1]) + k  # the places ascend
        return packed.kmers_at(packed.words_at(b.code[low:high]), at - low, k)

    return _each_kmer(contigs, k, tile, KMERS.replace("kmer string", f"kmer {packed.sql_type(k)}"), made)


def kmer_counts(contigs: DataFrame, k: int) -> DataFrame:
    """(seq_id, n_kmers) of every sequence, without making the k-mers."""
    return segments(contigs, k).groupBy("seq_id").agg(F.sum(F.length("seg") - (k - 1)).cast("long").alias("n_kmers"))


def _mmers(code: np.ndarray, m: int) -> np.ndarray:
    return packed.prefixes(packed.words_at(code)[: max(0, len(code) - m + 1)], m)


def _reversed(mmers: np.ndarray, m: int) -> np.ndarray:
    out, left = np.zeros_like(mmers), mmers.copy()
    for _ in range(m):
        out = (out << dna.U64(2)) | (dna.U64(3) - (left & dna.U64(3)))
        left >>= dna.U64(2)
    return out


def tiles(contigs: DataFrame, k: int, tile: int, before: int = 0, after: int = 0) -> DataFrame:
    """Segments of at least k bases in tiles of up to `tile` k-mers: (seq_id, seg_id, tile_start, n_kmers, seg); n_kmers is of the whole segment.

    Tiles overlap by k - 1 bases; with `before` and `after` they hold so many k-mers of their neighbours too.
    """

    def run(batches):
        for ids, data, bounds in _chunks(batches):
            b = _Batch(data, bounds)
            n = np.maximum(b.end - b.begin - k + 1, 0)
            owner, t = _spread(np.zeros(len(n), np.int64), -(-n // tile))
            start = t * tile
            few = max(1, (PIECE << 3) // (tile + before + after + k))  # a batch of tiles at a time
            for s in range(0, len(owner), few):
                o, a = owner[s : s + few], start[s : s + few]
                first, end = np.maximum(0, a - before), np.minimum(n[o], a + tile + after)
                yield _batch(TILES, ids[b.seq[o]], b.number[o], a, n[o], b.text(b.begin[o] + first, end - first + k - 1))

    return _contigs(contigs).where("seq_id is not null").mapInArrow(run, TILES)


def _spread_tiles(contigs: DataFrame, k: int, tile: int, before: int = 0, after: int = 0) -> DataFrame:
    return tiles(contigs, k, tile, before, after).repartition(int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _tile_batches(batch: pa.RecordBatch) -> Iterator[tuple[_Batch, np.ndarray]]:
    """The tiles of a batch, some at a time, each one segment: their codes, and the row of each."""
    at = 0
    for _, data, bounds in _chunks(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(4)], names=["seq_id", "seq"])])):
        b = _Batch(data, bounds)
        yield b, at + b.seq
        at += len(bounds) - 1


def _least(order: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of the w values from each place on, the leftmost on ties; by doubling windows."""
    best, place, done = order, np.arange(len(order)), 1
    while done < w:
        step = min(done, w - done)
        n = len(best) - step
        less = best[step:] < best[:n]  # strictly, so the leftmost stays
        best, place = np.where(less, best[step:], best[:n]), np.where(less, place[step:], place[:n])
        done += step
    return place


def _runs(batch: _Batch, options: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first k-mer, minimizer place, size, minimizer) of the super-k-mers of a batch; places are offsets in it."""
    k, m, w = options.k, options.m, options.window
    mmer = _mmers(batch.code, m)
    if options.canonical:
        mmer = np.minimum(mmer, _reversed(mmer, m))
    owner, at = _spread(batch.begin, np.maximum(batch.end - batch.begin - k + 1, 0))
    place = _least(dna.HASHERS[options.hasher](mmer, options.seed), w)[at] if len(at) else at
    opens = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))[: len(at)])
    ap = place[opens]
    return owner[opens], at[opens], ap, np.diff(np.append(opens, len(at))), mmer[ap]


def _super_kmers(contigs: DataFrame, options: Options, tile: int | None, schema: str, named, bases) -> DataFrame:
    """Rows of `schema`: named(minimizers) and bases(batch, first, length) give the columns that differ."""
    k, w = options.k, options.window

    def rows(b: _Batch, seq_id, seg_id, lead, start, most):
        """Of a batch whose segments have these ids; runs from k-mer `lead` on, below `most`, count; `start` is the place of k-mer 0."""
        own, first, ap, size, minimizer = _runs(b, options)
        at = first - b.begin[own]
        mine = (at >= lead[own]) & (at < most[own])
        own, first, ap, size, at, minimizer = own[mine], first[mine], ap[mine], size[mine], at[mine], minimizer[mine]
        from_ = start[own]
        columns = seq_id[own], seg_id[own], at + from_, ap - b.begin[own] + from_, named(minimizer), (ap - first).astype(np.int32), size.astype(np.int32), bases(b, first, size + k - 1)
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches):
        for ids, data, bounds in _chunks(batches):
            b = _Batch(data, bounds)
            none = np.zeros(len(b.seq), np.int64)
            yield rows(b, ids[b.seq], b.number, none, none, b.end - b.begin)

    def run_tiles(batches):
        for batch in batches:
            seq_id, seg_id, tile_start = (batch.column(i).to_numpy() for i in range(3))
            for b, row in _tile_batches(batch):
                lead = np.minimum(1, tile_start[row])
                yield rows(b, seq_id[row], seg_id[row], lead, tile_start[row] - lead, lead + tile)

    if tile is None:
        return _contigs(contigs).where("seq_id is not null").mapInArrow(run, schema)
    # a run belongs to the tile of its first k-mer: one k-mer before tells whether it begins there, and it has w k-mers at most
    return _spread_tiles(contigs, k, tile, 1, w).mapInArrow(run_tiles, schema)


def super_kmers(contigs: DataFrame, options: Options, tile: int | None = None) -> DataFrame:
    """(seq_id, seg_id, start, ap, minimizer, p1, size, bases): maximal runs of k-mers with one minimizer occurrence.

    A k-mer's minimizer is its m-mer of least hash, the leftmost on ties; `ap` is its place in the segment, `p1` its place
    in the first k-mer of the run, `start` the place of that k-mer, `size` the number of k-mers, `bases` their text. With
    options.canonical an m-mer and its reverse complement have one hash and one minimizer, the lesser of both.

    With `tile`, sequences are cut into tiles of so many k-mers and spread over all tasks, for sequences as long as
    chromosomes. The rows are the same.
    """
    shifts = dna.U64(2) * np.arange(options.m - 1, -1, -1, dtype=dna.U64)

    def named(minimizers: np.ndarray) -> pa.Array:
        letters = dna.BASES[((minimizers[:, None] >> shifts) & dna.U64(3)).astype(np.int64)]
        return pa.StringArray.from_buffers(len(minimizers), pa.py_buffer((np.arange(len(minimizers) + 1) * options.m).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))

    return _super_kmers(contigs, options, tile, SUPER_KMERS, named, lambda b, first, length: b.text(first, length))


def packed_super_kmers(contigs: DataFrame, options: Options, tile: int | None = None) -> DataFrame:
    """super_kmers() with minimizers as numbers and, in place of `bases`, `words`: 32 bases each, see functions.packed."""

    def words(b: _Batch, first: np.ndarray, length: np.ndarray) -> pa.Array:
        owner, at = _spread(first, -(-length // packed.WORD))
        at += (packed.WORD - 1) * (at - first[owner])
        offsets = np.concatenate([[0], np.cumsum(-(-length // packed.WORD))]).astype(np.int32)
        made = packed.words_at(b.code)[at]
        beyond = (2 * (-length % packed.WORD)).astype(dna.U64)
        made[offsets[1:] - 1] &= ~dna.U64(0) << beyond  # bases behind a run are none of its own, so runs that read the same are equal
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.view(np.int64)))

    return _super_kmers(contigs, options, tile, PACKED_SUPER_KMERS, lambda x: pa.array(x.view(np.int64)), words)
