"""Suffix-array dedup by bucket-pointer refinement: bytes covered by a 100-byte string that starts earlier are removed.

Every 100-byte window has an anchor: of the 24-byte grams in it the one with the least hash, the leftmost on ties. Equal
windows have equal anchors at the same offset, and neighbouring windows mostly share one, so a text has an anchor for
every 39 bytes or so, with a run of windows.

1. Texts that equal an earlier document's are removed whole and take no further part.
2. Anchor hashes are dealt by bucket (16 bytes each). Those that occur once have no repeated window and leave.
3. For the others the bytes of their runs of windows are dealt by anchor. Equal runs are settled within the sending task
   and again on arrival, which keeps passages that very many documents share small.
4. What remains is sorted by bucket-pointer refinement: suffixes of an anchor's runs begin in buckets of their first bytes;
   a bucket is refined by sorting on the pointers to the buckets at the offset that its suffixes have in common, its parts' pointers are
   written at once, and refinement goes on into the parts. Of equal windows, neighbours in the end, the earliest stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import textvec as V
from kmerloom.llm.common import in_chunks, shuffle_partitions, utf8_parts
from kmerloom.llm.jaccard_join import ranges

WINDOW, GRAM, QGRAM = 100, 24, 7
SPREAD = WINDOW - GRAM + 1
LAST = (1 << 63) - 1  # the place of rows without a doc_id
ANCHORS = "bucket int, hashes binary, rids binary"
SEEDS = "rid long, hashes binary"
RUNS = "bucket int, anchors binary, ids binary, rids binary, starts binary, lengths binary, runs binary, found boolean"
FOUND = "rid long, starts binary, ends binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, text, first window start, last window start) of each anchor of a batch of texts; starts are offsets in `data`."""
    n = len(data)
    size = np.diff(bounds)
    fit = np.flatnonzero(size >= WINDOW)
    if not len(fit):
        return np.zeros(0, V.U64), *(np.zeros(0, np.int64) for _ in range(3))
    prefix = V.prefix_hash(data)
    grams = V.mix((prefix[GRAM:] - prefix[:-GRAM]) * V.powers(n + 1)[1][: n + 1 - GRAM])
    # sliding minimum of (hash, position) by minima from both ends of blocks as long as the window
    m = len(grams)
    padded = np.full(-(-m // SPREAD) * SPREAD, np.iinfo(np.uint64).max, V.U64)
    padded[:m] = ((grams >> V.U64(32)) << V.U64(32)) | np.arange(m, dtype=V.U64)
    blocks = padded.reshape(-1, SPREAD)
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    sofar = np.minimum.accumulate(blocks, axis=1).ravel()
    start = ranges(bounds[:-1][fit], size[fit] - WINDOW + 1)
    doc = np.repeat(fit, size[fit] - WINDOW + 1)
    at = (np.minimum(onward[start], sofar[start + SPREAD - 1]) & V.U64(0xFFFFFFFF)).astype(np.int64)
    opens = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
    closes = np.append(opens[1:], len(at)) - 1
    return grams[at[opens]], doc[opens], start[opens], start[closes]


def buckets_of(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The order by bucket, and (bucket, from, to) of each bucket in it."""
    bucket = (hashes % V.U64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket))
    return order, bucket, [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def joined(columns: list, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(columns), kind)


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the anchor hashes of these buckets that occur twice or more."""
    hashes, rids = [], []
    for batch in batches:
        hashes += batch.column(1).to_pylist()
        rids += batch.column(2).to_pylist()
    hashes, rids = joined(hashes, np.uint64), joined(rids, np.int64)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(hashes), bool)
    twice[1:] |= same
    twice[:-1] |= same
    own = order[twice]
    own = own[np.argsort(rids[own], kind="stable")]
    rid = rids[own]
    cuts = np.append(np.flatnonzero(np.append(True, rid[1:] != rid[:-1])[: len(rid)]), len(rid))
    rows = [(int(rid[a]), hashes[own[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for s in range(0, len(rows), 5000):
        yield batch_of(rows[s : s + 5000], SEEDS)


def intervals(rids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """Rows of FOUND: the removed byte ranges [start, end) by text."""
    order = np.argsort(rids, kind="stable")
    rids, starts, ends = rids[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, rids[1:] != rids[:-1])[: len(rids)]), len(rids))
    return [(int(rids[a]), starts[a:b].tobytes(), ends[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def settled(ids: np.ndarray, starts: np.ndarray, rids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs are the earliest (by document and start) of their key, and which are later ones of a key.

    A run that comes twice because its whole row does is neither the second time.
    """
    order = np.lexsort((rids, starts, ids, keys))
    new = np.append(True, keys[order][1:] != keys[order][:-1])[: len(keys)]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    itself = (ids[order] == ids[first]) & (starts[order] == starts[first]) & (rids[order] == rids[first])
    earliest, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earliest[order], later[order] = new, ~itself
    return earliest, later


def suffix_buckets(text: np.ndarray, begin: np.ndarray, length: np.ndarray, group: np.ndarray, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of buckets, bucket pointer of each position): suffixes of the runs of `text` (begin, length), each run for itself, in groups.

    Bucket-pointer refinement. Initial buckets have a group and the first QGRAM bytes in common; a bucket's pointer is its
    first place, so pointers are in the order of the suffixes. A bucket whose suffixes have d bytes in common is sorted by the pointers at
    offset d. The parts that this leaves have as many more bytes in common as the buckets pointed at, and their pointers are
    written back at once: buckets refined later, those of the recursion into the parts first, go by the finer ones. Buckets of
    WINDOW bytes, or with less than two suffixes that are so long, aren't refined further. `chunk` suffixes are sorted at a time.
    """
    n = len(text)
    owner = np.repeat(np.arange(len(begin)), length)
    left = np.repeat(begin + length, length) - np.arange(n)  # bytes from here to the run's end
    symbols = np.append(text.astype(np.uint64) + V.U64(1), np.zeros(QGRAM, V.U64))
    gram = np.zeros(n, V.U64)
    for j in range(QGRAM):
        gram = gram * V.U64(257) + np.where(left > j, symbols[j : j + n], V.U64(0))
    order = np.lexsort((gram, group[owner]))
    fresh = np.append(True, (gram[order][1:] != gram[order][:-1]) | (group[owner[order]][1:] != group[owner[order]][:-1]))[:n]
    starts = np.flatnonzero(fresh)
    pointer = np.empty(n, np.int64)
    pointer[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    depth = np.full(n, QGRAM, np.int64)  # common bytes of the bucket that begins at a place
    window = left >= WINDOW

    def unfinished(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = (sizes > 1) & (depth[starts] < WINDOW)
        starts, sizes = starts[some], sizes[some]
        if len(starts):
            several = np.add.reduceat(window[order[ranges(starts, sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64) > 1
            starts, sizes = starts[several], sizes[several]
        return starts, sizes

    stack = [unfinished(starts, np.diff(np.append(starts, n)))]
    while stack:
        starts, sizes = stack.pop()
        if not len(starts):
            continue
        total = np.cumsum(sizes)
        k = max(1, int(np.searchsorted(total, chunk, "right")))
        if k < len(starts):
            stack.append((starts[k:], sizes[k:]))
            starts, sizes = starts[:k], sizes[:k]
        places, bucket = ranges(starts, sizes), np.repeat(starts, sizes)
        member, common = order[places], np.repeat(depth[starts], sizes)
        target = np.where(left[member] > common, pointer[np.minimum(member + common, n - 1)], -1)
        sort = np.lexsort((target, bucket))
        member, target = member[sort], target[sort]
        first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (target[1:] != target[:-1])))
        more = np.where(target[first] < 0, WINDOW, depth[np.maximum(target[first], 0)])
        parts, part_sizes = places[first], np.diff(np.append(first, len(places)))
        order[places] = member
        pointer[member] = np.repeat(parts, part_sizes)
        depth[parts] = common[first] + more
        stack.append(unfinished(parts, part_sizes))
    return order, pointer


def repeated_windows(text: np.ndarray, begin: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, window in it) of every 100-byte window that an earlier run of its group has. Runs come in order of document and start.

    Windows that are equal stand together in the order of suffixes: in a bucket, or in neighbouring ones that differ
    beyond the window.
    """
    owner = np.repeat(np.arange(len(begin)), length)
    order, pointer = suffix_buckets(text, begin, length, group)
    at = order[(np.repeat(begin + length, length) - np.arange(len(text)))[order] >= WINDOW]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = V.spans_hash(V.prefix_hash(text), at, at + WINDOW)
    same = (group[owner[at]][1:] == group[owner[at]][:-1]) & ((pointer[at][1:] == pointer[at][:-1]) | (hashes[1:] == hashes[:-1]))
    first = np.flatnonzero(np.append(True, ~same))
    earliest = np.repeat(np.minimum.reduceat(at, first), np.diff(np.append(first, len(at))))
    at = np.sort(at[at != earliest])
    return owner[at], at - begin[owner[at]]


def refined(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The removed byte ranges that the runs dealt to this task show; `limit` bytes of whole groups are refined at a time."""
    parts: list[list] = [[] for _ in range(6)]
    for batch in batches:
        done = batch.column(7).to_pylist()
        columns = [c.to_pylist() for c in batch.columns[1:7]]
        for i, over in enumerate(done):
            if over:  # settled by the sender: only to be passed on
                starts, lengths = np.frombuffer(columns[3][i], np.int64), np.frombuffer(columns[4][i], np.int32)
                yield batch_of(intervals(np.frombuffer(columns[2][i], np.int64), starts, starts + lengths), FOUND)
            else:
                for part, column in zip(parts, columns, strict=True):
                    part.append(column[i])
    kinds = [np.uint64, np.int64, np.int64, np.int64, np.int32, np.uint8]
    anchor, ids, rids, starts, lengths, runs = (joined(p, k) for p, k in zip(parts, kinds, strict=True))
    if not len(anchor):
        return
    del parts
    lengths = lengths.astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    order = np.lexsort((rids, starts, ids, anchor))
    cut = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1]))
    sizes = np.add.reduceat(lengths[order], cut)
    total = np.cumsum(sizes)
    cut = np.append(cut, len(order))
    g = 0
    while g < len(sizes):
        h = max(g + 1, int(np.searchsorted(total, (total[g - 1] if g else 0) + limit, "right")))
        own = order[cut[g] : cut[h]]
        text = runs[ranges(begin[own], lengths[own])]
        at = np.cumsum(lengths[own]) - lengths[own]
        prefix = V.prefix_hash(text)
        keys = V.mix(V.spans_hash(prefix, at, at + lengths[own]) ^ anchor[own])
        earliest, later = settled(ids[own], starts[own], rids[own], keys)
        if later.any():
            done = own[later]
            yield batch_of(intervals(rids[done], starts[done], starts[done] + lengths[done]), FOUND)
        own = own[earliest]
        group = np.cumsum(np.append(0, anchor[own][1:] != anchor[own][:-1]))
        several = np.bincount(group)[group] > 1
        own, group = own[several], group[several]
        if len(own):
            text = runs[ranges(begin[own], lengths[own])]
            run, window = repeated_windows(text, np.cumsum(lengths[own]) - lengths[own], lengths[own], group)
            if len(run):
                s = starts[own][run] + window
                breaks = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (window[1:] != window[:-1] + 1)))
                ends = np.append(breaks[1:], len(s)) - 1
                yield batch_of(intervals(rids[own][run[breaks]], s[breaks], s[ends] + WINDOW), FOUND)
        g = h


def cut_out(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left) for removed ranges in any order."""
    if not len(starts):
        return 0, 0, data
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.subtract.at(cover, ends, 1)
    gone = np.cumsum(cover[:-1]) > 0
    return int(gone.sum()), int(np.count_nonzero(gone & ~np.append(False, gone[:-1]))), np.frombuffer(data, np.uint8)[~gone].tobytes()


def deduped(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of `docs` (doc_id, text), texts as UTF-8 bytes.

    A byte is removed if a 100-byte string of its text covers it that also starts earlier: in a document of a smaller
    doc_id, or in the same document before. Matches don't cross documents and are judged on the input. A null text counts
    as empty. Rows without a doc_id come after all others; rows that repeat a doc_id are ordered by the places of their
    strings, then by a hash of the row; wholly equal rows count as one and are each returned. Other columns are ignored. An empty table gives an empty result.
    """
    parts = shuffle_partitions(docs)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    firsts = given.select(F.md5(F.col("text").cast("binary")).alias("digest"), F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "rid").groupBy("digest").agg(F.min(F.struct("rank", "rid")).alias("first")).select(F.col("first.rid").alias("rid"))
    # All uses read the same columns, so that the texts are dealt once.
    texts = given.join(firsts.withColumn("is_first", F.lit(True)), "rid", "left").select("rid", "doc_id", "text", F.coalesce("is_first", F.lit(False)).alias("is_first"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 1 << 20):
            hashes, doc, _, _ = anchors(*utf8_parts(batch.column(1)))
            rids = batch.column(0).to_numpy()[doc]
            order, _, cuts = buckets_of(hashes, 4 * parts)
            hashes, rids = hashes[order], rids[order]
            yield batch_of([(k, hashes[a:b].tobytes(), rids[a:b].tobytes()) for k, a, b in cuts], ANCHORS)

    seeds = texts.where("is_first").select("rid", "text", "doc_id").mapInArrow(deal, ANCHORS).repartition(parts, "bucket").mapInArrow(repeated, SEEDS).groupBy("rid").agg(F.collect_list("hashes").alias("seeds"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 2 << 20):
            data, bounds = utf8_parts(batch.column(1))
            hashes, doc, start, stop = anchors(data, bounds)
            rid, rank = batch.column(0).to_numpy(), batch.column(2).fill_null(LAST).to_numpy()
            wanted = [joined(x, np.uint64) for x in batch.column(3).to_pylist()]
            mine = np.zeros(len(hashes), bool)
            edge = np.searchsorted(doc, np.arange(len(bounds)))
            for i, seeds_of in enumerate(wanted):
                own = slice(edge[i], edge[i + 1])
                mine[own] = np.isin(hashes[own], seeds_of)
            hashes, doc, start, stop = hashes[mine], doc[mine], start[mine], stop[mine]
            length = stop - start + WINDOW
            ids, rids, offsets = rank[doc], rid[doc], start - bounds[doc]
            keys = V.mix(V.spans_hash(V.prefix_hash(data), start, start + length) ^ hashes)
            earliest, later = settled(ids, offsets, rids, keys)
            rows = []
            if later.any():
                rows.append((int(hashes[later][0] % V.U64(4 * parts)), b"", b"", rids[later].tobytes(), offsets[later].tobytes(), length[later].astype(np.int32).tobytes(), b"", True))
            stay = np.flatnonzero(earliest)
            order, _, cuts = buckets_of(hashes[stay], 4 * parts)
            stay = stay[order]
            for k, a, b in cuts:
                own = stay[a:b]
                rows.append((k, hashes[own].tobytes(), ids[own].tobytes(), rids[own].tobytes(), offsets[own].tobytes(), length[own].astype(np.int32).tobytes(), data[ranges(start[own], length[own])].tobytes(), False))
            yield batch_of(rows, RUNS)

    found = (
        texts.where("is_first").join(seeds, "rid").select("rid", "text", "doc_id", "seeds").mapInArrow(runs, RUNS)
        .repartition(parts, "bucket").mapInArrow(refined, FOUND)
        .groupBy("rid").agg(F.collect_list(F.struct("starts", "ends")).alias("found"))
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, is_first, found_ in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = text.encode()
                if not is_first:
                    starts, ends = (np.array([0]), np.array([len(data)])) if len(data) >= WINDOW else (np.zeros(0, int), np.zeros(0, int))
                else:
                    starts, ends = (joined([x[k] for x in found_ or ()], np.int64) for k in ("starts", "ends"))
                n, spans, kept = cut_out(data, starts, ends)
                rows.append((len(data), n, spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True))], names=[x.split()[0] for x in RESULT.split(", ")])

    return texts.join(found, "rid", "left").select("doc_id", "text", "is_first", "found").mapInArrow(remove, RESULT)
