"""N-gram Jaccard join by signature trees, exact, and the components of its links.

1. Each text becomes its set of distinct word shingles, as 64-bit hashes. Texts with equal sets are one class; its least
   doc_id stands for it from here on, so copies cost nothing more.
2. Two linked sets differ in at most d elements, a number that follows from the lesser size. The hash space is cut into more
   than d parts, so linked sets agree in a whole part: they share a signature, the hash of the part's elements. Differences
   that fall at random leave far more parts alone, so sets that share fewer signatures with all others than linked sets
   do, but for a chance of RISK a pair, have no link and leave. Only signatures go through the shuffle, packed by bucket.
   Those that stay form candidate components. Sets of a large one sign again, by larger parts and, where differences
   may touch all of these, by several partitions; so mostly the groups of near copies themselves are left.
3. A candidate component is joined in one unit, or, beyond a bounded size, in pairs of blocks. Then its sets are first
   reduced to what differs from the component's pivot set, which is little for near copies, and only that is
   repeated for each pair of blocks.
4. In a unit, a signature tree holds the OR of token bitmaps and the range of sizes of the sets below each node; a dual
   traversal drops node pairs whose greatest possible overlap is too small. Pairs of sets that survive are counted exactly.
   All links are found, each once, and joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import textvec as V
from kmerloom.llm.common import checkpointed, in_chunks, shuffle_partitions, staged, utf8_parts
from kmerloom.llm.components import components
from kmerloom.operators import membership

SETS = "doc_id long, n_shingles long, key_a long, key_b long, signatures binary"
PACKED = "bucket int, hashes binary, ids binary, sizes binary"
WHOLE = "id long, component long, n long, hashes binary"
DELTAS = "component long, id long, base long, missing long, n long, delta binary"
UNIT = ["unit", "id", "own", "cross", "base", "missing", "n", "delta"]
WORDS64 = 8  # a bitmap has 512 bits
FANOUT = 8
#: Pieces that a bucket of signatures is worked on in.
PIECES = 4
#: Bytes of a signature that are kept: two that clash only bring sets together that are then counted exactly.
WIDTH = 6
#: The chance that a linked pair's differences fall into more parts than is allowed for.
RISK = 1e-15
#: In large components, elements of a part, and the most partitions.
PART, PARTITIONS = 8, 16
#: A block of a candidate component has about so many sets and so many elements at most.
BLOCK, ELEMENTS = 4096, 1 << 20


class Rule:
    """What a Jaccard threshold of `percent` says about sets of n elements."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]  # least size of each class of sizes; linked sets are in one class or in neighbouring ones
        self.plans: dict[bool, list[tuple[int, ...]]] = {False: [], True: []}

    def fits(self, less, more):
        """Whether sets of these sizes, the lesser first, can be linked."""
        return 100 * less >= self.percent * more

    def need(self, both):
        """Linked sets of `both` elements in sum have so many in common at least."""
        return -(-self.percent * both // (100 + self.percent))

    def linked(self, common, n, m):
        return 100 * common >= self.percent * (n + m - common)

    def classes(self, largest: int, fine: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Least sizes of the classes up to a size, and for each class as the lesser set's: greatest size of a partner, parts, partitions, spare parts, elements of a light part, signatures shared."""
        while self.edges[-1] <= largest:
            low = self.edges[-1]
            high = low * 100 // self.percent
            differ = high * (100 - self.percent) // self.percent
            for kind, plan in self.plans.items():
                plan.append((high * 100 // self.percent, *((larger_parts if kind else parts)(low, differ) if differ else (0, 0, 0, 0, 1))))
            self.edges.append(high + 1)
        return np.array(self.edges[:-1]), np.array(self.plans[fine])


@lru_cache(maxsize=None)
def parts(n: int, differ: int) -> tuple[int, int, int, int, int]:
    """(parts, partitions, spare parts, elements of a light part, signatures shared) of sets of n elements that differ in as many as said.

    A part with few elements says little. Linked sets agree in more parts than the spare ones, so such light parts
    only matter to sets that have more of them than that.
    """
    spare, light = 0, 3
    while light:
        rate = n / (differ + 1 + spare)
        below = np.exp(-rate) * sum(rate**i / np.prod(range(1, i + 1), initial=1.0) for i in range(light)) * (differ + 1 + spare)
        if spare >= below + 2 * np.sqrt(below):
            break
        spare += 1 + differ // 100
        if spare > differ // 2 + 2:
            spare, light = 0, light - 1
    return differ + 1 + spare, 1, spare, light, max(1, untouched(differ, differ + 1 + spare) - spare)


@lru_cache(maxsize=None)
def larger_parts(n: int, differ: int) -> tuple[int, int, int, int, int]:
    """The same with parts of PART elements, or less if too many partitions were needed for one of them to have an untouched part."""
    for size in range(PART, 1, -1):
        n_parts = max(1, n // size)
        touched = all_taken(differ, n_parts)
        rounds = 1 if touched <= RISK else int(np.ceil(np.log(RISK) / np.log(touched))) if touched < 1 else PARTITIONS + 1
        if rounds <= PARTITIONS:
            return n_parts, rounds, 0, 0, 1
    return parts(n, differ)


def taken_bins(balls: int, bins: int) -> np.ndarray:
    """The chance of each number of bins that balls fall into at random."""
    taken = np.zeros(min(balls, bins) + 1)
    taken[0], at = 1.0, np.arange(len(taken))
    for _ in range(balls):
        taken = taken * (at / bins) + np.append(0, (taken * (1 - at / bins))[:-1])
    return taken


def all_taken(balls: int, bins: int) -> float:
    """The chance, or for many balls a bound of it, that no bin stays empty."""
    if balls < bins:
        return 0.0
    return float(np.exp(-bins * np.exp(-balls / bins) / 2)) if balls > 300 else float(taken_bins(balls, bins)[bins])


def untouched(balls: int, bins: int) -> int:
    """So many of the bins stay empty at least when balls fall into them at random, but for a chance of RISK."""
    if balls > 300:  # ten standard deviations below the mean
        a = balls / bins
        return int(bins * np.exp(-a) - 10 * np.sqrt(bins * (np.exp(-a) - (1 + a) * np.exp(-2 * a))))
    beyond = np.cumsum(taken_bins(balls, bins)[::-1])[::-1]  # the chance of so many taken bins or more
    return bins - int(np.flatnonzero(beyond > RISK)[-1])


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, end to end, and where each text's begin (length n + 1)."""
    data = V.ascii_lower(data)
    w = V.words(data, bounds)
    hashes, doc = V.shingles(V.spans_hash(V.prefix_hash(data), w.start, w.end, data), w.bounds, k)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))[: len(hashes)]
    hashes, doc = hashes[fresh], doc[fresh]
    return hashes, np.searchsorted(doc, np.arange(len(bounds)))


def signatures(hashes: np.ndarray, at: np.ndarray, rule: Rule, fine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets that begin at `at` in `hashes`, in order of sets, and the set of each one; `fine` ones are of larger parts.

    A set signs its parts once as the lesser of two linked sets and once as the greater one, of which the class may be the
    one above. Sets that can only be linked with equal ones sign nothing.
    """
    n = np.diff(at)
    edges, plan = rule.classes(int(n.max(initial=1)), fine)
    keys, owners = [], []
    for up in (0, 1):
        every = np.searchsorted(edges, n, "right") - 1 - up
        most, _, partitions, *_ = plan[np.maximum(every, 0)].T
        partitions = np.where((n > 0) & (every >= 0) & (n <= most), partitions, 0)
        for partition in range(int(partitions.max(initial=0))):
            own = np.flatnonzero(partitions > partition)
            cls = every[own]
            _, parts, _, spare, light, _ = plan[cls].T
            begin = np.cumsum(parts) - parts
            mine = np.repeat(np.arange(len(own)), n[own])
            h = V.mix(hashes[ranges(at[:-1][own], n[own])] + V.U64(partition * V.BASE % (1 << 64)))
            slot = begin[mine] + ((h >> V.U64(20)) % parts[mine].astype(V.U64)).astype(np.int64)
            sums = np.zeros(int(parts.sum()), V.U64)
            np.add.at(sums, slot, h)
            of = np.repeat(np.arange(len(own)), parts)
            few = np.bincount(slot, minlength=len(sums)) < light[of]
            signed = ~few | (np.bincount(of[few], minlength=len(own)) > spare)[of]
            place = V.mix((np.arange(len(sums)) - begin[of] + (cls[of] << 32) + (partition << 48)).astype(V.U64))
            keys.append(V.mix(sums + place)[signed])
            owners.append(own[of[signed]])
    if not keys:
        return np.zeros(0, V.U64), np.zeros(0, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(keys)[order], owner[order]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, end to end."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths, lengths) + np.repeat(starts, lengths)


def narrow(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The lowest bytes of each hash, a row a hash."""
    return np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def widened(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Numbers of narrow() again."""
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def packed(bucket: np.ndarray, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, width: int = 8) -> pa.RecordBatch:
    """One row a bucket: its hashes, of so many bytes, with the id and size of the set that each comes from."""
    order = np.argsort(bucket, kind="stable")
    bucket, hashes, ids, sizes = bucket[order], narrow(hashes[order], width), ids[order], sizes[order].astype(np.int32)
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket))
    rows = [(int(bucket[a]), hashes[a:b].tobytes(), ids[a:b].tobytes(), sizes[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * 3, strict=True)], names=["bucket", "hashes", "ids", "sizes"])


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, ids, sizes) of each bucket of packed rows that stand together by bucket; one bucket is in memory at a time."""
    bucket, parts = None, ([], [], [])

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, (ids, sizes) = b"".join(parts[0]), (np.frombuffer(b"".join(p), t) for p, t in zip(parts[1:], (np.int64, np.int32), strict=True))
        return widened(data, len(data) // len(ids)) if len(ids) else np.zeros(0, np.uint64), ids, sizes.astype(np.int64)

    for batch in batches:
        for i in range(len(batch)):  # a row at a time, as a batch may hold many buckets
            b, *row = (c[i].as_py() for c in batch.columns)
            if b != bucket:
                if parts[0]:
                    yield done()
                bucket, parts = b, ([], [], [])
            for part, x in zip(parts, row, strict=True):
                part.append(x)
    if parts[0]:
        yield done()


def pieces(bucket: tuple[np.ndarray, ...], key: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """A bucket in PIECES by the upper bits of `key`, as work on it takes several times its memory; equal keys stay together."""
    which = key.astype(np.uint64) >> V.U64(8 * WIDTH - 8)
    for i in range(PIECES):
        own = which % V.U64(PIECES) == i
        yield tuple(x[own] for x in bucket)


def end_to_end(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Union:
    """Disjoint sets of 0 .. n - 1, the least member as the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def join(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[parent]
            if (up == parent).all():
                return parent
            self.parent = parent = up


def sharing(batches: Iterator[pa.RecordBatch], rule: Rule, slots: int) -> Iterator[pa.RecordBatch]:
    """Ids and sizes of the sets that share signatures of a bucket with another of a fitting size, and how often (in place of a hash); packed by id."""

    def shared_in(hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((sizes, hashes))
        hashes, ids, sizes = hashes[order], ids[order], sizes[order]
        beside = (hashes[1:] == hashes[:-1]) & rule.fits(sizes[:-1], sizes[1:])
        shared = np.zeros(len(hashes), bool)
        shared[1:] |= beside
        shared[:-1] |= beside
        order = np.lexsort((sizes[shared], ids[shared]))
        ids, sizes = ids[shared][order], sizes[shared][order]
        found, first, n = np.unique(ids, return_index=True, return_counts=True)
        return n.astype(np.uint64), found, sizes[first]

    for bucket in buckets(batches):
        counts, ids, sizes = end_to_end([shared_in(*piece) for piece in pieces(bucket, bucket[0])])
        yield packed((V.mix(ids.astype(V.U64)) % V.U64(slots)).astype(np.int64), counts, ids, sizes)


def enough(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """The ids of the sets that share as many signatures as a linked set must."""
    for bucket in buckets(batches):
        for counts, ids, sizes in pieces(bucket, V.mix(bucket[1].astype(V.U64))):
            order = np.lexsort((sizes, ids))  # the least size of an id that has several
            counts, ids, sizes = counts[order], ids[order], sizes[order]
            found, first, which = np.unique(ids, return_index=True, return_inverse=True)
            n = np.bincount(which, counts.astype(float), len(found))
            edges, plan = rule.classes(int(sizes.max(initial=1)))
            cls = np.searchsorted(edges, sizes[first], "right") - 1
            stay = n >= np.minimum(plan[cls, 5], plan[np.maximum(cls - 1, 0), 5])
            yield pa.RecordBatch.from_arrays([pa.array(found[stay], pa.int64())], names=["doc_id"])


def agreeing(batches: Iterator[pa.RecordBatch], rule: Rule, slots: int) -> Iterator[pa.RecordBatch]:
    """For each set, the least of those that shared signatures of a bucket connect it with by fitting sizes; packed by id."""

    def least_in(hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, sizes, hashes))
        hashes, ids, sizes = hashes[order], ids[order], sizes[order]
        beside = (hashes[1:] == hashes[:-1]) & rule.fits(sizes[:-1], sizes[1:])
        opens = np.append(True, ~beside)[: len(hashes)]
        alone = opens & np.append(~beside, True)[: len(hashes)]
        opens, ids = opens[~alone], ids[~alone]
        nodes, index = np.unique(ids, return_inverse=True)
        first = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
        union = Union(len(nodes))
        pairs = np.unique(index[first] * len(nodes) + index)
        union.join(np.stack([pairs // max(1, len(nodes)), pairs % max(1, len(nodes))], 1))
        root = union.roots()
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[root[moved]].astype(np.uint64), nodes[moved]

    for bucket in buckets(batches):
        least, ids = end_to_end([least_in(*piece) for piece in pieces(bucket, bucket[0])])
        yield packed((V.mix(ids.astype(V.U64)) % V.U64(slots)).astype(np.int64), least, ids, np.zeros(len(ids), np.int32))


def joined_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of the packed edges of each bucket, no more than an edge a node, so that edges stay few in groups that share many signatures."""
    for other, ids, _ in buckets(batches):
        nodes, index = np.unique(np.concatenate([ids, other.view(np.int64)]), return_inverse=True)
        union = Union(len(nodes))
        union.join(np.unique(index.reshape(2, -1).T, axis=0))
        root = union.roots()
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved], pa.int64()), pa.array(nodes[root[moved]], pa.int64())], names=["a", "b"])


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One bitmap a set: each element sets a bit."""
    n = np.array([len(s) for s in sets], np.int64)
    out = np.empty((len(sets), WORDS64), np.uint64)
    for s in range(0, len(sets), 4096):
        part = n[s : s + 4096]
        bits = np.zeros((len(part), 64 * WORDS64), bool)
        elements = np.concatenate(sets[s : s + 4096])
        bits[np.repeat(np.arange(len(part)), part), (V.mix(elements) % V.U64(64 * WORDS64)).astype(np.int64)] = True
        out[s : s + 4096] = np.packbits(bits, axis=1).view(np.uint64)
    return out


class Unit:
    """Sets that are joined together, each as its difference from one base set of `base` elements (0: as it is).

    Two sets have base - (elements of the base that the one misses) - (those that the other misses) + (common elements of
    the differences) in common. ids ascend, an id's sets stand together; `own` are the blocks of the sets.
    """

    def __init__(self, ids: np.ndarray, own: np.ndarray, cross: bool, base: int, missing: np.ndarray, n: np.ndarray, deltas: list[np.ndarray]):
        self.ids, self.own, self.cross, self.base, self.missing, self.n, self.deltas = ids, own, cross, base, missing, n, deltas
        if not base and len(deltas) > 2:  # a small component: the first set is the base
            pivot = deltas[0]
            self.base, self.deltas = len(pivot), [np.setxor1d(pivot, d, assume_unique=True) for d in deltas]
            self.missing = (len(pivot) - n + np.array([len(d) for d in self.deltas])) // 2


class SignatureTree:
    """The sets of a unit in order of block and size, bundled FANOUT by FANOUT up to the top: OR of bitmaps, range of sizes, most slack, least missing.

    A set of k elements whose bitmap has c bits has slack k - c: so many of its elements at most can share bits. Two sets
    have at most (bits common to both bitmaps) + (the lesser slack) common elements, and so have any two sets below two
    nodes, with the nodes' ORs and greatest slacks.
    """

    def __init__(self, unit: Unit, rule: Rule):
        self.unit, self.rule = unit, rule
        self.order = np.lexsort((unit.n, unit.own))
        maps = bitmaps([unit.deltas[i] for i in self.order])
        slack = np.array([len(d) for d in unit.deltas], np.int64)[self.order] - np.bitwise_count(maps).sum(1, dtype=np.int64)
        n, own = unit.n[self.order], unit.own[self.order]
        self.levels = [(maps, n, n, slack, unit.missing[self.order], own, own)]
        while len(self.levels[-1][0]) > FANOUT:
            ors, lo, hi, slk, less, a, b = self.levels[-1]
            at = np.arange(0, len(ors), FANOUT)
            least, most = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((np.bitwise_or.reduceat(ors, at), least(lo, at), most(hi, at), most(slk, at), least(less, at), least(a, at), most(b, at)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which node pairs of a level may have linked sets below them, of different blocks if the unit is of two."""
        ors, lo, hi, slack, missing, first, last = self.levels[level]
        least, most = np.maximum(lo[a], lo[b]), np.minimum(hi[a], hi[b])
        keep = self.rule.fits(most, least) | (most >= least)
        if self.unit.cross:
            keep &= (first[a] != last[b]) | (first[b] != last[a])
        at = np.flatnonzero(keep)
        x, y = a[at], b[at]
        common = np.bitwise_count(ors[x] & ors[y]).sum(1, dtype=np.int64) + np.minimum(slack[x], slack[y])
        keep[at] = self.unit.base - missing[x] - missing[y] + common >= self.rule.need(lo[x] + lo[y])
        return keep

    def candidates(self, chunk: int = 100_000) -> Iterator[np.ndarray]:
        """Pairs of sets (places in the unit) that survive the dual traversal, in chunks."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        a, b = np.triu_indices(n, 0 if top else 1)
        stack = [(top, a, b)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > chunk:
                stack += [(level, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]
                continue
            keep = self.possible(level, a, b)
            a, b = a[keep], b[keep]
            if not level:
                if len(a):
                    yield np.stack([self.order[a], self.order[b]], 1)
                continue
            below = len(self.levels[level - 1][0])
            i, j = (x.ravel() for x in np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij"))
            step = max(1, chunk // len(i))
            for s in range(0, len(a), step):
                x, y = (a[s : s + step, None] * FANOUT + i).ravel(), (b[s : s + step, None] * FANOUT + j).ravel()
                inside = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
                stack.append((level - 1, x[inside], y[inside]))


def links_of(unit: Unit, rule: Rule) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each place of an id among the distinct ids of a unit: the places of ids that it is linked with, and their common elements.

    Each pair comes once: in a unit of one block at the lesser id, in one of two blocks at that of the lesser block. The
    pairs that the tree leaves are counted exactly, those of a set at once through an index of the differences.
    """
    starts = np.flatnonzero(np.append(True, unit.ids[1:] != unit.ids[:-1]))
    node = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(unit.ids))))
    count = len(unit.ids)
    if unit.cross:
        if unit.own.min() == unit.own.max():
            return
        left, right = np.flatnonzero(unit.own == unit.own.min()), np.flatnonzero(unit.own == unit.own.max())
    else:
        left = right = np.arange(count)
    row, column = np.zeros(count, np.int64), np.zeros(count, np.int64)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    survive = np.zeros((len(left), len(right)), bool)
    for pairs in SignatureTree(unit, rule).candidates():
        a, b = pairs[:, 0], pairs[:, 1]
        swap = unit.own[a] > unit.own[b] if unit.cross else node[a] > node[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        apart = node[a] != node[b]
        survive[row[a[apart]], column[b[apart]]] = True
    value = np.concatenate([unit.deltas[i] for i in right])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], np.repeat(np.arange(len(right), dtype=np.int32), [len(unit.deltas[i]) for i in right])[order]
    best: dict[int, dict[int, int]] = {}
    for p in left[survive.any(1)].tolist():
        beside = np.flatnonzero(survive[row[p]])
        first = np.searchsorted(value, unit.deltas[p], "left")
        common = np.bincount(owner[ranges(first, np.searchsorted(value, unit.deltas[p], "right") - first)], minlength=len(right))[beside]
        at = right[beside]
        common = common + unit.base - unit.missing[p] - unit.missing[at]
        hit = rule.linked(common, unit.n[at], unit.n[p])
        if not hit.any():
            continue
        g, others, common = int(node[p]), node[at[hit]], common[hit]
        if g in best or len(np.unique(others)) < len(others):  # an id of several sets counts as linked by its best pair
            own = best.setdefault(g, {})
            for o, c in zip(others.tolist(), common.tolist(), strict=True):
                own[o] = max(c, own.get(o, 0))
        elif g + 1 < len(starts) and starts[g] + 1 == starts[g + 1] or g + 1 == len(starts) and starts[g] + 1 == count:
            yield g, others, common
        else:
            best[g] = dict(zip(others.tolist(), common.tolist(), strict=True))
    for g, own in best.items():
        yield g, np.array(list(own)), np.array(list(own.values()))


def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Unit]:
    """The units of rows (unit, id, own, cross, base, missing, n, delta) that stand together by unit; each id's equal sets once."""
    unit, rows = None, {}

    def done() -> Unit:
        keys = sorted(rows)
        own, missing, n = (np.array([rows[k][i] for k in keys], np.int64) for i in (0, 3, 4))
        _, cross, base, _, _ = rows[keys[0]]
        return Unit(np.array([k[0] for k in keys]), own, cross, base, missing, n, [np.frombuffer(k[1], np.uint64) for k in keys])

    for batch in batches:
        for u, i, own, cross, base, missing, n, delta in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if u != unit:
                if len(rows) > 1:
                    yield done()
                unit, rows = u, {}
            rows[i, delta] = own, cross, base, missing, n
    if len(rows) > 1:
        yield done()


def counted(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(a, b, n): each id that has links in a unit, the least id that they reach there, and their number."""
    for unit in units_of(batches):
        names = np.unique(unit.ids)
        n, union = np.zeros(len(names), np.int64), Union(len(names))
        for g, others, _ in links_of(unit, rule):
            n[g] += len(others)
            n[others] += 1
            apart = np.unique(union.parent[others])  # few once most are joined
            union.join(np.stack([np.full(len(apart), g), apart], 1))
        some, root = np.flatnonzero(n), union.roots()
        yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.int64()), pa.array(names[root[some]], pa.int64()), pa.array(n[some])], names=["a", "b", "n"])


def paired(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(a, b, n_common): each link of these units once, the lesser id first."""
    for unit in units_of(batches):
        names = np.unique(unit.ids)
        for g, others, common in links_of(unit, rule):
            a, b = np.minimum(names[g], names[others]), np.maximum(names[g], names[others])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(common)], names=["a", "b", "n_common"])


def links(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """The join itself: (a, b, n_common), a < b, every linked pair of class representatives once.

    A class is the documents with an equal set, its representative the least doc_id; so links within classes aren't
    listed, and a link stands for all pairs of documents of its two classes. Rows as for linked().
    """
    rule = Rule(percent)
    *_, units = candidates(docs, words, percent)
    return units.mapInArrow(lambda b: paired(b, rule), "a long, b long, n_common long")


def linked(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies, n_links) of each row of `docs` (doc_id, text): links are Jaccard similarities of at least `percent` %.

    n_copies: the rows with an equal set, this one included. n_links: the links of their representative, which is the
    least doc_id, with the representatives of other sets.

    A text's set: the distinct runs of `words` words, after A-Z are lower-cased; a text of fewer words is one run itself;
    a text without words, or null, is empty and linked with nothing. component_id is the least doc_id that links reach,
    the document's own included. Rows that repeat a doc_id are one node of the graph for each of their sets. Rows
    without a doc_id get their n_shingles, and the component of the documents with an equal set or else null. Other
    columns are ignored. An empty table gives an empty result. Sets are compared by 64-bit hashes of their elements.
    """
    rule = Rule(percent)
    key = ["n_shingles", "key_a", "key_b"]
    every, classes, units = candidates(docs, words, percent)
    found = checkpointed(units.mapInArrow(lambda b: counted(b, rule), "a long, b long, n long"))
    numbers = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    reached = components(found)
    named = classes.join(reached, "id", "left").join(numbers, "id", "left").select(*key, F.coalesce("component", "id").alias("class_component"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    own = F.col("n_shingles") > 0
    return every.join(named, key, "left").select(
        "doc_id", "n_shingles", F.when(own, F.col("class_component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(own, F.col("n_copies")).otherwise(1).cast("long").alias("n_copies"), F.when(own, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
    )


def asked(df: DataFrame, key: str, ids: DataFrame, into: str) -> DataFrame | None:
    """(row, `into`): the rows of `df` and whether their `key` may be among the stored `ids`, false if it is null; none where these are too many for a filter that is broadcast."""
    n = ids.count()
    if membership.size(n) > membership.MOST_BYTES:
        return None
    rows = df.select(F.col(key).cast("long").alias("key_"), F.struct("*").alias("row"))
    return membership.judged(rows, "key_", membership.built(ids, ids.columns[0], n), n, into).drop("key_")


def narrowed(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """`df` without most of the rows whose `key` isn't among `ids`, so that a join with these moves few others."""
    met = asked(df, key, ids, "maybe_")
    return df if met is None else met.where("maybe_").select("row.*")


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """`df` without the rows whose `key` is among the stored `ids`; of those that stay few move."""
    met, gone = asked(df, key, ids, "maybe_"), ids.toDF("gone_")
    if met is None:
        return df.join(gone, F.col(key) == F.col("gone_"), "left_anti")
    return met.where("not maybe_").select("row.*").unionByName(met.where("maybe_").join(gone, F.col(f"row.{key}") == F.col("gone_"), "left_anti").select("row.*"))


def candidates(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What linked() and links() start from: each row's set by its size and keys, the classes of equal sets, and the units to be joined exactly.

    Rows of units are (unit, id, own, cross, base, missing, n, delta) and stand together by unit; own is the block of the
    set, and a unit that is `cross` is of two blocks, whose sets are compared with those of the other one.
    """
    rule, n_tasks = Rule(percent), shuffle_partitions(docs)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            hashes, at = shingle_sets(*utf8_parts(batch.column(1)), words)
            n = np.diff(at)
            sums = np.concatenate([np.zeros((2, 1), V.U64), np.cumsum(np.stack([V.mix(hashes), V.mix(hashes ^ V.U64(V.BASE))]), axis=1)], axis=1)
            keys = (sums[:, at[1:]] - sums[:, at[:-1]]).view(np.int64)
            signed, owner = signatures(hashes, at, rule)
            signed = narrow(signed)
            cut = np.searchsorted(owner, np.arange(len(n) + 1)).tolist()
            signed = pa.array([signed[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), signed], names=["doc_id", "n_shingles", "key_a", "key_b", "signatures"])

    key = ["n_shingles", "key_a", "key_b"]
    signed = checkpointed(given.mapInArrow(sets, SETS))
    every = signed.drop("signatures")
    classes = checkpointed(every.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies")).where("id is not null"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 1 << 22, "signatures"):
            signs = batch.column(2).to_pylist()
            m = np.array([len(x) // WIDTH for x in signs], np.int64)
            hashes = widened(b"".join(signs))
            yield packed((hashes % V.U64(n_tasks)).astype(np.int64), hashes, np.repeat(batch.column(0).to_numpy(), m), np.repeat(batch.column(1).to_numpy(), m), WIDTH)

    # a bucket a task
    by_bucket = lambda df: df.repartitionById(n_tasks, "bucket").sortWithinPartitions("bucket")
    signing = signed.where("length(signatures) > 0")
    representatives = signing.join(classes.select(*key, F.col("id").alias("doc_id")), [*key, "doc_id"], "left_semi").select("doc_id", "n_shingles", "signatures")
    shared = by_bucket(representatives.mapInArrow(deal, PACKED)).mapInArrow(lambda b: sharing(b, rule, n_tasks), PACKED)
    staying = checkpointed(by_bucket(shared).mapInArrow(lambda b: enough(b, rule), "doc_id long"))
    near = narrowed(signing, "doc_id", staying).join(staying, "doc_id", "left_semi").select("doc_id", "n_shingles", "signatures").mapInArrow(deal, PACKED)
    edges = by_bucket(by_bucket(near).mapInArrow(lambda b: agreeing(b, rule, n_tasks), PACKED)).mapInArrow(joined_edges, "a long, b long")
    groups = checkpointed(components(edges))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            hashes, at = shingle_sets(*utf8_parts(batch.column(2)), words)
            own = [hashes[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(own, pa.binary())], names=["id", "component", "n", "hashes"])

    remaining = checkpointed(narrowed(given, "doc_id", groups.select("id")).join(groups, F.col("doc_id") == F.col("id")).select("id", "component", "text").mapInArrow(whole, WHOLE).where("n > 0"))
    beyond = (F.col("n_sets") > BLOCK) | (F.col("n_elements") > ELEMENTS)
    # few rows, of a size that is known: what they join needn't move
    sized = lambda df: staged(df.groupBy("component").agg(F.count("*").alias("n_sets"), F.sum("n").alias("n_elements"), F.min("id").alias("pivot")).where(beyond).select("component", "pivot"), "sized")

    def sign_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, column="hashes"):
            n = batch.column(1).to_numpy()
            signed, owner = signatures(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64), np.cumsum(np.append(0, n)), rule, fine=True)
            signed = widened(narrow(signed).tobytes())
            yield packed((signed % V.U64(n_tasks)).astype(np.int64), signed, batch.column(0).to_numpy()[owner], n[owner], WIDTH)

    chained = sized(remaining).select("component")
    loose = remaining.join(chained, "component").select("id", "n", "hashes")
    edges = by_bucket(by_bucket(loose.mapInArrow(sign_again, PACKED)).mapInArrow(lambda b: agreeing(b, rule, n_tasks), PACKED)).mapInArrow(joined_edges, "a long, b long")
    regrouped = checkpointed(loose.join(components(edges), "id").select("id", "component", "n", "hashes"))
    remaining = remaining.join(chained, "component", "left_anti").select("id", "component", "n", "hashes").unionByName(regrouped)
    large = sized(remaining)
    small = remaining.join(large, "component", "left_anti").select(
        F.xxhash64("component").alias("unit"), "id", F.lit(0).cast("long").alias("own"), F.lit(False).alias("cross"),
        F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("missing"), "n", F.col("hashes").alias("delta"),
    )

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for component, i, s, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, pivot = np.frombuffer(s, np.uint64), np.frombuffer(p, np.uint64)
                delta = np.setxor1d(own, pivot, assume_unique=True)
                rows.append((component, i, len(pivot), (len(pivot) - len(own) + len(delta)) // 2, len(own), delta.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.binary()], strict=True)], names=[x.split()[0] for x in DELTAS.split(", ")])

    pivots = remaining.join(large.withColumnRenamed("pivot", "id"), ["component", "id"]).groupBy("component").agg(F.min("hashes").alias("pivot"))
    differing = checkpointed(remaining.join(large.select("component"), "component", "left_semi").join(pivots, "component").select("component", "id", "hashes", "pivot").mapInArrow(differences, DELTAS))
    blocks = differing.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("delta")) / (8 * ELEMENTS))).alias("blocks"))
    placed = differing.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    # a component of several blocks is joined block pair by block pair
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    pairs = pairs.select(F.xxhash64("component", "i", "j").alias("unit"), "id", "own", (F.col("i") != F.col("j")).alias("cross"), "base", "missing", "n", "delta")
    return every, classes, small.select(*UNIT).unionByName(pairs.select(*UNIT)).repartition("unit").sortWithinPartitions("unit")
