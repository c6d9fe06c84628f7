"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments; a segment's mean and deviation bound distances from below: with segments of L components,

    |q - x|^2 >= sum of L * ((mean_q - mean_x)^2 + (deviation_q - deviation_x)^2), so
    q . x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= sum of L * (mean_q * mean_x + deviation_q * deviation_x),

which is itself an inner product, of 2 numbers a segment. Bounds are taken for 1, 4, 16, ... segments, each level only
over what the one before has left, and the survivors' exact integer scores settle the rest. A query is passed over only where its
bound is below the k-th best score it has already, so the result is exact.

Vectors are dealt into blocks of neighbours by their mean. Each query first meets its own block, which gives it k scores to
beat; then the queries, some blocks' together, meet every block of candidates. Blocks and their queries are one row each,
so the meeting is an equi-join of few rows, and each task holds one block of either kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.llm.common import shuffle_partitions, staged

#: Candidates of a block, blocks whose queries travel together, and candidates that are bounded at a time.
BLOCK, GROUP, CHUNK = 8192, 8, 1024
#: Share of pairs below which the survivors are taken pair by pair.
SPARSE = 0.1
#: Largest whole numbers that sums of products keep exactly.
EXACT = {np.float32: 1 << 24, np.float64: 1 << 53}
LONG = (-(1 << 63), (1 << 63) - 1)

VECTORS = "vec_id long, at double, vector binary"
BLOCKS = "block long, first long, vec_ids binary, vectors binary, width long"
QUERIES = "home long, rows binary, queries binary, least binary, width long"
FOUND = "query_row long, query_id long, vec_id long, score long"


def scaled(values: np.ndarray, scale: int) -> np.ndarray | None:
    """floor(scale * x) of finite components, as doubles; None if one isn't finite."""
    values = np.asarray(values, np.float64)
    return np.floor(scale * values) if np.isfinite(values).all() else None


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are continued by zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v, np.float64)
    return out


def _ids(values: list[int | None]) -> np.ndarray:
    """(id, 1 if there is one) a row."""
    return np.array([(0 if v is None else v, v is not None) for v in values], np.int64).reshape(-1, 2)


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Per segment its mean and deviation, times the square root of its length, so that bounds are inner products of rows."""
    cuts = np.unique(np.arange(segments) * vectors.shape[1] // segments)
    sizes = np.diff(np.append(cuts, vectors.shape[1]))
    means = np.add.reduceat(vectors, cuts, axis=1) / sizes
    spread = np.add.reduceat((vectors - np.repeat(means, sizes, axis=1)) ** 2, cuts, axis=1)
    return np.concatenate([means * np.sqrt(sizes), np.sqrt(spread)], axis=1)


def levels(width: int) -> list[int]:
    """Numbers of segments, coarse to fine; segments of under four components save nothing."""
    return [n for n in (4**i for i in range(16)) if n == 1 or 4 * n <= width] if width else []


class Exact:
    """Exact inner products of rows of whole numbers, in the narrowest numbers that hold them."""

    def __init__(self, queries: np.ndarray, vectors: np.ndarray):
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
        self.kind = next((k for k, limit in EXACT.items() if most < limit), object)
        self.queries, self.vectors = (x.astype(self.kind) if self.kind is not object else self._whole(x) for x in (queries, vectors))

    @staticmethod
    def _whole(x: np.ndarray) -> np.ndarray:
        return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)

    def _long(self, scores: np.ndarray) -> np.ndarray:
        return (scores.clip(*LONG) if self.kind is object else scores).astype(np.int64)

    def all(self, part: slice) -> np.ndarray:
        return self._long(self.queries @ self.vectors[part].T)

    def pairs(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self._long((self.queries[q] * self.vectors[v]).sum(axis=1))


class Best:
    """The k best (score, vec_id) of each query so far; equal scores by smaller vec_id, none last."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.found = [np.zeros((0, 4), np.int64)] * len(least)  # score, no id, vec_id, place

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        new = np.column_stack([scores, 1 - ids[:, 1], ids[:, 0], places])
        every = np.concatenate([self.found[query], new])
        every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], -1 - every[:, 0]))][: self.k]  # -1 - s can't overflow
        self.found[query] = every
        if len(every) == self.k:
            self.least[query] = max(self.least[query], every[-1, 0])


def searched(queries: np.ndarray, rows: np.ndarray, least: np.ndarray, vectors: np.ndarray, first: int, ids: np.ndarray, k: int) -> Best:
    """The k best of `vectors` (whose rows are first, first + 1, ..) for each query (whose own row is rows[i]) among scores of least[i] and more."""
    best, exact = Best(least, k), Exact(queries, vectors)
    steps = [(statistics(queries, n), statistics(vectors, n)) for n in levels(queries.shape[1])]
    norm_q, norm_v = np.sqrt((queries**2).sum(axis=1)), np.sqrt((vectors**2).sum(axis=1))
    own = rows - first
    # the longest vectors first: they have the largest scores
    for at in range(0, len(vectors), CHUNK):
        part = slice(at, at + CHUNK)
        limit = best.least.astype(np.float64)[:, None] - 1 - 1e-6 * np.outer(norm_q, norm_v[part])  # room for rounding
        alive = np.ones((len(queries), len(vectors[part])), bool)
        for q, v in steps:
            if not alive.any():
                break
            if alive.mean() > SPARSE:
                alive &= q @ v[part].T >= limit
            else:
                i, j = np.nonzero(alive)
                alive[i, j] = (q[i] * v[part][j]).sum(axis=1) >= limit[i, j]
        mine = (own >= at) & (own < at + alive.shape[1])
        alive[np.flatnonzero(mine), own[mine] - at] = False
        i, j = np.nonzero(alive)
        if not len(i):
            continue
        scores = exact.pairs(i, at + j) if len(i) < SPARSE * alive.size else exact.all(part)[i, j]
        keep = scores >= best.least[i]
        i, j, scores = i[keep], j[keep], scores[keep]
        ends = np.searchsorted(i, np.arange(len(queries) + 1))
        for query in np.flatnonzero(np.diff(ends)).tolist():
            s = slice(ends[query], ends[query + 1])
            best.add(query, scores[s], ids[at + j[s]], first + at + j[s])
    return best


def prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, at, vector) of the vectors that take part, as whole numbers in bytes; `at` is their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, means, made = [], [], []
            for i, vector in enumerate(batch.column(1)):
                if vector.is_valid and not vector.values.null_count:
                    values = scaled(vector.values.to_numpy(zero_copy_only=False), scale)
                    if values is not None:
                        keep.append(i)
                        means.append(float(values.mean()) if len(values) else 0.0)
                        made.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(means, pa.float64()), pa.array(made, pa.binary())], names=["vec_id", "at", "vector"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, VECTORS)


def blocks(rows: DataFrame, parts: int) -> DataFrame:
    """BLOCKS: neighbours by their mean, as a row each; `first` is the row number of a block's first vector, different for all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ids, made = TaskContext.get().partitionId() << 33, [], []

        def packed(n: int) -> pa.RecordBatch:
            width = max(len(v) for v in made[:n]) // 8
            matrix = _matrix(made[:n], width)
            order = np.argsort(-(matrix**2).sum(axis=1), kind="stable")  # the longest first: they have the largest scores
            columns = [[first], [first], [_ids(ids[:n])[order].tobytes()], [matrix[order].tobytes()], [width]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.binary()] * 2 + [pa.int64()], strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            made += batch.column(2).to_pylist()
            while len(made) >= BLOCK:
                yield packed(BLOCK)
                first, ids, made = first + BLOCK, ids[BLOCK:], made[BLOCK:]
        if made:
            yield packed(len(made))

    # the second key deals out vectors of one mean, copies of one vector among them
    dealt = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, "at", "nth").sortWithinPartitions("at", "nth")
    return dealt.mapInArrow(run, BLOCKS)


def _block(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["vec_ids"], np.int64).reshape(-1, 2)
    return ids, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["width"])


def home_queries(made: DataFrame, k: int, every: int) -> DataFrame:
    """QUERIES: the queries of each block, with the k-th best score that each has in it (the least number where there are fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = _block(row)
                asks = np.flatnonzero((ids[:, 1] == 1) & (ids[:, 0] % every == 0))
                for s in range(0, len(asks), CHUNK):
                    q = asks[s : s + CHUNK]
                    best = searched(vectors[q], row["first"] + q, np.full(len(q), LONG[0]), vectors, row["first"], ids, k)
                    named = np.column_stack([row["first"] + q, ids[q, 0]])
                    columns = [[row["block"]], [named.tobytes()], [vectors[q].tobytes()], [best.least.tobytes()], [row["width"]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.binary()] * 3, pa.int64()], strict=True)], names=[x.split()[0] for x in QUERIES.split(", ")])

    return made.mapInArrow(run, QUERIES)


def nearest(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` (vec_id, embedding) whose vec_id is divisible by `every`, the k other rows of
    largest inner product of floor(scale * component), all if there are fewer; ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as continued by zeros. Rows that
    repeat a vec_id are rows of their own, each a query and a candidate of the others. A row without a vec_id is no query; as a
    candidate it comes last among equal scores. Scores beyond a long count as the nearest one. An empty table gives no rows.
    """
    parts = shuffle_partitions(vectors)
    rows = staged(prepared(vectors, scale), "vectors")
    parts = max(parts, -(-rows.count() // BLOCK))
    made = staged(blocks(rows, parts), "blocks")
    asks = staged(home_queries(made, k, every), "asks")
    span = made.select(F.shiftright("block", 33).alias("part"), "first", "vec_ids", "vectors", "width")
    groups = asks.withColumn("group", F.floor(F.shiftright("home", 33) / GROUP)).groupBy("group").agg(F.collect_list(F.struct("rows", "queries", "least", "width")).alias("asks"))
    sent = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = _block(row)
                for ask in row["asks"]:
                    named = np.frombuffer(ask["rows"], np.int64).reshape(-1, 2)
                    queries = np.frombuffer(ask["queries"], np.float64).reshape(len(named), ask["width"])
                    width = max(row["width"], ask["width"])
                    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, vectors))
                    best = searched(q, named[:, 0], np.frombuffer(ask["least"], np.int64), v, row["first"], ids, k)
                    n = np.array([len(x) for x in best.found], np.int64)
                    found = np.concatenate(best.found) if len(best.found) else np.zeros((0, 4), np.int64)
                    named = np.repeat(named, n, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(named[:, 0]), pa.array(named[:, 1]), pa.array(found[:, 2], mask=found[:, 1] == 1), pa.array(found[:, 0])], names=[x.split()[0] for x in FOUND.split(", ")])

    # Queries times blocks: the estimate of its size is that of the queries alone, so without the hint it would be broadcast, whole through the driver.
    found = sent.hint("merge").join(span.hint("merge"), "part").select("first", "vec_ids", "vectors", "width", "asks").mapInArrow(run, FOUND)
    order = W.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows in SQL.
SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), placed AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 20
"""
