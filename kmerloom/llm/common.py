"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from kmerloom.storage import checkpointed, discarded, staged  # noqa: F401

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    """How many buckets to deal hashed work into: the session's own setting, which its owner sizes to the input."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and each row's offsets into them (length n + 1). Nulls count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, (_, offsets, data) = len(column), column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    if data is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


#: Bytes of text that numpy works on at a time: its arrays are some 50 to 100 times as large, and a worker keeps what it once took.
CHUNK = 1 << 18


def in_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, so that numpy work on a batch has a bounded size (one row at least)."""
    for batch in batches:
        sizes = np.zeros(len(batch) + 1, np.int64)
        texts = batch.column(batch.schema.get_field_index(column))
        sizes[1:] = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
