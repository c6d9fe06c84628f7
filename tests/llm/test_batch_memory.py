"""Batch work of the pipeline's stages takes a bounded part of an executor's memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from kmerloom.llm import jaccard_join, langid, line_dedup
from kmerloom.llm.common import in_chunks, utf8_parts


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize(
    "work",
    [
        lambda texts: line_dedup.parse(*utf8_parts(texts)),
        lambda texts: jaccard_join.signatures(*jaccard_join.shingle_sets(*utf8_parts(texts), 5), jaccard_join.Rule(80)),
        langid.grams,
    ],
)
def test_texts_are_worked_on_in_small_chunks(work):
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(300))
    batch = pa.RecordBatch.from_pydict({"text": [text] * (3_000_000 // len(text))})
    assert peak(lambda: [work(c.column(0)) and None for c in in_chunks(iter([batch]))]) < 20


def test_buckets_of_a_batch_are_read_one_by_one():
    rows = [(b, *(np.full(100_000, b, t).tobytes() for t in (np.uint64, np.int64, np.int32))) for b in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] + [pa.binary()] * 3, strict=True)], names=["bucket", "hashes", "ids", "sizes"])
    met = []
    assert peak(lambda: met.extend(int(h[0]) for h, _, _ in jaccard_join.buckets(iter([batch])))) < 12
    assert met == list(range(20))
