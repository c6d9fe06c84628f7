"""op7: rows that the count of tokens is made from are in proportion to the tokens, whatever batch they stand in."""

from collections import Counter

import numpy as np
import pyarrow as pa

from kmerloom.llm import line_dedup as op7


def lines(docs, leaf=5):
    """Rows of LINES with n_docs: documents of lines of four tokens, as numbers."""
    of = lambda make: pa.array([make(d) for d in docs], pa.binary())
    columns = [pa.array(range(len(docs)), pa.int64()), pa.array(range(len(docs)), pa.int64()), pa.array([leaf] * len(docs), pa.int64()), pa.array([4] * len(docs), pa.int32()),
               of(lambda d: np.arange(len(d), dtype=np.int32).tobytes()), of(lambda d: np.array(d, np.uint32).tobytes()), pa.array([len(docs)] * len(docs), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "leaf", "n", "numbers", "tokens", "n_docs"])


def counted(batches):
    return Counter(x for b in op7.of_items(iter(batches)) for x in b.column(0).to_pylist())


def test_items_are_in_proportion_to_the_tokens():
    # two documents: one repeats its line, the other has a line of its own and a field
    small = [[[7, 8, 9, 10], [7, 8, 9, 10]], [[7, 8, 9, 0]]]
    one, many = counted([lines(small)]), counted([lines(small * 50)])
    assert sorted(one.values()) == [1, 2]
    assert {k: 50 * n for k, n in one.items()} == many
    # the same rows in batches of their own
    assert many == counted([lines(small * 50).slice(i, 1) for i in range(100)])
    assert not counted([lines([[[7, 8, 0, 0]]])])
