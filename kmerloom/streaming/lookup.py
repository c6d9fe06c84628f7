"""A stream of sequences looked up in a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kmerloom.operators.index import Index
from kmerloom.operators.lookup import by_super_kmer


def looked_up(contigs: DataFrame, index: Index) -> DataFrame:
    """by_super_kmer() of a streaming DataFrame (seq_id, seq): stateless, its joins are with the index's static tables."""
    if not contigs.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return by_super_kmer(contigs, index)


def written(contigs: DataFrame, index: Index, path: str, checkpoint: str) -> StreamingQuery:
    """Codes appended to Parquet, exactly once; the query stops when what has arrived is done."""
    stream = looked_up(contigs, index).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return stream.outputMode("append").trigger(availableNow=True).start()
