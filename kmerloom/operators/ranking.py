"""Global ranks and running sums that scale: range partitions, their totals, and work inside each partition only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kmerloom.storage import staged


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def within(df: DataFrame, value: str, into: str = "inside", section: str | None = None) -> DataFrame:
    """`df` with the exclusive running sum of `value`, a long, over the rows of the same partition (and the same `section`, a long or an int) as they stand; a null counts as 0."""
    at, group = df.columns.index(value), df.columns.index(section) if section else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = {}
        for batch in batches:
            values = pc.fill_null(batch.column(at), 0).to_numpy()
            sections = batch.column(group).to_numpy() if section else np.zeros(len(values), np.int64)
            inside = np.zeros(len(values), np.int64)
            for x in np.unique(sections).tolist():
                own = sections == x
                sums = np.cumsum(values[own]) + done.get(x, 0)
                inside[own], done[x] = sums - values[own], int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside)], names=[*batch.schema.names, into])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(into, LongType())]))


def _placed(df: DataFrame, order: list[str | Column], value: str | None = None, section: str | None = None, distinct: bool = False, name: str = "placed") -> DataFrame:
    """`df` sorted over range partitions, with the partition (`part`), the place in it (`place`) and, of `value`, the sum before it there (`inside`), kept on disk
    so that all stay as they are. With `distinct`, of rows that are equal, whose other columns follow from those of `order`, one stays; that needs no other shuffle."""
    dealt = df.repartitionByRange(parts_of(df), *order)
    made = (dealt.distinct() if distinct else dealt).sortWithinPartitions(*order)
    # the id is the partition's number above 33 bits of the row's number in it
    made = made.withColumn("row_", F.monotonically_increasing_id()).withColumns({"part": F.shiftright("row_", 33).cast("int"), "place": F.col("row_").bitwiseAND((1 << 33) - 1)}).drop("row_")
    return staged(within(made, value, "inside", section) if value else made, name, "zstd")


def _offsets(totals: DataFrame, total: str, into: str, section: str | None = None) -> DataFrame:
    """Exclusive running sum over the partitions, section after section: a few rows each, so one task is enough."""
    key = [section, "part"] if section else ["part"]
    return totals.select(*key, F.coalesce(F.sum(total).over(W.orderBy(*key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias(into))


def sums_before(counts: DataFrame) -> DataFrame:
    """(part, offset): of a row (part, n) a partition, the sum of n of the partitions before."""
    return _offsets(counts, "n", "offset")


def ranked(df: DataFrame, order: list[str | Column], into: str = "rank", distinct: bool = False, name: str = "placed") -> DataFrame:
    """`df` with its 0-based place in the global order of `order`. Keys are taken to be distinct; with `distinct` repeated rows, whose other columns follow from the keys, are
    dropped first. It reads one staged table, `name`, to whose places it adds the rows of the partitions before."""
    placed = _placed(df, order, distinct=distinct, name=name)
    offsets = _offsets(placed.groupBy("part").agg(F.count("*").alias("n")), "n", "offset")
    return placed.join(F.broadcast(offsets), "part").withColumn(into, F.col("offset") + F.col("place")).drop("part", "place", "offset")


def running_sum(df: DataFrame, order: list[str | Column], value: str, into: str, section: str | None = None, rank: str | None = None) -> DataFrame:
    """`df` with the exclusive running sum of `value` in the global order of `section`, if it is given, and `order`; with `rank`, also with the place in the order of
    `order`. One range shuffle by `order` does for all: sections are kept apart by their sums in each partition."""
    placed = _placed(df.withColumn(value, F.col(value).cast("long")), order, value, section)
    key = ["part", section] if section else ["part"]
    totals = staged(placed.groupBy(*key).agg(F.sum(value).alias("total_"), F.count("*").alias("rows_")), "totals")
    made = placed.join(F.broadcast(_offsets(totals, "total_", "offset", section)), key).withColumn(into, (F.col("offset") + F.col("inside")).cast("long")).drop("offset", "inside")
    if rank:
        rows = _offsets(totals.groupBy("part").agg(F.sum("rows_").alias("rows_")), "rows_", "rows_before")
        made = made.join(F.broadcast(rows), "part").withColumn(rank, F.col("rows_before") + F.col("place")).drop("rows_before")
    return made.drop("part", "place")


def order_violations(df: DataFrame, order: list[str | Column], value: str) -> DataFrame:
    """One row, (n, n_descents, n_repeats): rows, and those whose `value` is less than, or equal to, that of the row before in the global order of `order`.

    Inside a range partition rows meet their neighbour; from partition to partition the last value meets the next first one. Nulls
    in `value` are passed over.
    """
    placed = _placed(df.where(F.col(value).isNotNull()).select(*order, value), order)
    inside = placed.withColumn("last_", F.lag(value).over(W.partitionBy("part").orderBy("place")))
    counts = lambda d: [F.count("*").alias("n"), *(F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(c) for c, x in (("n_descents", F.col(value) < F.col("last_")), ("n_repeats", F.col(value) == F.col("last_"))))]
    by_part = inside.groupBy("part").agg(*counts(inside), F.min_by(value, "place").alias("first_"), F.max_by(value, "place").alias("end_"))  # a row a partition
    edges = by_part.withColumn("last_", F.lag("end_").over(W.orderBy("part")))
    met = lambda x: F.coalesce(x.cast("long"), F.lit(0))
    edges = edges.select("n", (F.col("n_descents") + met(F.col("first_") < F.col("last_"))).alias("n_descents"), (F.col("n_repeats") + met(F.col("first_") == F.col("last_"))).alias("n_repeats"))
    return edges.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n", "n_descents", "n_repeats")))
