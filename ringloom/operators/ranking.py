"""Global numbers and ranks without a window over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringloom.operators.durable import at, partitions, settle


def row_numbers(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """`df` with its rows numbered by `order`, whose values must differ from row to row.

    Rows are dealt to key ranges, sorted and numbered there, and written, all in one shuffle; the sizes of the ranges before, one row a range, are added.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    # a partition's number stands above the 33 lowest bits, a row's place in it in these
    ranges = settle(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    dealt = ranges.withColumn("_part", F.shiftright("_id", 33))
    before = sums_before(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_part", "_n", "_before")
    own = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return at(dealt.join(F.broadcast(before), "_part").withColumn(name, own + F.col("_before") + start).drop("_id", "_part", "_before"), ranges.settled_at)


#: Keys whose sums are added up together, one after the other; only one row for so many keys is looked at in one place.
LEVEL = 1 << 16


def sums_before(totals: DataFrame, key: str, value: str, name: str, level: int = LEVEL) -> DataFrame:
    """(key, name): for each whole number `key` of `totals`, the sum of `value` over all smaller ones. In two levels, so that a single task sees a row for `level` keys at most."""
    rows = totals.select(key, value, F.floor(F.col(key) / level).alias("_top"))
    earlier = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("_top").agg(F.sum(value).alias("_sum"))
    tops = tops.select("_top", F.coalesce(F.sum("_sum").over(earlier(Window.orderBy("_top"))), F.lit(0)).alias("_above"))
    own = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("_top").orderBy(key))), F.lit(0))
    return rows.withColumn("_own", own).join(tops, "_top").select(key, (F.col("_own") + F.col("_above")).alias(name))


def _added(value: str):
    """Each row of a task with the sum of `value` over the rows before it, and the task's number."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            each = batch.column(value).to_numpy()
            own = run + np.cumsum(each) - each
            run += int(each.sum())
            yield batch.append_column("_own", pa.array(own)).append_column("_part", pa.array(np.full(batch.num_rows, part, np.int32)))

    return added


def sums_in_order(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """`df` with the sum of `value`, a long, over all rows that come before in `order`, whose values must differ from row to row. Rows are dealt and sorted as by row_numbers()."""
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField("_own", T.LongType()), T.StructField("_part", T.IntegerType())])
    ranges = settle(dealt.mapInArrow(_added(value), schema), "ranges")
    before = sums_before(ranges.groupBy("_part").agg(F.sum(value).alias("_n")), "_part", "_n", "_before")
    return at(ranges.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_part", "_before"), ranges.settled_at)


def dense_ranks(df: DataFrame, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """`df` with the dense rank of its `keys`, which must not be null.

    Only distinct keys are sorted, so a key that most rows share is one row there; joining the ranks back is an ordinary join, which adaptive execution splits where it is skewed.
    """
    ranked = row_numbers(df.select(*keys).distinct(), keys, name, start)
    return at(df.join(ranked, keys), ranked.settled_at)
