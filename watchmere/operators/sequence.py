"""Comparing each row with the one before it, without one task per key.

A window over (keys, time) puts all rows of one key into one task. Here rows are instead range
partitioned by (keys, order), which cuts a busy key into as many chunks as its size asks for, windows
run inside (keys, chunk), and the seams between chunks are closed over one or two rows per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"


def with_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range partition by (keys, order) and number the partitions; chunks of a key are in order.

    The last order column should be unique so that rows of one instant can be cut apart too.
    """
    return df.repartitionByRange(*keys, *order).withColumn(CHUNK, F.spark_partition_id())


def chunk_window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, keep=None
) -> DataFrame:
    """Add `name`: the struct `value` of the row before, null for the first row of a key.

    `keep`, a function from (row, previous) columns to a predicate, drops rows early: only rows that
    pass and the two ends of each chunk go through the closing shuffle.
    """
    inner = chunk_window(keys, order)
    rows = (
        with_chunks(df.withColumn("_value", value), keys, order)
        .withColumn("_before", F.lag("_value").over(inner))
        .withColumn("_head", F.lag(F.lit(1)).over(inner).isNull())
        .withColumn("_tail", F.lead(F.lit(1)).over(inner).isNull())
    )
    if keep is not None:
        rows = rows.filter(F.col("_head") | F.col("_tail") | keep(F.col("_value"), F.col("_before")))
    # The ends of all chunks of a key meet in one group of at most two rows per chunk; there, the
    # row before a head is the tail of the chunk before. Other rows stay in groups of their own.
    seam = F.when(F.col("_head") | F.col("_tail"), F.lit(-1)).otherwise(F.col(CHUNK))
    outer = Window.partitionBy(*keys, "_seam").orderBy(*order)
    rows = rows.withColumn("_seam", seam).withColumn("_across", F.lag("_value").over(outer))
    rows = rows.withColumn(name, F.when(F.col("_head"), F.col("_across")).otherwise(F.col("_before")))
    if keep is not None:
        rows = rows.filter(keep(F.col("_value"), F.col(name)))
    return rows.drop("_value", "_before", "_head", "_tail", "_seam", "_across", CHUNK)


def with_latest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, keep=None
) -> DataFrame:
    """Add `name`: the last non-null `value` among the rows of a key up to and including this one.

    Chunks answer for themselves from their first value on. What lies before it needs the last value of an earlier
    chunk: the ends of all chunks of a key, two rows per chunk, carry it on, and it is spread inside the chunk again.
    `keep`, a function from the column `name` to a predicate, drops rows early: only rows that pass, rows that are not
    decided yet and the ends of chunks go through the closing shuffles. Values must be orderable.
    """
    inner = chunk_window(keys, order)
    rows = (
        with_chunks(df.withColumn("_value", value), keys, order)
        .withColumn("_own", F.last("_value", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_head", F.lag(F.lit(1)).over(inner).isNull())
        .withColumn("_tail", F.lead(F.lit(1)).over(inner).isNull())
    )
    if keep is not None:
        rows = rows.filter(F.col("_head") | F.col("_tail") | F.col("_own").isNull() | keep(F.col("_own")))
    seam = F.when(F.col("_head") | F.col("_tail"), F.lit(-1)).otherwise(F.col(CHUNK))
    outer = Window.partitionBy(*keys, "_seam").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_seam", seam).withColumn("_across", F.last("_own", ignorenulls=True).over(outer))
    carried = F.max(F.when(F.col("_head"), F.col("_across"))).over(Window.partitionBy(*keys, CHUNK))
    rows = rows.withColumn(name, F.coalesce("_own", carried))
    if keep is not None:
        rows = rows.filter(keep(F.col(name)))
    return rows.drop("_value", "_own", "_head", "_tail", "_seam", "_across", CHUNK)
