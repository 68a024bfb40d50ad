"""Numbering the rows of groups of any size.

A window over a whole group would put a group that holds a third of all rows into one task. Here
each group is cut into shards by the rows' identity; rows are numbered within their shard, and the
shards' totals, a few numbers a group, give each shard its first number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import shuffle_tasks

SHARD, OFFSET = "__cairn_shard", "__cairn_offset"


def running(df: DataFrame, group: list[str], identity: list[str], name: str, value: Column | str | None = None, seed: int = 0, shards: int | None = None) -> DataFrame:
    """df with the sum of value (1 by default: the row's number from 0) over the rows before it in its group.

    The order within a group is one that seed and identity give; rows of equal identity follow each
    other in any order. Null values count as 0; null group keys make a group of their own.
    """
    shards = shards or 2 * shuffle_tasks(df.sparkSession)
    spread = F.xxhash64(F.lit(seed), *identity)
    v = F.lit(1) if value is None else F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
    df = df.withColumn(SHARD, F.pmod(spread, F.lit(shards)).cast("int"))
    before = Window.partitionBy(*group).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, SHARD).agg(F.sum(v).cast("long").alias("__cairn_n"))
    totals = totals.withColumn(OFFSET, F.coalesce(F.sum("__cairn_n").over(before), F.lit(0)))
    own = Window.partitionBy(*group, SHARD).orderBy(spread, *identity).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn(name, F.coalesce(F.sum(v).over(own), F.lit(0)).cast("long"))
    renamed = totals.select(*(F.col(g).alias(f"__cairn_g{i}") for i, g in enumerate(group)), F.col(SHARD).alias("__cairn_s"), OFFSET)
    same = F.col(SHARD) == F.col("__cairn_s")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__cairn_g{i}"))
    joined = local.join(renamed, same)
    return joined.withColumn(name, F.col(name) + F.col(OFFSET)).drop(SHARD, OFFSET, "__cairn_s", *(f"__cairn_g{i}" for i in range(len(group))))


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df with 1, 2, 3, ... in the given order, without gathering all rows in one task.

    Rows are sorted by ranges; each range's first number comes from the sizes of those before it.
    The ranges are kept, since they are drawn from a sample and must not change between both uses.
    """
    from cairn.session import cut

    tasks = shuffle_tasks(df.sparkSession)
    parts = cut(df.repartitionByRange(tasks, *order).withColumn(SHARD, F.spark_partition_id()))
    sizes = parts.groupBy(SHARD).agg(F.count(F.lit(1)).alias("__cairn_n"))
    before = Window.orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    offsets = sizes.select(SHARD, F.coalesce(F.sum("__cairn_n").over(before), F.lit(0)).alias(OFFSET))
    own = F.row_number().over(Window.partitionBy(SHARD).orderBy(*order))
    return parts.withColumn(name, own).join(F.broadcast(offsets), SHARD).withColumn(name, F.col(name) + F.col(OFFSET)).drop(SHARD, OFFSET)
