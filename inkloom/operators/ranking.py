"""Global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_rank(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """1-based position of every row in the total order of ``order``.

    Rows are range-partitioned and stored with their partition number; each
    partition counts its own rows and adds the sizes of those before it.
    """
    parts = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(
        F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_l", local).join(before, "_p").withColumn(name, F.col("_before") + F.col("_l")).drop("_p", "_l", "_before")


def previous_row(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the value of the row before in the total order of ``order``, NULL for the first.

    Rows are range-partitioned and stored as in :func:`global_rank`; the first row of a partition takes the last one of
    the partition before it, found on one row per partition.
    """
    parts = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    last = parts.groupBy("_p").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_e"))
    carry = last.withColumn("_c", F.lag("_e").over(Window.orderBy("_p"))).select("_p", "_c")
    inner = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_i", inner).join(carry, "_p").withColumn(
        name, F.when(F.col("_i").isNotNull(), F.col("_i.v")).otherwise(F.col("_c.v"))).drop("_p", "_i", "_c")


def previous_value(df: DataFrame, keys: list[str], order: str, value: str, name: str, chunk: int = 4096) -> DataFrame:
    """Adds the value of the row before, per key, ordered by the number ``order``.

    Windows run inside chunks of the order; the first row of a chunk takes the
    last one of the chunk before it, so a key with most of the rows is split.
    """
    t = df.withColumn("_k", F.floor(F.col(order) / chunk))
    inner = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*keys, "_k").orderBy(order))
    ends = t.groupBy(*keys, "_k").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_e"))
    carry = ends.withColumn("_c", F.lag("_e").over(Window.partitionBy(*keys).orderBy("_k"))).select(*keys, "_k", "_c")
    return t.withColumn("_i", inner).join(carry, [*keys, "_k"]).withColumn(
        name, F.when(F.col("_i").isNotNull(), F.col("_i.v")).otherwise(F.col("_c.v"))).drop("_k", "_i", "_c")


def fill_forward(df: DataFrame, keys: list[str], order: str, value: str, name: str, chunk: int = 4096) -> DataFrame:
    """Adds the last non-NULL value up to each row, per key, by the same chunks."""
    t = df.withColumn("_k", F.floor(F.col(order) / chunk))
    w = Window.partitionBy(*keys, "_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = t.groupBy(*keys, "_k").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_e"))
    back = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_c", F.last("_e", ignorenulls=True).over(back)).select(*keys, "_k", "_c")
    return t.withColumn("_i", F.last(value, ignorenulls=True).over(w)).join(carry, [*keys, "_k"]).withColumn(
        name, F.coalesce("_i", "_c")).drop("_k", "_i", "_c")
