"""Exact grouped percentiles that never hold a whole group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      accuracy: int = 10000) -> DataFrame:
    """Linear-interpolation percentiles, one column per entry of ``probs``.

    A mergeable sketch brackets each wanted rank, rows under the bracket are only
    counted, and just the few values inside it are ordered.  A group with a third
    of all rows therefore sends about ``6 / accuracy`` of its distinct values to
    one task.  A rank outside its bracket stops the job instead of giving a
    wrong value.
    """
    names = list(probs)
    ps = [float(probs[n]) for n in names]
    margin = 3.0 / accuracy
    if not keys:
        return exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, accuracy).drop("_all")
    base = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [max(0.0, p - margin) for p in ps], accuracy).alias("_lo"),
        F.percentile_approx("_v", [min(1.0, p + margin) for p in ps], accuracy).alias("_hi"))
    # small groups are ordered whole: there one rank is wider than the sketch margin
    small = F.col("_n") <= 2 * accuracy
    all_of = lambda v: F.array_repeat(F.lit(v), len(ps))
    sketch = sketch.withColumn("_lo", F.when(small, all_of(float("-inf"))).otherwise(F.col("_lo"))) \
        .withColumn("_hi", F.when(small, all_of(float("inf"))).otherwise(F.col("_hi")))
    joined = base.join(sketch, keys)
    slot = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col("_lo")[i].alias("lo"), F.col("_hi")[i].alias("hi"))
        for i in range(len(ps))]))
    counted = (joined.withColumn("_s", slot).where(F.col("_v") <= F.col("_s.hi"))
               .groupBy(*keys, F.col("_s.i").alias("_i"),
                        F.when(F.col("_v") >= F.col("_s.lo"), F.col("_v")).alias("_v"))
               .agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n")))
    order = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_cum", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    prob = F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("_i") + 1)
    ranked = ranked.withColumn("_pos", prob * (F.col("_n") - 1)).where(F.col("_v").isNotNull())
    at = lambda rank: F.min(F.when(F.col("_cum") > rank, F.col("_v")))
    lo, hi = at(F.floor("_pos")), at(F.ceil("_pos"))
    found = ranked.groupBy(*keys, "_i").agg(
        lo.alias("_a"), hi.alias("_b"), F.first(F.col("_pos") - F.floor("_pos")).alias("_t"))
    val = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("rank outside its bracket"))) \
        .otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t"))
    cols = [F.max(F.when(F.col("_i") == i, val)).alias(n) for i, n in enumerate(names)]
    return found.groupBy(*keys).agg(*cols)


def byte_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Percentiles of an 8-bit column: the aggregate's map has at most 256 entries."""
    return df.groupBy(*keys).agg(*[F.percentile(value, p).alias(n) for n, p in probs.items()])


def join_all(frames: list[DataFrame], keys: list[str], how: str = "left") -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, how), frames)
