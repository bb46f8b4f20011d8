"""Roll-ups over a hierarchy from states of its leaves; a row is never copied to its ancestors.

Counts and moments of a leaf are small tables.  They are lifted over the closure (leaf, ancestor) and summed there, so what
meets at the root grows with leaves and bins, not with rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BINS = 4096     # first bins for each doubling of the value
FINE = 1 << 20  # second bins inside a first one


def lift(states: DataFrame, closure: DataFrame | None, by: list[str], sums: list[str], key: str = "category_id") -> DataFrame:
    """``states`` of leaves summed for every key and its ancestors, per ``by``; ``closure`` has (key, ancestor)."""
    own = states.select(key, *by, *sums)
    if closure is not None:
        own = own.unionByName(states.join(closure.select(key, "ancestor"), key).select(F.col("ancestor").alias(key), *by, *sums))
    return own.groupBy(key, *by).agg(*[F.sum(c).alias(c) for c in sums])


def _at_rank(bins: DataFrame, targets: DataFrame, key: str, on: list[str], bin_: str) -> DataFrame:
    """For each target the bin that holds its rank, and the rank inside that bin."""
    met = targets.join(bins, [key, *on])
    upto = F.sum("n").over(Window.partitionBy(key, "i", "side").orderBy(bin_))
    return met.withColumn("_upto", upto).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("n") <= F.col("rank"))) \
        .withColumn("rank", F.col("rank") - F.col("_upto") + F.col("n")).drop("_upto", "n")


def lifted_percentiles(values: DataFrame, closure: DataFrame | None, probs: dict[str, float], *, value: str = "v", key: str = "category_id",
                       bins: int = BINS, fine: int = FINE) -> DataFrame:
    """Exact linear-interpolation percentiles of positive values for every key and its ancestors.

    Leaves count their values in bins that are the same for all; lifted, the counts tell which bin holds a wanted rank.
    Only the rows of those bins are looked at again: once more by finer bins, then value by value.  A window sees a root's
    bins or the distinct values of one fine bin, whatever the number of rows below the root.
    """
    rows = values.where(F.col(value) > 0).select(key, F.col(value).cast("double").alias("v")).withColumn("b1", F.floor(F.log2("v") * bins).cast("int"))
    counted = rows.groupBy(key, "b1").agg(F.count(F.lit(1)).alias("n"))
    lifted = lift(counted, closure, ["b1"], ["n"], key)
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("i"), F.lit(float(p)).alias("p"), F.lit(s).alias("side")) for n, p in probs.items() for s in (0, 1)]))
    totals = lifted.groupBy(key).agg(F.sum("n").alias("_n")).select(key, "_n", wanted.alias("t")).select(key, "t.i", "t.side", (F.col("t.p") * (F.col("_n") - 1)).alias("pos"))
    targets = totals.withColumn("rank", F.when(F.col("side") == 0, F.floor("pos")).otherwise(F.ceil("pos")))
    first = cut_lineage(_at_rank(lifted, targets, key, [], "b1"))
    pairs = first.select(key, "b1").distinct()
    if closure is not None:
        pairs = pairs.unionByName(pairs.join(closure.select(F.col(key).alias("_leaf"), F.col("ancestor").alias(key)), key).select(F.col("_leaf").alias(key), "b1")).distinct()
    inner = F.floor((F.col("v") / F.pow(F.lit(2.0), F.col("b1") / bins) - 1) * fine)
    bracket = rows.join(pairs, [key, "b1"], "left_semi").withColumn("b2", inner).groupBy(key, "b1", "b2", "v").agg(F.count(F.lit(1)).alias("n"))
    second = _at_rank(lift(bracket, closure, ["b1", "b2"], ["n"], key), first, key, ["b1"], "b2")
    third = _at_rank(lift(bracket, closure, ["b1", "b2", "v"], ["n"], key), second, key, ["b1", "b2"], "v")
    end = lambda n, s: F.max(F.when((F.col("i") == n) & (F.col("side") == s), F.col("v")))
    part = lambda n: F.max(F.when(F.col("i") == n, F.col("pos") - F.floor("pos")))
    return third.groupBy(key).agg(*[(end(n, 0) + (end(n, 1) - end(n, 0)) * part(n)).alias(n) for n in probs])


def lifted_moments(rows: DataFrame, closure: DataFrame | None, columns: list[str], key: str = "category_id") -> DataFrame:
    """Row count, means and population deviations for every key and its ancestors.

    Leaf means and squared deviations are merged around the joint mean, not from raw squares.
    """
    leaf = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(p + c) for c in columns for f, p in ((F.avg, "m_"), (F.var_pop, "q_"))])
    sums = leaf.select(key, "n", *[(F.col("m_" + c) * F.col("n")).alias("s_" + c) for c in columns])
    top = lift(sums, closure, [], ["n", *["s_" + c for c in columns]], key).select(
        key, F.col("n").alias("n_samples"), *[(F.col("s_" + c) / F.col("n")).alias(c + "_mean") for c in columns])
    ways = leaf.select(key, F.col(key).alias("_leaf"))
    if closure is not None:
        ways = ways.unionByName(leaf.join(closure, key).select(F.col("ancestor").alias(key), F.col(key).alias("_leaf")))
    met = ways.join(top, key).join(leaf.withColumnRenamed(key, "_leaf"), "_leaf")
    spread = lambda c: F.sqrt(F.sum(F.col("n") * (F.col("q_" + c) + F.pow(F.col("m_" + c) - F.col(c + "_mean"), 2))) / F.first("n_samples"))
    return met.groupBy(key).agg(F.first("n_samples").alias("n_samples"), *[F.first(c + "_mean").alias(c + "_mean") for c in columns],
                                *[spread(c).alias(c + "_std") for c in columns])
