"""From banding buckets to groups: candidates without all pairs, verification, distributed union-find.

A node's standing is the number of others it shares buckets with; the centre of a group of copies has the highest. Every
node is first compared with the best-placed node it shares a bucket with. After the links found so far are merged, a bucket
whose members are all in one component is done. In the others a few leaders, best-placed first, are compared with the members of
other components and then leave the bucket, as nothing is open for them any more; pairs that both know their distance to
the same node and cannot be near by the triangle inequality are left out. What then is still open is handed to ``rest``,
which compares it block by block inside the tasks. So each pair of a bucket is compared, ruled out, or already in one
component, and a group of n copies costs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import _contract as contract
from .store import stored


def shared_buckets(buckets: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """(key, node, standing) of the buckets with two nodes or more; counted before the shuffle, so a hot bucket is no hot task.

    ``size`` is (key, n) of these buckets, where it is known already.
    """
    size = size if size is not None else stored(buckets.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b"), F.count(F.lit(1)).alias("n"))
                  .where("_a <> _b").select("key", "n"), "sizes")
    inside = stored(buckets.join(size, "key"), "buckets")
    standing = stored(inside.groupBy("node").agg(F.sum("n").alias("standing")), "standing")
    return stored(inside.select("key", "node").join(standing, "node"), "buckets")


def group(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], threshold: float, *, rest: Callable[[DataFrame], DataFrame],
          settle: Callable[[DataFrame], DataFrame] | None = None, widths: tuple[int, ...] = (8,)) -> DataFrame:
    """(node, root) of every node with a verified link; root is the smallest node of its component.

    ``buckets`` is what ``shared_buckets`` gives; ``verify`` takes distinct pairs (a, b) and returns them with their
    similarity, one minus which must be a metric. ``settle`` does so after the first round and may leave out pairs below
    ``threshold``. ``rest`` takes (key, node, root) and returns links (a, b).
    """
    best = buckets.groupBy("key").agg(F.max(F.struct("standing", "node")).alias("_top"))
    near = buckets.join(stored(best, "tops"), "key").groupBy("node").agg(F.max("_top").alias("_top")).select("node", F.col("_top.node").alias("leader"))
    pairs = near.where("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    met = stored(verify(pairs), "met")
    near_at = lambda x: F.greatest(x, F.lit(threshold)) == x
    links = met.where(near_at(F.col("similarity"))).select("a", "b")
    roots = contract(links, [])
    far = near.select("node", "leader", F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")) \
        .join(met, ["a", "b"], "left").select("node", F.col("leader").alias("pivot"), (1 - F.coalesce("similarity", F.lit(1.0))).alias("far"))
    live = buckets.join(stored(far, "far"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    step = 0
    while True:
        open_ = stored(live.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("key"), "open")
        live = stored(live.join(open_, "key"), "live")
        if step == len(widths) or live.isEmpty():
            break
        rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("standing"), F.desc("node")))  # cut to the width before the shuffle
        leaders = stored(live.withColumn("_r", rank).where(F.col("_r") <= widths[step])
                         .select("key", F.col("node").alias("_l"), F.col("root").alias("_lr"), F.col("pivot").alias("_lp"), F.col("far").alias("_lf")), "leaders")
        may = (F.col("root") != F.col("_lr")) & ((F.col("pivot") != F.col("_lp")) | (F.abs(F.col("far") - F.col("_lf")) <= 1 - threshold + 1e-9))
        pairs = live.join(leaders, "key").where(may).select(F.least("_l", "node").alias("a"), F.greatest("_l", "node").alias("b")).distinct()
        live = live.join(leaders.select("key", F.col("_l").alias("node")), ["key", "node"], "left_anti")
        roots, live = merged(roots, live, stored((settle or verify)(pairs).where(near_at(F.col("similarity"))).select("a", "b"), "links"))
        step += 1
    if live.isEmpty():
        return roots
    return merged(roots, live, stored(rest(live.select("key", "node", "root")), "links"))[0]


def merged(roots: DataFrame, live: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``roots`` and ``live`` after further links: what these join has one root again, so it is not compared any more."""
    at = lambda side: links.join(roots.select(F.col("node").alias(side), F.col("root").alias("_" + side)), side, "left")
    over = at("a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("_b")), "b", "left") \
        .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()
    tops = contract(over, [])  # only what joins components known before
    top = tops.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    moved = roots.join(top, "root", "left").select("node", F.coalesce("_top", "root").alias("root")).unionByName(tops)
    return stored(moved, "roots"), live.join(top, "root", "left").withColumn("root", F.coalesce("_top", "root")).drop("_top")


def cells(live: DataFrame, block: int) -> DataFrame:
    """``live`` dealt into cells of at most about two blocks of a bucket, so that any two members meet in some cell."""
    size = stored(live.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n")), "sizes")
    own = F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")
    return live.join(size, "key").withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))) \
        .withColumn("cell", F.least("_own", "_with") * F.col("_n") + F.greatest("_own", "_with")).drop("_n", "_with")
