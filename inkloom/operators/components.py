"""Connected components of pixel masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ROW_BITS = 24


def _label_tile(ys: np.ndarray, xs: np.ndarray, codes: np.ndarray, diagonal: bool) -> np.ndarray:
    """Smallest pixel code of each pixel's component inside one tile."""
    y0, x0 = ys.min(), xs.min()
    h, w = ys.max() - y0 + 1, xs.max() - x0 + 1
    slot = np.full((h + 2, w + 2), -1, dtype=np.int64)
    order = np.argsort(codes)
    slot[ys[order] - y0 + 1, xs[order] - x0 + 1] = np.arange(len(order))
    cy, cx = ys[order] - y0 + 1, xs[order] - x0 + 1
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    pairs = [(np.flatnonzero(slot[cy + dy, cx + dx] >= 0), dy, dx) for dy, dx in steps]
    a = np.concatenate([i for i, _, _ in pairs])
    b = np.concatenate([slot[cy[i] + dy, cx[i] + dx] for i, dy, dx in pairs])
    lab = np.arange(len(order))
    while len(a):
        low = np.minimum(lab[a], lab[b])
        nxt = lab.copy()
        # hook both ends and their current roots, then shorten the chains
        for end in (a, b, lab[a], lab[b]):
            np.minimum.at(nxt, end, low)
        while True:
            short = nxt[nxt]
            if np.array_equal(short, nxt):
                break
            nxt = short
        if np.array_equal(nxt, lab):
            break
        lab = nxt
    out = np.empty(len(order), dtype=np.int64)
    out[order] = codes[order][lab]
    return out


def _contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Star contraction: (keys, node, root) with root the smallest node of each component.

    Alternates the two star steps until nothing changes; every step is joins and
    mins, so a node with very many neighbours is aggregated before the shuffle
    and split by the adaptive join.
    """
    cur, mark = cut_lineage(edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                            .where("u <> v").distinct()), None
    while True:
        state = cur.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or (state["n"], state["s"]) == mark:
            return cur.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (state["n"], state["s"])
        both = cur.select(*keys, F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
            cur.select(*keys, F.col("v").alias("a"), F.col("u").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        least_ = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least_, [*keys, "u"]).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        cur = cut_lineage(small.unionByName(least_.select(*keys, "u", F.col("m").alias("v"))).distinct())


def connected_components(mask: DataFrame, keys: tuple[str, ...] = ("image_id", "layer"), *, diagonal: bool = True,
                         tile: int = 256) -> DataFrame:
    """Adds ``label``, the smallest (y, x) code of the component a pixel belongs to.

    Pixels are labelled inside square tiles, one bounded group each; then only
    components that meet across tile borders go through rounds over the cluster.
    """
    ks = list(keys)
    fits = F.col("x").between(0, (1 << ROW_BITS) - 1)
    code = F.when(fits, F.shiftleft(F.col("y").cast("long"), ROW_BITS) + F.col("x")) \
        .otherwise(F.raise_error(F.lit(f"x outside 0 to {(1 << ROW_BITS) - 1}")).cast("long"))
    px = mask.select(*ks, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).withColumn("_c", code) \
        .withColumn("_ty", F.floor(F.col("y") / tile)).withColumn("_tx", F.floor(F.col("x") / tile))
    types = {f.name: f.dataType.simpleString() for f in px.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in ks) + ", y int, x int, label long"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(label=_label_tile(pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["_c"].to_numpy(), diagonal))
        return pdf[[*ks, "y", "x", "label"]]

    local = cut_lineage(px.groupBy(*ks, "_ty", "_tx").applyInPandas(solve, schema))
    edge = (F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1)
    border = local.where(edge)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    looks = border.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))) \
        .select(*ks, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), F.col("label").alias("a"))
    met = looks.join(border.withColumnRenamed("label", "b"), [*ks, "y", "x"]).where("a <> b").select(*ks, "a", "b")
    roots = _contract(met, ks).withColumnRenamed("node", "label")
    return local.join(roots, [*ks, "label"], "left").select(*ks, "y", "x", F.coalesce("root", "label").alias("label"))


def component_stats(labelled: DataFrame, keys: tuple[str, ...] = ("image_id", "layer")) -> DataFrame:
    """Area, box (left, top, width, height) and centroid of every component."""
    return labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("lft"), F.min("y").alias("top"),
        (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def keep_components(labelled: DataFrame, stats: DataFrame, keys: tuple[str, ...] = ("image_id", "layer")) -> DataFrame:
    return labelled.join(stats.select(*keys, "label"), [*keys, "label"], "left_semi")


def drop_small(mask: DataFrame, min_area: int, keys: tuple[str, ...] = ("image_id", "layer"), tile: int = 256) -> DataFrame:
    """Mask without components below ``min_area`` pixels."""
    lab = connected_components(mask, keys, tile=tile)
    big = lab.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_area)
    return keep_components(lab, big, keys).drop("label")
