"""Registered queries on masks, layers and their overlap."""

from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import grid
from ..operators import manifests as mf
from ..operators import masks as mk
from ..operators import rules, runs
from . import raster_sql as rs
from .registry import query
from .views import MASK_LAYERS

_ST = """st AS (SELECT image_id, layer, pixels, pixels / (h * w) AS coverage, x0, y0, x1, y1, (x1 - x0 + 1) * (y1 - y0 + 1) / (h * w) AS bbox_ratio, h, w FROM
 (SELECT image_id, layer, count(*) AS pixels, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM mask_px GROUP BY 1, 2) JOIN canvases USING (image_id))"""
_PAIRS = """n AS (SELECT image_id, layer, count(*) AS n FROM mask_px GROUP BY 1, 2),
pairs AS (SELECT image_id, layer_a, layer_b, inter, a.n + b.n - inter AS union_px, inter / (a.n + b.n - inter) AS iou FROM (SELECT a.image_id, a.layer AS layer_a, b.layer AS layer_b, count(*) AS inter
 FROM mask_px a JOIN mask_px b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x AND a.layer < b.layer GROUP BY 1, 2, 3) p JOIN n a USING (image_id) JOIN n b USING (image_id) WHERE a.layer = layer_a AND b.layer = layer_b)"""
V = ("mask_px", "canvases")


@query("mask_stats_m1", f"WITH {_ST} SELECT image_id, layer, pixels, round(coverage, 6) AS coverage, x0, y0, x1, y1, round(bbox_ratio, 6) AS bbox_ratio FROM st", V)
def _(v):
    s = mk.mask_stats(v.masks, v.canvases)
    return s.withColumn("coverage", F.round("coverage", 6)).withColumn("bbox_ratio", F.round("bbox_ratio", 6))


@query("alpha_fill_m2", "SELECT image_id, round(avg(CASE WHEN gray > 40 THEN 1e0 ELSE 0e0 END), 6) AS alpha_ratio FROM pixels GROUP BY 1", ("pixels",))
def _(v):
    return v.pixels.groupBy("image_id").agg(F.round(F.avg((F.col("gray") > 40).cast("double")), 6).alias("alpha_ratio"))


@query("layer_overlap_j8", f"WITH {_PAIRS} SELECT image_id, layer_a, layer_b, inter, union_px, round(iou, 6) AS iou FROM pairs", V)
def _(v):
    return mk.layer_pairs(v.masks).withColumn("iou", F.round("iou", 6))


@query("duplicate_instances_j9", f"WITH {_PAIRS} SELECT image_id, layer_a, layer_b, round(iou, 6) AS iou FROM pairs WHERE iou > 0.9 AND layer_a LIKE '03_seal%' AND layer_b LIKE '03_seal%'", V)
def _(v):
    return mk.duplicate_instances(v.masks).select("image_id", "layer_a", "layer_b", F.round("iou", 6).alias("iou"))


@query("distinct_instances_j10", """
SELECT image_id, layer, CAST(row_number() OVER (PARTITION BY image_id ORDER BY layer) - 1 AS INT) AS pos FROM (SELECT DISTINCT image_id, layer FROM mask_px WHERE layer <> '03_seal_02')""", V)
def _(v):
    order = v.masks.select("image_id", "layer").distinct().withColumn("seq", F.substring("layer", 1, 2).cast("int"))
    return mk.keep_distinct_instances(order, v.masks)


_RULE = "rule AS (SELECT image_id, layer, y, x FROM mask_px WHERE y >= 20 AND layer <> '10_frame')"
_NAMES = [*MASK_LAYERS, "06_moon"]  # the last has no pixel anywhere
_LISTED = f"""lst AS (SELECT image_id, layer FROM canvases, (VALUES {', '.join(f"('{n}')" for n in _NAMES)}) t(layer)),
ls AS (SELECT image_id, layer, coalesce(pixels, 0) AS pixels, coalesce(coverage, 0) AS coverage, coalesce(bbox_ratio, 0) AS bbox_ratio, c.h, c.w FROM lst JOIN canvases c USING (image_id) LEFT JOIN st USING (image_id, layer))"""


def _listed(v):
    return v.canvases.select("image_id", F.explode(F.array(*[F.lit(n) for n in _NAMES])).alias("layer"))


@query("mask_gates_p10_p11", f"""WITH {_ST}, {_LISTED}, {_RULE}, r AS (SELECT image_id, layer, count(*) AS rp FROM rule GROUP BY 1, 2), i AS (SELECT image_id, layer, count(*) AS ip FROM mask_px JOIN rule USING (image_id, layer, y, x) GROUP BY 1, 2)
SELECT image_id, layer, pixels, round(bbox_ratio, 6) AS bbox_ratio, CASE WHEN pixels = 0 THEN 'empty' WHEN pixels / (h * w) > CASE layer WHEN '03_seal_01' THEN 0.015e0 WHEN '03_seal_02' THEN 0.015e0 WHEN '04_trees' THEN 0.2e0 WHEN '05_cliffs' THEN 0.25e0
 WHEN '08_geese_01' THEN 0.06e0 WHEN '10_frame' THEN 0.35e0 ELSE 0.15e0 END THEN 'over_budget' WHEN rp > 0 AND pixels / rp > 3 AND coalesce(ip, 0) / (pixels + rp - coalesce(ip, 0)) < 0.02 THEN 'drifted' END AS quality_reason,
 CASE WHEN layer <> '10_frame' AND bbox_ratio > 0.5 THEN 'diffuse' END AS diffuse_reason FROM ls LEFT JOIN r USING (image_id, layer) LEFT JOIN i USING (image_id, layer)""", V)
def _(v):
    rule = v.masks.where("y >= 20 AND layer <> '10_frame'")
    return mk.gate(v.masks, rule, v.canvases, _listed(v)).select("image_id", "layer", "pixels", F.round("bbox_ratio", 6).alias("bbox_ratio"), "quality_reason", "diffuse_reason")


def _against(v, base):
    """Stats and overlap of every listed layer, also without pixels or baseline, and its IoU."""
    layers = _listed(v)
    j = mk.mask_stats(v.masks, v.canvases, layers).drop("pixels").join(mk.overlap_with_rule(v.masks, base, layers), ["image_id", "layer"])
    return j, F.col("inter") / (F.col("pixels") + F.col("rule_pixels") - F.col("inter"))


_BASE = """bn AS (SELECT image_id, layer, count(*) AS b FROM base GROUP BY 1, 2), bi AS (SELECT image_id, layer, count(*) AS ip FROM mask_px JOIN base USING (image_id, layer, y, x) GROUP BY 1, 2),
j AS (SELECT *, CASE WHEN b IS NOT NULL THEN coalesce(ip, 0) / (pixels + b - coalesce(ip, 0)) END AS iou FROM ls LEFT JOIN bn USING (image_id, layer) LEFT JOIN bi USING (image_id, layer))"""


@query("mask_diagnostics_p26", f"""WITH {_ST}, {_LISTED}, base AS (SELECT image_id, CASE layer WHEN '13_Spot' THEN '06_moon' ELSE layer END AS layer, y, x FROM mask_px WHERE y % 2 = 0 AND layer <> '05_cliffs' AND (layer <> '04_trees' OR x < 2)), {_BASE}
SELECT image_id, layer, CASE WHEN f = '' THEN 'OK' ELSE f END AS verdict FROM (SELECT image_id, layer, array_to_string(list_filter([CASE WHEN coverage < 1e-5 THEN 'EMPTY' WHEN layer <> '10_frame' AND coverage > 0.15 THEN 'OVERFLOW' END,
 CASE WHEN layer <> '10_frame' AND bbox_ratio > 0.6 THEN 'BBOX_TOO_LARGE' END, CASE WHEN iou < 0.1 THEN 'SEMANTIC_DRIFT' END], lambda s: s IS NOT NULL), ',') AS f FROM j)""", V)
def _(v):
    base = v.masks.where("y % 2 = 0 AND layer <> '05_cliffs' AND (layer <> '04_trees' OR x < 2)").replace({"13_Spot": "06_moon"}, subset=["layer"])
    j, iou = _against(v, base)
    return j.select("image_id", "layer", rules.mask_verdicts(F.col("layer"), F.col("coverage"), F.col("bbox_ratio"), iou).alias("verdict"))


@query("layer_vs_baseline_p32", f"""WITH {_ST}, {_LISTED}, base AS (SELECT image_id, CASE layer WHEN '13_Spot' THEN '06_moon' ELSE layer END AS layer, y, x FROM mask_px WHERE y % 16 = 0 AND layer <> '05_cliffs'), {_BASE}
SELECT image_id, layer, CASE WHEN f = '' THEN 'OK' ELSE f END AS verdict FROM (SELECT image_id, layer, array_to_string(list_filter([CASE WHEN coverage < 1e-5 THEN 'EMPTY' END, CASE WHEN layer <> '10_frame' AND coverage > 0.15 THEN 'OVERFLOW' END,
 CASE WHEN layer <> '10_frame' AND bbox_ratio > 0.6 THEN 'BBOX_TOO_LARGE' END, CASE WHEN iou < 0.1 AND pixels > 0 AND (pixels / b > 10 OR pixels / b < 0.1) THEN CASE WHEN layer = '10_frame' THEN 'DRIFT' ELSE 'IMBALANCE' END END], lambda s: s IS NOT NULL), ',') AS f FROM j)""", V)
def _(v):
    base = v.masks.where("y % 16 = 0 AND layer <> '05_cliffs'").replace({"13_Spot": "06_moon"}, subset=["layer"])
    j, iou = _against(v, base)
    return j.select("image_id", "layer", rules.baseline_verdicts(F.col("layer"), F.col("pixels"), F.col("rule_pixels"), F.col("coverage"), F.col("bbox_ratio"), iou).alias("verdict"))


_ALLOWED = ["04_trees", "10_frame"]


@query("allow_list_p13", """
SELECT image_id, count(DISTINCT layer) FILTER (layer IN ('04_trees', '10_frame')) AS kept_layers, count(DISTINCT layer) FILTER (layer NOT IN ('04_trees', '10_frame')) AS dropped_layers,
 count(*) FILTER (layer IN ('04_trees', '10_frame')) = 0 AS all_dropped, count(DISTINCT (y, x)) FILTER (layer NOT IN ('04_trees', '10_frame')) AS rejected_ink FROM mask_px GROUP BY 1""", V)
def _(v):
    ink = mk.allow_layers(v.masks, _ALLOWED)[1].groupBy("image_id").agg(F.count(F.lit(1)).alias("rejected_ink"))
    return mk.allow_report(v.masks, _ALLOWED).join(ink, "image_id", "left")


@query("pixel_union_u1_u7", "SELECT DISTINCT image_id, y, x FROM mask_px WHERE layer <> '13_Spot'", V)
def _(v):
    m = v.masks.where(~rules.has_any(F.col("layer"), rules.PROCESS_LAYERS))
    return mk.pixel_union(m.where("layer LIKE '0%'"), m.where("layer NOT LIKE '0%'"))


_INK = """med AS (SELECT image_id, quantile_cont(gray, 0.5) AS med FROM pixels GROUP BY 1), fg AS (SELECT DISTINCT image_id, y, x FROM mask_px WHERE layer NOT IN ('10_frame', '13_Spot')),
ink AS (SELECT image_id, y, x FROM pixels JOIN med USING (image_id) WHERE gray < med - 12 UNION SELECT image_id, y, x FROM fg)"""
VI = ("mask_px", "canvases", "pixels")


def _content(v):
    return v.masks.where("layer <> '13_Spot'")


@query("ink_pixels_u8", f"WITH {_INK} SELECT * FROM ink", VI)
def _(v):
    return mk.ink_pixels(v.pixels, _content(v))


@query("seam_free_ink_u8", """WITH med AS (SELECT image_id, quantile_cont(gray, 0.5) AS med FROM pixels GROUP BY 1)
SELECT image_id, y, x FROM (SELECT image_id, y, x FROM pixels JOIN med USING (image_id) WHERE gray < med - 12 UNION SELECT image_id, y, x FROM mask_px WHERE layer IN ('04_trees', '08_geese_01'))
 ANTI JOIN (SELECT image_id, y, x FROM mask_px WHERE layer = '05_cliffs' OR layer = '03_seal_01') USING (image_id, y, x)
UNION SELECT image_id, y, x FROM mask_px WHERE layer = '03_seal_02'""", VI)
def _(v):
    m = v.masks.where("layer IN ('04_trees', '08_geese_01')").unionByName(
        v.masks.where("layer IN ('05_cliffs', '03_seal_01')").withColumn("layer", F.lit("fold_seam")))
    return mk.ink_pixels(v.pixels, m, v.masks.where("layer = '03_seal_02'"))


@query("ink_residue_u2", f"""WITH {_INK}, rest AS (SELECT * FROM ink ANTI JOIN (SELECT image_id, y, x FROM mask_px WHERE layer IN ('04_trees', '05_cliffs')) USING (image_id, y, x))
SELECT rest.* FROM rest JOIN (SELECT image_id, count(*) AS n FROM rest GROUP BY 1) USING (image_id) JOIN canvases USING (image_id) WHERE n > 0.001 * h * w""".replace("SELECT rest.* FROM rest", "SELECT image_id, y, x FROM rest"), VI)
def _(v):
    return mk.residue(mk.ink_pixels(v.pixels, _content(v)), v.masks.where("layer IN ('04_trees', '05_cliffs', '10_frame')"), v.canvases)


@query("roi_clip_u5", "SELECT m.* FROM mask_px m SEMI JOIN (SELECT image_id, y, x FROM pixels WHERE r > g) p USING (image_id, y, x)", VI)
def _(v):
    return mk.clip_to_roi(v.masks, v.pixels.where("r > g")).select("image_id", "layer", "y", "x")


@query("content_loss_j20_m15", f"""WITH {_INK}, er AS (SELECT image_id, y, x FROM pixels WHERE b > 128), u AS (SELECT DISTINCT image_id, y, x FROM mask_px WHERE layer IN ('04_trees', '10_frame')),
f AS (SELECT p.image_id, i.y IS NOT NULL AS i, e.y IS NOT NULL AS e, u.y IS NOT NULL AS u FROM pixels p LEFT JOIN ink i ON (i.image_id, i.y, i.x) = (p.image_id, p.y, p.x) LEFT JOIN er e ON (e.image_id, e.y, e.x) = (p.image_id, p.y, p.x) LEFT JOIN u ON (u.image_id, u.y, u.x) = (p.image_id, p.y, p.x))
SELECT image_id, greatest(1, count(*) FILTER (i)) AS ink_px, count(*) FILTER (i AND e AND NOT u) AS lost_px, round(count(*) FILTER (i AND e AND NOT u) / greatest(1, count(*) FILTER (i)), 6) AS lost_ratio,
 round(100e0 * count(*) FILTER (e) / count(*), 2) AS erased_pct, round(100e0 * count(*) FILTER (u) / count(*), 2) AS union_pct, round(100e0 * count(*) FILTER (i AND e) / greatest(1, count(*) FILTER (i)), 3) AS ink_erased_pct,
 count(*) FILTER (i AND e AND NOT u) / greatest(1, count(*) FILTER (i)) <= 0.02 AS passed FROM f GROUP BY 1""", VI)
def _(v):
    carriers = v.masks.where("layer IN ('04_trees', '10_frame', '13_Spot')")
    return mk.content_loss(mk.ink_pixels(v.pixels, _content(v)), v.pixels.where("b > 128"), carriers, v.canvases)


@query("layer_stack_k1", """
WITH c AS (SELECT image_id, layer, avg(y) AS cy FROM mask_px GROUP BY 1, 2), z AS (SELECT image_id, layer, CASE layer WHEN '03_seal_01' THEN 90 WHEN '03_seal_02' THEN 90 WHEN '04_trees' THEN 50 WHEN '05_cliffs' THEN 40 WHEN '08_geese_01' THEN 75 WHEN '10_frame' THEN 100 ELSE 50 END + cy / h * 3e0 AS z FROM c JOIN canvases USING (image_id))
SELECT image_id, layer, round(z, 6) AS z_index, 'NORMAL' AS blend_mode, 255 AS opacity, CAST(row_number() OVER (PARTITION BY image_id ORDER BY z DESC, layer) AS INT) AS rank FROM z""", V)
def _(v):
    return mk.layer_stack(v.masks, v.canvases).withColumn("z_index", F.round("z_index", 6))


_CONF = """conf(name) AS (VALUES ('04_trees'), ('seal'), ('10_frame_outer'), ('water'), ('Spot')),
prod AS (SELECT DISTINCT image_id, layer FROM mask_px WHERE layer NOT IN ('13_Spot')), rej AS (SELECT DISTINCT image_id, layer FROM mask_px WHERE layer = '13_Spot')"""


def _coverage(v):
    layers = v.masks.select("image_id", "layer").distinct()
    conf = v.canvases.select("image_id", F.explode(F.array(*[F.lit(n) for n in ("04_trees", "seal", "10_frame_outer", "water", "Spot")])).alias("name"))
    prod = layers.where("layer <> '13_Spot'").withColumn("pos", F.substring("layer", 1, 2).cast("int")).withColumn(
        "source", F.when(F.contains("layer", F.lit("seal")), "blob_instance").otherwise("sam"))
    rej = layers.where("layer = '13_Spot'").withColumn("reason", F.lit("diffuse"))
    return mk.coverage(conf, prod, rej), prod


@query("class_coverage_j18", f"""WITH {_CONF}
SELECT image_id, name, CASE WHEN p IS NOT NULL THEN 'produced' WHEN r IS NOT NULL THEN 'rejected' ELSE 'missing' END AS status, p AS layer, CASE WHEN p LIKE '%seal%' THEN 'blob_instance' WHEN p IS NOT NULL THEN 'sam' END AS source, CASE WHEN p IS NULL AND r IS NOT NULL THEN 'diffuse' END AS reason
FROM (SELECT c.image_id, name, (SELECT min(layer) FROM prod WHERE prod.image_id = c.image_id AND (contains(layer, name) OR contains(name, layer))) AS p, (SELECT min(layer) FROM rej WHERE rej.image_id = c.image_id AND (contains(layer, name) OR contains(name, layer))) AS r FROM canvases c, conf)""", V)
def _(v):
    return _coverage(v)[0]


@query("extra_layers_j18", f"WITH {_CONF} SELECT image_id, layer FROM prod WHERE layer NOT IN ('04_trees', '03_seal_01', '10_frame')", V)
def _(v):
    cov, prod = _coverage(v)
    return mk.extra_layers(cov, prod)


@query("missing_core_j19", """
SELECT o_orderkey AS image_id, c.name FROM orders, (VALUES ('core_1'), ('core_4'), ('core_7')) c(name) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND 'core_' || l_linenumber = c.name)""")
def _(v):
    core = v.orders.select(F.col("o_orderkey").alias("image_id"), F.explode(F.array(F.lit("core_1"), F.lit("core_4"), F.lit("core_7"))).alias("name"))
    det = v.lineitem.select(F.col("l_orderkey").alias("image_id"), F.concat(F.lit("core_"), "l_linenumber").alias("layer"))
    return mk.missing_core(core, det)


_R = [("a", 0.1, 0.1, 0.5, 0.4), ("b", 0.3, 0.2, 0.9, 0.8)]
IN_REG = "reg AS (" + " UNION ALL ".join(
    f"SELECT image_id, y, x, '{n}' AS region FROM pixels JOIN canvases USING (image_id) WHERE x >= floor({a}e0 * w) AND x < floor({c}e0 * w) AND y >= floor({b}e0 * h) AND y < floor({d}e0 * h)" for n, a, b, c, d in _R) + ")"


@query("pixels_in_regions_j15", f"WITH {IN_REG} SELECT * FROM reg", ("pixels", "canvases"))
def _(v):
    return mk.in_regions(v.pixels, v.canvases, _R).select("image_id", "y", "x", "region")


@query("recon_masks_m34", """
SELECT image_id, layer, w AS mask_w, h AS mask_h, count(*) AS recon_pixel_count, round(count(*) / (h * w), 6) AS recon_ratio FROM mask_px JOIN canvases USING (image_id) GROUP BY image_id, layer, w, h""", V)
def _(v):
    return mf.recon_mask_facts(v.masks, v.canvases)


@query("manifest_layers_p33", """
WITH b AS (SELECT image_id, layer, min(x) AS lft, min(y) AS top, max(x) + 1 AS rgt, max(y) + 1 AS btm FROM mask_px GROUP BY 1, 2), r AS (SELECT image_id, layer, count(*) AS n FROM mask_px WHERE y > 50 AND x < 9 AND layer IN ('04_trees', '05_cliffs') GROUP BY 1, 2),
l AS (SELECT b.*, coalesce(n, 0) AS n FROM b LEFT JOIN r USING (image_id, layer))
SELECT image_id, layer, false AS generated, '' AS generation_reasons, CASE WHEN n > 0 THEN 'deocclusion(telea)' ELSE '' END AS fill_reasons, lft, top, rgt, btm, n AS recon_pixel_count, round(n / (h * w), 6) AS recon_ratio FROM l JOIN canvases USING (image_id)
UNION ALL SELECT image_id, '01_Base_Ground', false, '', 'support_background(telea)', NULL, NULL, NULL, NULL, CAST(sum(n) AS BIGINT), 0 FROM l GROUP BY 1""", V)
def _(v):
    boxes = mk.half_open_boxes(v.masks)
    rec = v.masks.where("y > 50 AND x < 9 AND layer IN ('04_trees', '05_cliffs')").groupBy("image_id", "layer").agg(F.count(F.lit(1)).alias("recon_pixels")) \
        .join(v.canvases, "image_id").select("image_id", "layer", "recon_pixels", (F.col("h") * F.col("w")).alias("mask_pixels"))
    return mf.layer_records(boxes, boxes, rec, support="01_Base_Ground").withColumn("recon_ratio", F.round("recon_ratio", 6))


@query("size_mismatch_x1", """
WITH b AS (SELECT image_id, layer, max(y) - min(y) + 1 AS ph, max(x) - min(x) + 1 AS pw FROM mask_px GROUP BY 1, 2)
SELECT image_id, count(*) FILTER (layer LIKE '04%') AS res_mismatch, count(*) FILTER (layer LIKE '04%') = 0 AS passed FROM b GROUP BY 1""", V)
def _(v):
    boxes = mk.half_open_boxes(v.masks).withColumn("btm", F.when(F.col("layer").like("04%"), F.col("btm") + 1).otherwise(F.col("btm")))
    return au.size_mismatches(boxes, v.masks)


# ---- morphology ------------------------------------------------------------

@query("closed_masks_w7", f"WITH {rs.closing('o', 'mask_px', rs.rect(5, 5))} SELECT * FROM o", V)
def _(v):
    return grid.closing(v.masks, v.canvases, 5, 5).select("image_id", "layer", "y", "x")


@query("opened_masks_w7", f"WITH {rs.opening('o', 'mask_px', rs.rect(2, 2))} SELECT * FROM o", V)
def _(v):
    return grid.opening(v.masks, v.canvases, 2, 2).select("image_id", "layer", "y", "x")


@query("dilated_ellipse_w8", f"WITH {rs.dilate('o', 'mask_px', rs.ellipse(7))} SELECT * FROM o", V)
def _(v):
    return grid.dilate_ellipse(v.masks, v.canvases, 7).select("image_id", "layer", "y", "x")


@query("eroded_ellipse_w8", f"WITH {rs.erode('o', 'mask_px', rs.ellipse(3))} SELECT * FROM o", V)
def _(v):
    return grid.erode_ellipse(v.masks, v.canvases, 3).select("image_id", "layer", "y", "x")


@query("closed_ellipse_w8", f"WITH {rs.closing('o', 'mask_px', rs.ellipse(5))} SELECT * FROM o", V)
def _(v):
    return grid.close_ellipse(v.masks, v.canvases, 5).select("image_id", "layer", "y", "x")


@query("opened_ellipse_w8", f"WITH {rs.opening('o', 'mask_px', rs.ellipse(3))} SELECT * FROM o", V)
def _(v):
    return grid.open_ellipse(v.masks, v.canvases, 3).select("image_id", "layer", "y", "x")


@query("mask_runs_w8", """
WITH g AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, layer, y ORDER BY x) AS g FROM mask_px)
SELECT image_id, layer, y, min(x) AS x0, max(x) AS x1 FROM g GROUP BY image_id, layer, y, g""", V)
def _(v):
    return runs.to_runs(v.masks, v.canvases).select("image_id", "layer", "y", "x0", "x1")


@query("rim_areas_w8", f"""WITH {rs.dilate('wd', 'mask_px', rs.ellipse(5))}, {rs.erode('er', 'mask_px', rs.ellipse(5))}
SELECT image_id, layer, count(*) AS pixels FROM wd ANTI JOIN er USING (image_id, layer, y, x) GROUP BY 1, 2""", V)
def _(v):
    own = runs.to_runs(v.masks, v.canvases)
    return runs.run_area(runs.subtract_runs(runs.dilate_runs(own, grid.ellipse(5)), runs.erode_runs(own, grid.ellipse(5))))


@query("components_g2", f"WITH RECURSIVE {rs.components('cc', 'mask_px')}, {rs.stats('st', 'cc')} SELECT image_id, layer, label, area, lft, top, bw, bh, round(cx, 6) AS cx, round(cy, 6) AS cy FROM st", V)
def _(v):
    from ..operators import components as cc
    st = cc.component_stats(cc.connected_components(v.masks))
    return st.withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))


@query("small_components_removed_g7", f"WITH RECURSIVE {rs.components('cc', 'mask_px')} SELECT image_id, layer, y, x FROM cc JOIN (SELECT image_id, layer, label FROM cc GROUP BY 1, 2, 3 HAVING count(*) >= 8) USING (image_id, layer, label)", V)
def _(v):
    from ..operators import components as cc
    return cc.drop_small(v.masks, 8)
