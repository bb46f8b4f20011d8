"""Registered queries on inks, colour, manifests and layer rules."""

from pyspark.sql import functions as F

from ..functions import color
from ..operators import inks as ik
from ..operators import manifests as mf
from ..operators import rules
from .registry import query

_TAC = "(1020 - c - m - yl - k) / 255.0e0 * 100.0e0"


def _limited(lim=765.0, mk=11, src="inks"):
    """SQL of the limiter for one fixed policy: limit and black cap in codes."""
    return f"""lim1 AS (SELECT *, k < {mk} AS k_over, (1020 - c - m - yl - k - greatest({mk} - k, 0)) > floor({lim}e0) AS over, greatest(k, {mk}) AS k1 FROM {src}),
lim2 AS (SELECT *, least(1e0, greatest({lim}e0 - (255 - k1), 0e0) / greatest(CAST(765 - c - m - yl AS DOUBLE), 1e-6)) AS ratio FROM lim1),
lim AS (SELECT * EXCLUDE (k1, ratio), {', '.join(f"CASE WHEN over THEN CAST(least(255, greatest(0, ceil(255e0 - (255 - {ch}) * ratio))) AS INT) ELSE {ch} END AS {ch}2" for ch in ('c', 'm', 'yl'))},
 CAST(CASE WHEN over AND 255 - k1 > {lim}e0 THEN ceil(255e0 - {lim}e0) ELSE k1 END AS INT) AS k2 FROM lim2)"""


@query("limited_inks_c2", f"WITH {_limited()} SELECT image_id, y, x, c2, m2, yl2, k2, k_over, over FROM lim", ("inks",))
def _(v):
    return ik.limit_ink(v.inks).select("image_id", "y", "x", "c2", "m2", "yl2", "k2", "k_over", "over")


_AFTER = "(1020 - c2 - m2 - yl2 - k2) / 255.0e0 * 100.0e0"
_STATS = f"""round(max({_TAC}), 2) AS tac_before_max, round(avg({_TAC}), 2) AS tac_before_mean, round(max({_AFTER}), 2) AS tac_after_max,
 round(avg({_AFTER}), 2) AS tac_after_mean, count(*) FILTER (over) AS tac_clipped_pixels, round(count(*) FILTER (over) / count(*), 6) AS tac_clipped_ratio,
 count(*) FILTER (k_over) AS k_clipped_pixels, max({_AFTER}) <= 300.000001 AS compliant"""


@query("ink_limit_stats_m12", f"WITH {_limited()} SELECT image_id, {_STATS} FROM lim GROUP BY image_id", ("inks",))
def _(v):
    return ik.limit_stats(ik.limit_ink(v.inks))


@query("tac_audit_m11", f"""
SELECT image_id, round(max({_TAC}), 2) AS tac_max, round(avg({_TAC}), 2) AS tac_mean, round(max((255 - k) / 255.0e0 * 100.0e0), 2) AS max_k_pct,
 round(avg(CASE WHEN {_TAC} > 300 THEN 1e0 ELSE 0e0 END), 6) AS over_limit_ratio, max({_TAC}) <= 300.000001 AS compliant FROM inks GROUP BY 1""", ("inks",))
def _(v):
    return ik.audit_tac(v.inks)


_BOX = "greatest(0e0, least(255e0, {}))"


def _black_sql(gain, gamma, shift=0.0):
    new = _BOX.format(f"pow((255 - k) / 255e0, {gamma}e0) * 255e0 * {gain}e0 + {shift}e0 / 100e0 * 255e0")
    ch = lambda n: f"CAST(floor(255e0 - {_BOX.format(f'(255 - {n}) - (nk - (255 - k))')}) AS INT) AS {n}3"
    return f"SELECT image_id, y, x, {ch('c')}, {ch('m')}, {ch('yl')}, CAST(floor(255e0 - nk) AS INT) AS k3 FROM (SELECT *, {new} AS nk FROM inks)"


@query("black_generation_c3", _black_sql(1.15, 0.9, 2.0), ("inks",))
def _(v):
    return ik.black_generation(v.inks, 1.15, 0.9, 2.0, suffix="3").select("image_id", "y", "x", "c3", "m3", "yl3", "k3")


@query("naive_separation_c4", "SELECT image_id, y, x, r AS c, g AS m, b AS yl, 255 AS k FROM pixels", ("pixels",))
def _(v):
    c, m, yl, k = color.rgb_to_inverse_cmyk(F.col("b"), F.col("g"), F.col("r"))
    return v.pixels.select("image_id", "y", "x", c.alias("c"), m.alias("m"), yl.alias("yl"), k.alias("k"))


@query("cmyk_appearance_c5", """
SELECT image_id, y, x, round(c * k / 255e0, 6) AS r, round(m * k / 255e0, 6) AS g, round(yl * k / 255e0, 6) AS b FROM inks""", ("inks",))
def _(v):
    r, g, b = color.inverse_cmyk_to_rgb(F.col("c"), F.col("m"), F.col("yl"), F.col("k"))
    return v.inks.select("image_id", "y", "x", F.round(r, 6).alias("r"), F.round(g, 6).alias("g"), F.round(b, 6).alias("b"))


LAB_SQL = """lin AS (SELECT *, {lr} AS lr, {lg} AS lg, {lb} AS lb FROM pixels),
xyz AS (SELECT *, (0.412453e0 * lr + 0.357580e0 * lg + 0.180423e0 * lb) / 0.950456e0 AS cx, 0.212671e0 * lr + 0.715160e0 * lg + 0.072169e0 * lb AS cy,
 (0.019334e0 * lr + 0.119193e0 * lg + 0.950227e0 * lb) / 1.088754e0 AS cz FROM lin),
lab AS (SELECT image_id, y, x, b, g, r, gray, CASE WHEN cy > 0.008856 THEN 116e0 * cbrt(cy) - 16 ELSE 903.3e0 * cy END AS l, 500e0 * ({fx} - {fy}) AS a, 200e0 * ({fy} - {fz}) AS bb FROM xyz),
lab8 AS (SELECT image_id, y, x, b, g, r, gray, CAST(greatest(0, least(255, floor(l * 255e0 / 100e0 + 0.5e0))) AS INT) AS l8,
 CAST(greatest(0, least(255, floor(a + 128.5e0))) AS INT) AS a8, CAST(greatest(0, least(255, floor(bb + 128.5e0))) AS INT) AS b8 FROM lab)""".format(
    **{f"l{ch}": f"CASE WHEN {ch} / 255e0 > 0.04045 THEN pow(({ch} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) ELSE {ch} / 255e0 / 12.92e0 END" for ch in "rgb"},
    **{f"f{ax}": f"CASE WHEN c{ax} > 0.008856 THEN cbrt(c{ax}) ELSE 7.787e0 * c{ax} + 16e0 / 116e0 END" for ax in "xyz"})


@query("gray_and_lab_c6", f"""WITH {LAB_SQL} SELECT image_id, y, x, CAST(floor(0.114e0 * b + 0.587e0 * g + 0.299e0 * r + 0.5e0) AS INT) AS luma, l8, a8, b8 FROM lab8""", ("pixels",))
def _(v):
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    l8, a8, b8 = color.lab8(b, g, r)
    return v.pixels.select("image_id", "y", "x", color.gray(b, g, r).alias("luma"), l8.alias("l8"), a8.alias("a8"), b8.alias("b8"))


@query("hsv_c6", """
WITH s AS (SELECT *, greatest(b, g, r) AS v, CAST(greatest(b, g, r) - least(b, g, r) AS DOUBLE) AS d FROM pixels),
h AS (SELECT *, CASE WHEN d = 0 THEN 0e0 WHEN v = r THEN 60e0 * (g - b) / d WHEN v = g THEN 120e0 + 60e0 * (b - r) / d ELSE 240e0 + 60e0 * (r - g) / d END AS hh FROM s)
SELECT image_id, y, x, CAST(floor((CASE WHEN hh < 0 THEN hh + 360 ELSE hh END) / 2 + 0.5) AS INT) % 180 AS h8,
 CAST(floor(CASE WHEN v = 0 THEN 0 ELSE 255e0 * d / v END + 0.5) AS INT) AS s8, CAST(v AS INT) AS v8 FROM h""", ("pixels",))
def _(v):
    h8, s8, v8 = color.hsv8(F.col("b"), F.col("g"), F.col("r"))
    return v.pixels.select("image_id", "y", "x", h8.alias("h8"), s8.alias("s8"), v8.alias("v8"))


@query("ink_policies_p22", """
WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'newsprint' WHEN 1 THEN 'iso_uncoated' WHEN 2 THEN 'unknown_press' END AS cond,
  CASE WHEN doc_id % 11 = 0 THEN 280 + doc_id % 40 END AS lim, CASE WHEN doc_id % 22 = 0 THEN 93 END AS mk,
  CASE doc_id % 7 WHEN 0 THEN 'PSO Uncoated FOGRA47' WHEN 1 THEN 'News Paper' WHEN 2 THEN 'ISO coated v2' ELSE text END AS descr FROM documents),
q AS (SELECT *, replace(lower(descr), ' ', '') AS d FROM p),
r AS (SELECT *, CASE WHEN cond IN ('newsprint', 'iso_uncoated') THEN cond WHEN contains(d, 'uncoated') OR contains(d, 'fogra47') OR contains(d, 'fogra29') OR contains(d, 'inp') THEN 'iso_uncoated'
  WHEN contains(d, 'news') OR contains(d, 'snp') OR contains(d, 'newspaper') THEN 'newsprint' ELSE 'eci_coated_practice' END AS chosen FROM q)
SELECT doc_id, CASE WHEN lim IS NOT NULL THEN CAST(lim AS DOUBLE) ELSE CASE chosen WHEN 'iso_uncoated' THEN 260e0 WHEN 'newsprint' THEN 240e0 ELSE 300e0 END END AS limit_pct,
 CASE WHEN lim IS NOT NULL THEN coalesce(CAST(mk AS DOUBLE), 97e0) ELSE CASE chosen WHEN 'iso_uncoated' THEN 95e0 WHEN 'newsprint' THEN 90e0 ELSE 96e0 END END AS max_k_pct,
 CASE WHEN lim IS NOT NULL THEN coalesce(cond, 'preset') ELSE chosen END AS condition_id FROM r""")
def _(v):
    d = v.documents.select(
        "doc_id", F.expr("CASE doc_id % 5 WHEN 0 THEN 'newsprint' WHEN 1 THEN 'iso_uncoated' WHEN 2 THEN 'unknown_press' END").alias("cond"),
        F.expr("CASE WHEN doc_id % 11 = 0 THEN 280 + doc_id % 40 END").alias("lim"), F.expr("CASE WHEN doc_id % 22 = 0 THEN 93 END").alias("mk"),
        F.expr("CASE doc_id % 7 WHEN 0 THEN 'PSO Uncoated FOGRA47' WHEN 1 THEN 'News Paper' WHEN 2 THEN 'ISO coated v2' ELSE text END").alias("descr"))
    pol = ik.resolve_policy(F.col("cond"), F.col("lim"), F.col("mk"), F.col("descr"))
    return d.select("doc_id", *[c.alias(n) for n, c in pol.items()])


@query("black_presence_m13", """
SELECT image_id, round(avg(CASE WHEN k / 255e0 < 0.999 THEN 1e0 ELSE 0e0 END) * 100, 1) AS k_channel_nonzero_pct,
 round(avg(CASE WHEN k / 255e0 < 0.5 THEN 1e0 ELSE 0e0 END) * 100, 1) AS k_channel_strong_pct, round(avg(1 - k / 255e0) * 100, 2) AS k_ink_mean_pct FROM inks GROUP BY 1""", ("inks",))
def _(v):
    return ik.black_presence(v.inks)


def _cal_sql():
    arms = " UNION ALL ".join(f"SELECT {i} AS cand, {g}e0 AS gain, {p}e0 AS gamma" for i, (g, p) in enumerate(ik.BLACK_CANDIDATES))
    nk = f"CASE WHEN gain = 1 AND gamma = 1 THEN CAST(255 - k0 AS DOUBLE) ELSE {_BOX.format('pow((255 - k0) / 255e0, gamma) * 255e0 * gain')} END"
    ch = lambda n: f"CAST(floor(255e0 - {_BOX.format(f'(255 - {n}0) - (nk - (255 - k0))')}) AS INT) AS {n}"
    return f"""WITH base AS (SELECT image_id, b, g, r, greatest(b, g, r) AS v, r AS c0, g AS m0, b AS yl0, greatest(b, g, r) AS k0 FROM pixels),
arms AS ({arms}), n AS (SELECT *, {nk} AS nk FROM base, arms),
inks AS (SELECT image_id, cand, gain, gamma, b, g, r, {ch('c')}, {ch('m')}, {ch('yl')}, CAST(floor(255e0 - nk) AS INT) AS k FROM n), {_limited()},
met AS (SELECT image_id, cand, gain, gamma, round(avg((255 - k2) ) / 255e0 * 100, 3) AS k_mean_pct, round(avg(CASE WHEN 255 - k2 > 12.75 THEN 1e0 ELSE 0e0 END) * 100, 2) AS k_nonzero_pct,
 round(max({_AFTER}), 2) AS tac_max_pct, round(sqrt(avg((pow(r - c2 * k2 / 255e0, 2) + pow(g - m2 * k2 / 255e0, 2) + pow(b - yl2 * k2 / 255e0, 2)) / 3)), 3) AS color_rmse
 FROM lim GROUP BY 1, 2, 3, 4)"""


def _calibration(v):
    px = v.pixels.withColumns({"c": F.col("r"), "m": F.col("g"), "yl": F.col("b"), "k": F.greatest("b", "g", "r")})
    return ik.calibrate_black(px)


@query("black_candidates_m30", _cal_sql() + " SELECT * FROM met", ("pixels",))
def _(v):
    return _calibration(v)


@query("black_recommendation_m30", _cal_sql() + """
SELECT image_id, cand, gain, gamma, k_nonzero_pct, color_rmse, CASE WHEN cand = 0 THEN 'keep_identity' ELSE 'tune' END AS action FROM (
 SELECT m.*, row_number() OVER (PARTITION BY m.image_id ORDER BY k_nonzero_pct DESC, color_rmse, cand) AS rn
 FROM met m JOIN (SELECT image_id, color_rmse * 1.15e0 + 1e-6 AS tol FROM met WHERE cand = 0) t USING (image_id) WHERE color_rmse <= tol) WHERE rn = 1""", ("pixels",))
def _(v):
    return ik.recommend_black(_calibration(v))


@query("prepress_inks_x8", f"""
WITH sep AS (SELECT image_id, y, x, r AS c, g AS m, b AS yl, greatest(b, g, r) AS k FROM pixels),
blk AS ({_black_sql(1.2, 0.9).replace('FROM inks', 'FROM sep')}), pol AS (SELECT image_id, c3 AS c, m3 AS m, yl3 AS yl, k3 AS k FROM blk), {_limited(src='pol')}
SELECT image_id, {_STATS} FROM lim GROUP BY image_id""", ("pixels",))
def _(v):
    sep = v.pixels.select("image_id", "y", "x", F.col("r").alias("c"), F.col("g").alias("m"), F.col("b").alias("yl"),
                          F.greatest("b", "g", "r").alias("k"))
    return ik.limit_stats(ik.limit_ink(ik.black_generation(sep, 1.2, 0.9)))


# ---- manifests -------------------------------------------------------------

_SIZE = """SELECT run_id, round(CAST(src_w AS BIGINT) * src_h / 1e6, 3) AS megapixels, round(eff, 2) AS effective_ppi, round(mm, 1) AS physical_width_mm, round(mh, 1) AS physical_height_mm,
 round(fx, 3) AS upscale_factor_x, round(fy, 3) AS upscale_factor_y, round(greatest(fx, fy), 3) AS max_upscale_factor,
 CASE WHEN eff >= 150 THEN 'NATIVE' WHEN eff >= 50 THEN 'MILD' WHEN eff >= 15 THEN 'HEAVY' ELSE 'EXTREME' END AS grade
FROM (SELECT *, CASE WHEN mm = 0 THEN 0 ELSE src_w / (mm / 25.4e0) END AS eff FROM (SELECT *, CASE WHEN ppi = 0 THEN 0 ELSE out_w / ppi * 25.4e0 END AS mm,
 CASE WHEN ppi = 0 THEN 0 ELSE out_h / ppi * 25.4e0 END AS mh, out_w / CAST(src_w AS DOUBLE) AS fx, out_h / CAST(src_h AS DOUBLE) AS fy FROM runs))"""


@query("size_facts_m31_p24", _SIZE, ("runs",))
def _(v):
    return mf.size_facts(v.runs).select("run_id", "megapixels", "effective_ppi", "physical_width_mm", "physical_height_mm",
                                        "upscale_factor_x", "upscale_factor_y", "max_upscale_factor", "grade")


_SHARES = """sh AS (SELECT r.run_id, round(CASE WHEN canvas > 0 THEN least(1e0, coalesce(g, 0) / canvas) ELSE 0 END, 6) AS generated_ratio,
 round(CASE WHEN canvas > 0 THEN least(1e0, coalesce(f, 0) / canvas) ELSE 0 END, 6) AS fill_ratio,
 round(CASE WHEN canvas > 0 THEN least(1e0, coalesce(p, 0) / canvas) ELSE 0 END, 6) AS exact_recon_share
 FROM (SELECT run_id, CAST(out_w AS DOUBLE) * out_h AS canvas FROM runs) r LEFT JOIN (SELECT run_id, sum(CASE WHEN generated THEN part END) AS g,
 sum(CASE WHEN filled AND NOT generated THEN part END) AS f, CAST(sum(recon_pixels) AS BIGINT) AS p FROM (SELECT *, recon_ratio * (greatest(0, rgt - lft) * greatest(0, btm - top)) AS part FROM run_layers) GROUP BY 1) a USING (run_id))"""


@query("area_shares_m19", f"WITH {_SHARES} SELECT * FROM sh", ("runs", "run_layers"))
def _(v):
    return mf.area_shares(v.run_layers, v.runs)


_PURITY = """pu AS (SELECT run_id, message, message IN ('not_plate', 'pure') AS plate_purity_ok FROM (SELECT r.run_id, CASE WHEN output_mode <> 'plate' THEN 'not_plate'
 WHEN coalesce(n, 0) > 0 THEN 'generated_layers:' || n WHEN generative_stage THEN 'generative_stage' ELSE 'pure' END AS message
 FROM runs r LEFT JOIN (SELECT run_id, count(*) FILTER (generated) AS n FROM run_layers GROUP BY 1) USING (run_id)))"""


@query("plate_purity_p23", f"WITH {_PURITY} SELECT * FROM pu", ("runs", "run_layers"))
def _(v):
    return mf.plate_purity(v.run_layers, v.runs)


@query("manifest_totals_m36", f"""WITH {_SHARES}, {_PURITY}
SELECT r.run_id, r.output_mode, sh.* EXCLUDE (run_id), pu.* EXCLUDE (run_id), l.n AS deocclusion_pixel_count, t.tac_max_pct, t.tac_mean_pct
FROM runs r LEFT JOIN sh USING (run_id) LEFT JOIN pu USING (run_id) LEFT JOIN (SELECT run_id, CAST(sum(recon_pixels) AS BIGINT) AS n FROM run_layers GROUP BY 1) l USING (run_id)
LEFT JOIN (SELECT y AS run_id, round(max({_TAC}), 2) AS tac_max_pct, round(avg({_TAC}), 2) AS tac_mean_pct FROM inks GROUP BY 1) t USING (run_id)""", ("runs", "run_layers", "inks"))
def _(v):
    return mf.totals(v.run_layers, v.runs, v.inks.withColumnRenamed("y", "run_id"))


@query("layer_reasons_p31", """
SELECT run_id, name, bool_or(kind = 'generated') AS generated, array_to_string(list_sort(list(DISTINCT reason) FILTER (kind = 'generated')), '|') AS generation_reasons,
 array_to_string(list_sort(list(DISTINCT reason) FILTER (kind = 'fill')), '|') AS fill_reasons
FROM (SELECT l_orderkey AS run_id, 'layer_' || l_linenumber AS name, CASE WHEN l_returnflag = 'R' THEN 'generated' ELSE 'fill' END AS kind, 'stage_' || l_linestatus || (l_suppkey % 4) AS reason FROM lineitem) GROUP BY 1, 2""")
def _(v):
    e = v.lineitem.select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("layer_"), "l_linenumber").alias("name"),
                          F.when(F.col("l_returnflag") == "R", "generated").otherwise("fill").alias("kind"),
                          F.concat(F.lit("stage_"), "l_linestatus", F.col("l_suppkey") % 4).alias("reason"))
    out = mf.reasons_by_kind(e)
    blank = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|")).alias(c)
    return out.select("run_id", "name", "generated", blank("generation_reasons"), blank("fill_reasons"))


@query("valid_layers_m35", """
SELECT run_id, count(*) FILTER (rgt > lft AND btm > top) AS valid_layers, count(*) FILTER (rgt > lft AND btm > top) >= 3 AS passed FROM run_layers GROUP BY 1""", ("run_layers",))
def _(v):
    return mf.valid_layer_count(v.run_layers, 3)


@query("output_sizes_p21", """
SELECT run_id, CAST(CASE WHEN run_id % 3 = 0 THEN out_w ELSE floor(src_w * s) END AS INT) AS w, CAST(CASE WHEN run_id % 3 = 0 THEN out_h ELSE floor(src_h * s) END AS INT) AS h
FROM (SELECT *, coalesce(CASE WHEN run_id % 5 = 1 THEN 2.5e0 END, CASE WHEN run_id % 7 = 1 THEN 3.25e0 END, 4e0) AS s FROM runs)""", ("runs",))
def _(v):
    when = lambda n, r, c: F.when(F.col("run_id") % n == r, c)
    w, h = mf.output_size(F.col("src_w"), F.col("src_h"), when(3, 0, F.col("out_w")), when(3, 0, F.col("out_h")),
                          when(5, 1, F.lit(2.5)), when(7, 1, F.lit(3.25)))
    return v.runs.select("run_id", w.alias("w"), h.alias("h"))


@query("safe_layer_names_c23", r"""
SELECT p_partkey, CASE WHEN s = '' THEN 'layer' ELSE s END || '.png' AS file_name, c AS clean FROM (SELECT p_partkey, c, regexp_replace(regexp_replace(regexp_replace(c, '[\\/:*?"<>|\x00-\x1f]', '_', 'g'), '^[._]+', ''), '[._]+$', '') AS s
 FROM (SELECT p_partkey, trim('  ._' || p_name || CASE p_partkey % 3 WHEN 0 THEN '/a:b*' WHEN 1 THEN '<x>|' ELSE '' END || '  ') AS c FROM part))""")
def _(v):
    raw = F.concat(F.lit("  ._"), "p_name", F.expr("CASE p_partkey % 3 WHEN 0 THEN '/a:b*' WHEN 1 THEN '<x>|' ELSE '' END"), F.lit("  "))
    return v.part.select("p_partkey", mf.safe_file_name(raw).alias("file_name"), mf.clean_layer_name(raw).alias("clean"))


# ---- rules -----------------------------------------------------------------

_NAMES = """nm AS (SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN '10_Seal' WHEN 1 THEN '08_芦雁_Geese_03' WHEN 2 THEN '04_Cliffs_Mountain' WHEN 3 THEN '11A_Brocade_Frame'
 WHEN 4 THEN 'Distant_Cliff' WHEN 5 THEN '11B_Fold_Seam' WHEN 6 THEN '02_water_ripples' WHEN 7 THEN '05_Trees_07' WHEN 8 THEN 'base_gold' WHEN 9 THEN '09_Calligraphy' ELSE p_name END AS name,
 p_size, p_retailprice FROM part)"""


def _named(v):
    return v.part.select(F.col("p_partkey").alias("id"), F.expr("""CASE p_partkey % 12 WHEN 0 THEN '10_Seal' WHEN 1 THEN '08_芦雁_Geese_03' WHEN 2 THEN '04_Cliffs_Mountain'
      WHEN 3 THEN '11A_Brocade_Frame' WHEN 4 THEN 'Distant_Cliff' WHEN 5 THEN '11B_Fold_Seam' WHEN 6 THEN '02_water_ripples' WHEN 7 THEN '05_Trees_07'
      WHEN 8 THEN 'base_gold' WHEN 9 THEN '09_Calligraphy' ELSE p_name END""").alias("name"), "p_size", "p_retailprice")


@query("area_budgets_p9", f"""WITH {_NAMES}
SELECT id, name, round(CASE CASE WHEN id % 12 IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9) THEN id % 12 ELSE -1 END WHEN 0 THEN 0.005e0 WHEN 1 THEN 0.06e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.35e0 WHEN 4 THEN 0.15e0
 WHEN 5 THEN 0.05e0 WHEN 7 THEN 0.6e0 WHEN 9 THEN 0.02e0 ELSE 0.15e0 END, 6) AS budget,
 id % 12 IN (3, 5, 8) AS exempt FROM nm""")
def _(v):
    return _named(v).select("id", "name", F.round(rules.area_budget(F.col("name")), 6).alias("budget"), rules.bbox_exempt(F.col("name")).alias("exempt"))


@query("layer_attributes_p16", f"""WITH {_NAMES}
SELECT id, CASE WHEN contains(lower(name), 'seal') THEN '#C8102E' END AS fixed_color, CASE WHEN contains(lower(name), 'seam') OR contains(lower(name), 'fold') THEN 'MULTIPLY' WHEN contains(lower(name), 'frame') OR contains(lower(name), 'seal') THEN 'NORMAL' END AS blend_mode,
 CASE WHEN contains(lower(name), 'ripple') THEN 120 WHEN contains(lower(name), 'seam') THEN 190 END AS opacity FROM nm""")
def _(v):
    attrs = rules.layer_attributes(F.col("name"), [
        {"match": ["Frame", "Seal"], "blend_mode": "NORMAL"}, {"match": ["seal"], "fixed_color": "#C8102E"},
        {"match": ["Seam", "Fold"], "blend_mode": "MULTIPLY"}, {"match": ["seam"], "opacity": 190}, {"match": ["Ripple"], "opacity": 120}])
    return _named(v).select("id", *[c.alias(n) for n, c in attrs.items()])


@query("display_names_p17", f"""WITH {_NAMES} SELECT id, CASE lower(trim(name)) WHEN '10_seal' THEN '印章_Seal' WHEN 'base_gold' THEN '底板_Base' ELSE name END AS name FROM nm""")
def _(v):
    return _named(v).select("id", rules.display_name(F.col("name"), {"10_seal": "印章_Seal", "base_gold": "底板_Base"}).alias("name"))


@query("canonical_layer_order_k2", f"""WITH {_NAMES}
SELECT id, name, row_number() OVER (ORDER BY coalesce(try_cast(nullif(regexp_extract(name, '^(\\d+)', 1), '') AS INT), 99), upper(regexp_extract(name, '^(\\d+)([A-Za-z]?)', 2)), name, id) AS pos FROM nm""".replace("\\\\d", "\\d"))
def _(v):
    from ..operators.ranking import global_rank
    keyed = _named(v)
    k = rules.canonical_order_key(F.col("name"))
    keyed = keyed.select("id", "name", k[0].alias("k0"), k[1].alias("k1"))
    return global_rank(keyed, ["k0", "k1", "name", "id"], "pos").select("id", "name", "pos")


@query("progress_stages_p18", """
SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)初始化|引擎.*启动|seed') THEN '初始化引擎' WHEN regexp_matches(t, '(?i)CUDA|探活|加载完成|GroundingDINO') THEN '加载模型' WHEN regexp_matches(t, '(?i)分割|DINORadar|语义类') THEN '神经分割'
 WHEN regexp_matches(t, '(?i)超分|RealESRGAN|渐进') THEN '超分重建' WHEN regexp_matches(t, '(?i)补全|LaMa|遮挡') THEN '遮挡补全' WHEN regexp_matches(t, '(?i)ICC|分色|黑版|TAC|陷印|trapping') THEN '制版分色'
 WHEN regexp_matches(t, '(?i)写盘|PSDCompiler|写盘完成|\\.psb') THEN '写盘输出' WHEN regexp_matches(t, '(?i)manifest|掩码|完成|RK-16') THEN '收尾校验' END AS stage
FROM (SELECT doc_id, text || CASE doc_id % 9 WHEN 0 THEN ' seed 42' WHEN 1 THEN '分割' WHEN 2 THEN ' out.psb' WHEN 3 THEN ' Manifest' WHEN 4 THEN ' lama' ELSE '' END AS t FROM documents)""")
def _(v):
    t = F.concat("text", F.expr("CASE doc_id % 9 WHEN 0 THEN ' seed 42' WHEN 1 THEN '分割' WHEN 2 THEN ' out.psb' WHEN 3 THEN ' Manifest' WHEN 4 THEN ' lama' ELSE '' END"))
    return v.documents.select("doc_id", rules.stage_of(t).alias("stage"))


@query("accepted_uploads_p19", """
SELECT doc_id, n_chars * 30000 <= 104857600 AND doc_id % 6 IN (0, 1, 4) AS accepted FROM documents""")
def _(v):
    path = F.concat(F.lit("/up/"), "doc_id", F.expr("CASE doc_id % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.psb' WHEN 2 THEN '.gif' WHEN 3 THEN '' WHEN 4 THEN '.x.png' ELSE '.png.exe' END"))
    return v.documents.select("doc_id", rules.upload_accepted(path, F.col("n_chars") * 30000).alias("accepted"))


@query("preset_recommendations_p20", """
WITH u AS (SELECT o_orderkey AS id, CASE o_custkey % 7 WHEN 0 THEN '金地屏风' WHEN 1 THEN '绢本工笔' WHEN 2 THEN '宣纸水墨' WHEN 3 THEN '油画布' WHEN 4 THEN '织物壁布' WHEN 5 THEN '其他' END AS fam,
 (o_orderkey % 50) / 50e0 AS conf, o_orderkey % 4 = 0 AS panel, CASE WHEN o_orderkey % 13 <> 0 THEN 500 + o_custkey % 1500 END AS w, 900 AS h FROM orders),
c AS (SELECT *, coalesce(fam IN ('金地屏风', '绢本工笔', '宣纸水墨', '油画布', '织物壁布') AND conf >= 0.6, false) AS known, w / 900e0 AS ratio FROM u)
SELECT id, CASE WHEN known AND fam IN ('绢本工笔', '织物壁布') AND panel THEN 'textile_damask_photo' WHEN known THEN CASE fam WHEN '金地屏风' THEN 'japanese_screen_gold' WHEN '油画布' THEN 'western_oil_painting'
  WHEN '织物壁布' THEN 'textile_damask_photo' ELSE 'chinese_ink_landscape_ai' END WHEN ratio BETWEEN 0.85 AND 1.18 THEN 'textile_damask' ELSE 'japanese_screen_gold' END AS preset,
 CASE WHEN known AND fam IN ('绢本工笔', '织物壁布') AND panel THEN 0.85e0 WHEN known THEN round(conf, 2) WHEN w IS NULL THEN 0.5e0 ELSE 0.55e0 END AS confidence, known AS matched,
 CASE WHEN known AND fam IN ('绢本工笔', '织物壁布') AND panel THEN 'panel' WHEN known THEN 'material' WHEN fam IS NOT NULL THEN 'material_low_conf' WHEN w IS NULL THEN 'no_dimensions' ELSE 'aspect' END AS reason FROM c""")
def _(v):
    u = v.orders.select(F.col("o_orderkey").alias("id"), F.expr("CASE o_custkey % 7 WHEN 0 THEN '金地屏风' WHEN 1 THEN '绢本工笔' WHEN 2 THEN '宣纸水墨' WHEN 3 THEN '油画布' WHEN 4 THEN '织物壁布' WHEN 5 THEN '其他' END").alias("fam"),
                        F.expr("(o_orderkey % 50) / 50D").alias("conf"), F.expr("o_orderkey % 4 = 0").alias("panel"),
                        F.expr("CASE WHEN o_orderkey % 13 <> 0 THEN 500 + o_custkey % 1500 END").alias("w"), F.lit(900).alias("h"))
    rec = rules.recommend_preset(F.col("fam"), F.col("conf"), F.col("panel"), F.col("w"), F.col("h"))
    return u.select("id", *[c.alias(n) for n, c in rec.items()])


@query("clamped_params_p25", "SELECT o_orderkey, greatest(0.05e0, least(2e0, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey / 500e0 END, 0.2e0))) AS trap_mm FROM orders")
def _(v):
    return v.orders.select("o_orderkey", rules.get_param(F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey / 500D END"), 0.2, 0.05, 2.0).alias("trap_mm"))


@query("trap_widths_c9", """
SELECT o_orderkey, CAST(greatest(1, round_even((o_custkey % 40) / 20e0 / 25.4e0 * (100 + o_orderkey % 300), 0)) AS INT) AS px FROM orders""")
def _(v):
    return v.orders.select("o_orderkey", rules.trap_width_px(F.expr("(o_custkey % 40) / 20D"), F.col("o_orderkey") % 300 + 100).alias("px"))


@query("candidate_boxes_p12", """
SELECT episode_id, seq, rank FROM (SELECT episode_id, seq, CAST(row_number() OVER (PARTITION BY episode_id, category_id ORDER BY w * h DESC, seq) AS INT) AS rank FROM detections
 WHERE ((cx BETWEEN 0.1 AND 0.5 AND cy BETWEEN 0.2 AND 0.6) OR (cx BETWEEN 0.6 AND 0.9 AND cy BETWEEN 0.0 AND 0.9)) AND w * h <= 0.08) WHERE rank <= 12""", ("detections",))
def _(v):
    return rules.candidate_boxes(v.detections, [(0.1, 0.2, 0.5, 0.6), (0.6, 0.0, 0.9, 0.9)], by=["episode_id", "category_id"], max_boxes=12) \
        .select("episode_id", "seq", "rank")


_FEAT = """(l_partkey % 1000) / 10e0 AS L, (l_suppkey % 30) - 10e0 AS a, (l_orderkey % 450) / 10e0 AS b, l_quantity AS sat, l_discount * 3 AS edge, l_tax * 6 AS glcm,
 CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber / 2e0 + 0.1e0 END AS ent, l_orderkey AS id, l_linenumber AS ln, l_extendedprice AS price"""


def _features(v):
    return v.spark.sql(f"SELECT {_FEAT} FROM {{li}}", li=v.lineitem)


def _score_sql():
    return """sc AS (SELECT *,
 CASE WHEN b > 30 THEN 0.40e0 WHEN b > 20 THEN 0.25e0 WHEN b > 10 THEN 0.10e0 ELSE 0 END + CASE WHEN L >= 75 THEN 0.30e0 WHEN L > 65 THEN 0.15e0 ELSE 0 END + CASE WHEN abs(a) < 15 THEN 0.15e0 ELSE 0 END
  + CASE WHEN sat > 20 AND sat < 55 THEN 0.15e0 ELSE 0 END + CASE WHEN edge > 0.03 AND edge < 0.10 THEN 0.05e0 ELSE 0 END AS s0,
 greatest(0e0, CASE WHEN L > 82 THEN 0.30e0 WHEN L > 60 THEN 0.20e0 ELSE 0 END + CASE WHEN b < 12 THEN 0.30e0 WHEN b < 20 THEN 0.20e0 ELSE 0 END + CASE WHEN edge < 0.10e0 THEN 0.25e0 WHEN edge < 0.16e0 THEN 0.15e0 ELSE 0 END
  + CASE WHEN glcm < 0.22e0 THEN 0.15e0 WHEN glcm < 0.28e0 THEN 0.10e0 ELSE 0 END - CASE WHEN b BETWEEN 14 AND 24 AND sat >= 14 AND glcm >= 0.34e0 AND edge >= 0.08e0 THEN 0.20e0 ELSE 0 END) AS s1,
 CASE WHEN b >= 10 AND b < 30 THEN 0.20e0 WHEN b >= 6 AND b < 36 THEN 0.10e0 ELSE 0 END + CASE WHEN L > 65 AND L < 88 THEN 0.20e0 WHEN L > 58 AND L < 92 THEN 0.10e0 ELSE 0 END + CASE WHEN edge >= 0.16e0 THEN 0.30e0 WHEN edge >= 0.12e0 THEN 0.05e0 ELSE 0 END
  + CASE WHEN edge >= 0.16e0 AND glcm >= 0.28e0 THEN 0.30e0 WHEN edge >= 0.16e0 AND glcm >= 0.22e0 THEN 0.05e0 ELSE 0 END + CASE WHEN b BETWEEN 14 AND 24 AND sat >= 14 AND glcm >= 0.34e0 THEN 0.35e0 WHEN b BETWEEN 14 AND 24 AND sat >= 14 AND glcm >= 0.30e0 AND edge >= 0.08e0 THEN 0.15e0 ELSE 0 END AS s2,
 CASE WHEN sat > 30 THEN 0.4e0 WHEN sat > 20 THEN 0.2e0 ELSE 0 END + CASE WHEN edge > 0.08e0 THEN 0.3e0 WHEN edge > 0.05e0 THEN 0.15e0 ELSE 0 END + CASE WHEN L > 30 AND L < 80 THEN 0.2e0 ELSE 0 END AS s3,
 CASE WHEN NOT (sat < 15 AND b < 15) OR coalesce(ent < 2, false) THEN 0 ELSE CASE WHEN sat < 8 THEN 0.40e0 WHEN sat < 12 THEN 0.25e0 ELSE 0.05e0 END + CASE WHEN b < 8 THEN 0.35e0 WHEN b < 12 THEN 0.20e0 ELSE 0.05e0 END
  + CASE WHEN edge >= 0.12e0 THEN 0.20e0 WHEN edge >= 0.08e0 THEN 0.10e0 ELSE 0 END + CASE WHEN abs(a) < 6 THEN 0.10e0 ELSE 0 END END AS s4 FROM feat),
rs AS (SELECT *, round(s0, 6) AS r0, round(s1, 6) AS r1, round(s2, 6) AS r2, round(s3, 6) AS r3, round(s4, 6) AS r4, round(greatest(s0, s1, s2, s3, s4, 0.3e0), 6) AS top FROM sc)"""


_FAMILY = "CASE top WHEN r0 THEN '金地屏风' WHEN r1 THEN '宣纸水墨' WHEN r2 THEN '绢本工笔' WHEN r3 THEN '油画布' WHEN r4 THEN '织物壁布' ELSE '其他' END"


@query("material_families_c10_k7", f"""WITH feat AS (SELECT {_FEAT} FROM lineitem), {_score_sql()}
SELECT id, ln, price, {_FAMILY} AS family, least(1e0, top) AS confidence FROM rs""")
def _(v):
    f = _features(v)
    s = rules.family_scores(*[F.col(c) for c in ("L", "a", "b", "sat", "edge", "glcm", "ent")])
    fam, conf = rules.classify_family(s)
    return f.select("id", "ln", "price", fam.alias("family"), F.round(conf, 6).alias("confidence"))


@query("family_explanations_p27", """WITH feat AS (SELECT """ + _FEAT + """ FROM lineitem), f AS (SELECT *, CASE id % 6 WHEN 0 THEN '金地屏风' WHEN 1 THEN '宣纸水墨' WHEN 2 THEN '绢本工笔' WHEN 3 THEN '油画布' WHEN 4 THEN '织物壁布' ELSE '其他' END AS family FROM feat)
SELECT id, ln, price, CASE id % 6 WHEN 0 THEN 'L* > 80 ' || CASE WHEN L > 80 THEN '✓' ELSE '✗' END || '; b* > 20 ' || CASE WHEN b > 20 THEN '✓' ELSE '✗' END || '; 15 < sat < 40 ' || CASE WHEN sat > 15 AND sat < 40 THEN '✓' ELSE '✗' END
 WHEN 1 THEN 'L* > 90 ' || CASE WHEN L > 90 THEN '✓' ELSE '✗' END || '; sat < 10 ' || CASE WHEN sat < 10 THEN '✓' ELSE '✗' END || '; edge < 0.03 ' || CASE WHEN edge < 0.03e0 THEN '✓' ELSE '✗' END
 WHEN 2 THEN '70 < L* < 85 ' || CASE WHEN L > 70 AND L < 85 THEN '✓' ELSE '✗' END || '; 10 < sat < 25 ' || CASE WHEN sat > 10 AND sat < 25 THEN '✓' ELSE '✗' END || '; 0.05 < edge < 0.12 ' || CASE WHEN edge > 0.05e0 AND edge < 0.12e0 THEN '✓' ELSE '✗' END
 WHEN 3 THEN 'sat > 30 ' || CASE WHEN sat > 30 THEN '✓' ELSE '✗' END || '; edge > 0.08 ' || CASE WHEN edge > 0.08e0 THEN '✓' ELSE '✗' END
 WHEN 4 THEN 'sat < 12 ' || CASE WHEN sat < 12 THEN '✓' ELSE '✗' END || '; b* < 12 ' || CASE WHEN b < 12 THEN '✓' ELSE '✗' END || '; edge >= 0.08 ' || CASE WHEN edge >= 0.08e0 THEN '✓' ELSE '✗' END
 ELSE 'no family matched' END AS text FROM f""")
def _(v):
    f = _features(v)
    fam = F.expr("CASE id % 6 WHEN 0 THEN '金地屏风' WHEN 1 THEN '宣纸水墨' WHEN 2 THEN '绢本工笔' WHEN 3 THEN '油画布' WHEN 4 THEN '织物壁布' ELSE '其他' END")
    return f.select("id", "ln", "price", rules.explain_family(fam, F.col("L"), F.col("b"), F.col("sat"), F.col("edge")).alias("text"))


@query("histogram_entropy_c11", """
WITH h AS (SELECT l_suppkey, floor(l_quantity / 4) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT l_suppkey, sum(n) + 1e-9 AS t FROM h GROUP BY 1)
SELECT l_suppkey, round(sum(-(n / t) * ln(n / t + 1e-12)), 6) AS entropy FROM h JOIN t USING (l_suppkey) GROUP BY 1""")
def _(v):
    h = v.lineitem.groupBy("l_suppkey", F.floor(F.col("l_quantity") / 4).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    hist = h.groupBy("l_suppkey").agg(F.collect_list("n").alias("hist"))
    return hist.select("l_suppkey", F.round(rules.histogram_entropy(F.col("hist")), 6).alias("entropy"))
