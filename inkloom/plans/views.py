"""Projections of the given tables onto the columns the operators expect.

Each projection is one SQL text; Spark runs it over the parquet tables and the
checking SQL inlines the same text as a CTE.  Two spellings differ between the
dialects and are filled in by :func:`_dialect`.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_VIEWS: dict[str, str] = {}

_VIEWS["episode_index"] = """
SELECT vec_id AS task_id, embedding, label % 2 = 0 AS audit_passed, label AS family FROM {embeddings}"""

_VIEWS["detections"] = """
SELECT user_id AS episode_id, event_id AS seq,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS category_id,
  CASE WHEN event_id % 21 = 0 THEN '' ELSE event_type || '_layer' END AS layer_name,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE 'p' || JSON_K(props) END AS prompt,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 500e0 END AS confidence,
  LIST_OF(value / 500e0, value / 1000e0) AS logits,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS quality_gate_passed,
  CASE event_id % 5 WHEN 3 THEN false WHEN 4 THEN true ELSE NULL END AS diffuse_gate_passed,
  CASE WHEN event_id % 10 = 1 THEN 'area over budget' END AS quality_gate_reason,
  CASE WHEN event_id % 10 = 3 THEN 'bbox too wide' END AS diffuse_gate_reason,
  (event_id % 97) / 97e0 AS cx, (event_id % 89) / 89e0 AS cy,
  (1 + event_id % 31) / 64e0 AS w, (1 + event_id % 29) / 64e0 AS h
FROM {events}"""

_VIEWS["prompts"] = """
SELECT DISTINCT event_type AS category_id, 'p' || JSON_K(props) AS prompt,
  (CAST(JSON_K(props) AS INT) % 8) / 4e0 AS weight,
  CASE WHEN CAST(JSON_K(props) AS INT) % 2 = 0 THEN 'en' ELSE 'zh' END AS lang,
  CASE WHEN CAST(JSON_K(props) AS INT) % 11 = 0 THEN 'shadow' ELSE 'seed' END AS source,
  CAST(JSON_K(props) AS INT) % 3 AS n_accept, CAST(JSON_K(props) AS INT) % 4 AS n_reject
FROM {events}"""

_VIEWS["affinity"] = """
SELECT s.s_suppkey AS category_id, n.n_name AS material_family,
  round(greatest(0e0, least(1e0, s.s_acctbal / 10000e0)), 4) AS affinity
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey"""

_VIEWS["categories"] = """
SELECT 'r' || r_regionkey AS id, CAST(NULL AS STRING_T) AS parent_id, r_name AS name_zh, r_name AS name_en,
  '01_' || r_name AS name_template, 1e0 AS confidence, CAST(NULL AS BIGINT) AS deleted_at FROM {region}
UNION ALL
SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'Nation_' || n_nationkey, '02_' || n_name || '_x', 0.95e0,
  CAST(NULL AS BIGINT) FROM {nation}
UNION ALL
SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, 'Sup_' || s_suppkey, 'NN_' || s_name,
  (s_suppkey % 10) / 10e0, CASE WHEN s_suppkey % 10 = 0 THEN CAST(1700000000 AS BIGINT) END FROM {supplier}"""

_VIEWS["boxes"] = """
SELECT l_suppkey AS episode_id, 's' || (l_partkey % 40) AS category_id,
  l_discount + 0.01e0 AS w, l_quantity / 50e0 AS h FROM {lineitem}"""

_VIEWS["inks"] = """
SELECT l_suppkey AS image_id, l_orderkey AS y, l_partkey AS x,
  CAST(CAST(floor(l_quantity * 5) AS BIGINT) % 256 AS INT) AS c,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) % 256 AS INT) AS m,
  CAST(l_partkey % 256 AS INT) AS yl, CAST(l_orderkey % 256 AS INT) AS k FROM {lineitem}"""

_VIEWS["pixels"] = """
SELECT CAST(o_orderkey % 5 AS INT) AS image_id, CAST(floor(o_orderkey / 100) AS INT) AS y,
  CAST(floor((o_orderkey % 100) / 5) AS INT) AS x,
  CAST((o_orderkey * 13 + o_custkey) % 256 AS INT) AS b, CAST((o_custkey * 7) % 256 AS INT) AS g,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INT) AS r,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INT) AS gray FROM {orders}"""

_VIEWS["canvases"] = """
SELECT image_id, CAST(max(y) + 1 AS INT) AS h, CAST(max(x) + 1 AS INT) AS w FROM {pixels} GROUP BY image_id"""

# layer name -> predicate over one pixel
MASK_LAYERS = {
    "03_seal_01": "gray < 60",
    "03_seal_02": "gray < 62",
    "04_trees": "gray >= 100 AND gray < 160",
    "05_cliffs": "gray >= 140 AND gray < 200",
    "08_geese_01": "gray >= 200 AND x >= 5 AND x <= 8",
    "10_frame": "x < 2 OR x >= 18",
    "13_Spot": "gray % 2 = 0",
}
_VIEWS["mask_px"] = " UNION ALL ".join(
    f"SELECT image_id, '{name}' AS layer, y, x FROM {{pixels}} WHERE {pred}" for name, pred in MASK_LAYERS.items())

_VIEWS["audits"] = """
SELECT p_partkey AS task_id, round(p_retailprice / 1e6, 6) AS lost_ratio, p_size / 10e0 AS rmse_raw,
  p_size / 25e0 AS rmse_lowfreq, p_partkey % 17 <> 0 AS plate_purity_ok,
  280e0 + p_size AS tac_max_pct, CAST(p_size + 3 AS INT) AS n_layers, p_partkey % 19 <> 0 AS passed,
  p_partkey % 23 <> 0 AS dim_a, p_partkey % 29 <> 0 AS dim_b FROM {part}"""

_VIEWS["baseline"] = """
SELECT task_id, round(lost_ratio * (1 + (task_id % 5 - 2) / 20e0), 6) AS lost_ratio,
  rmse_raw * (1 + (task_id % 7 - 3) / 30e0) AS rmse_raw, rmse_lowfreq * (1 + (task_id % 3 - 1) / 12e0) AS rmse_lowfreq,
  true AS plate_purity_ok, CASE WHEN task_id % 31 = 0 THEN 0e0 ELSE tac_max_pct END AS tac_max_pct,
  CAST(n_layers + task_id % 4 AS INT) AS n_layers, task_id % 3 <> 0 AS passed, true AS dim_a, task_id % 2 = 0 AS dim_b
FROM {audits}"""

_VIEWS["log_lines"] = "SELECT conv_id AS task_id, turn AS seq, text AS message FROM {conversations}"

# runs: one per order; its layers are the order's line items
_VIEWS["runs"] = """
SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'plate' WHEN 'O' THEN 'design' ELSE 'both' END AS output_mode,
  CAST(1001 + 2 * (o_custkey % 350) AS INT) AS src_w, CAST(601 + 2 * (o_custkey % 250) AS INT) AS src_h,
  CAST(4000 + CAST(floor(o_totalprice) AS BIGINT) % 9000 AS INT) AS out_w,
  CAST(CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE 2000 + o_orderkey % 3000 END AS INT) AS out_h,
  CAST(CASE WHEN o_orderkey % 211 = 0 THEN 0 ELSE 150 END AS DOUBLE) AS ppi,
  o_orderpriority = '1-URGENT' AS generative_stage FROM {orders}"""

_VIEWS["run_layers"] = """
SELECT l_orderkey AS run_id, 'layer_' || l_partkey AS name, l_returnflag = 'R' AS generated,
  l_linestatus = 'F' AS filled, CAST(l_linenumber * 10 AS INT) AS lft, CAST(l_linenumber * 5 AS INT) AS top,
  CAST(l_quantity * 40 AS INT) AS rgt, CAST(l_suppkey % 900 AS INT) AS btm,
  l_discount AS recon_ratio, CAST(floor(l_extendedprice) AS BIGINT) AS recon_pixels, l_tax AS tax,
  l_linenumber AS seq FROM {lineitem}"""

_VIEWS["episodes"] = """
SELECT 'ep_' || o_orderkey AS episode_id, o_orderkey AS seq,
  CASE o_orderstatus WHEN 'F' THEN 'plate' WHEN 'O' THEN 'design' ELSE 'both' END AS output_mode,
  'fam' || (o_custkey % 6) AS material_family, 'preset' || (o_custkey % 4) AS preset,
  o_orderkey % 9 <> 0 AS has_report, o_custkey AS k1, CAST(floor(o_totalprice) AS BIGINT) AS k2 FROM {orders}"""

_VIEWS["aliases"] = """
SELECT 'n' || (p_partkey % 25) AS category_id, p_name AS preset_name, p_size AS priority FROM {part}"""

_VIEWS["layer_names"] = """
SELECT CASE p_partkey % 4 WHEN 0 THEN '07_Sup_' || (p_partkey % 100)
  WHEN 1 THEN '03A_' || p_name || '_Nation_' || (p_partkey % 25)
  WHEN 2 THEN p_name ELSE 'zz_' || p_type END AS name, p_partkey AS seq FROM {part}"""

_VIEWS["versions"] = """
SELECT 'v' || event_id AS version_id, CASE WHEN event_id % 10 = 0 THEN 'v0' END AS parent_version_id,
  CAST(1700000000 + (event_id * 7919) % 1000003 AS BIGINT) AS created_at,
  CASE WHEN event_id % 4 = 0 THEN CAST(1710000000 + event_id AS BIGINT) END AS activated_at,
  event_type AS changeset FROM {events}"""

_VIEWS["file_names"] = "SELECT doc_id, source, lang, n_chars, text FROM {documents}"


def _dialect(sql: str, spark: bool) -> str:
    if spark:
        sql = re.sub(r"JSON_K\((\w+)\)", r"get_json_object(\1, '$.k')", sql)
        return sql.replace("LIST_OF(", "array(").replace("STRING_T", "STRING")
    sql = re.sub(r"JSON_K\((\w+)\)", r"json_extract_string(\1, '$.k')", sql)
    return sql.replace("LIST_OF(", "list_value(").replace("STRING_T", "VARCHAR")


def _refs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


VIEW_SQL = {n: _dialect(s, False).format(**{r: r for r in _refs(s)}) for n, s in _VIEWS.items()}
VIEW_DEPENDENCIES = {n: tuple(r for r in _refs(s) if r in _VIEWS) for n, s in _VIEWS.items()}


class Views:
    """Lazy access to tables and projections of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["_made"]
        if name in made:
            return made[name]
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in _VIEWS:
            text = _VIEWS[name]
            df = self.spark.sql(_dialect(text, True), **{r: getattr(self, r) for r in _refs(text)})
        else:
            raise AttributeError(name)
        made[name] = df
        return df

    @cached_property
    def masks(self) -> DataFrame:
        """``mask_px`` in one pass over the pixels instead of one scan per layer."""
        from pyspark.sql import functions as F

        hits = F.array(*[F.when(F.expr(p), F.lit(n)) for n, p in MASK_LAYERS.items()])
        return (self.pixels.withColumn("layer", F.explode(F.array_compact(hits)))
                .select("image_id", "layer", "y", "x"))
