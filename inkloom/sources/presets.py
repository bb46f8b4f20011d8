"""Preset files: listing, validation, print integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inks import PRINT_CONDITIONS


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """One row per preset file: file name and its whole JSON text."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("file"), F.col("value").alias("text"))


def parsed(presets: DataFrame) -> DataFrame:
    """Adds the open-schema value ``v``; broken texts have none.

    Checking a text costs far more than reading it, so texts are dealt over all shuffle partitions first: a small file is one split.
    """
    dealt = presets.repartition(int(presets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumn("v", F.try_parse_json("text"))


def _get(v: Column, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(v, path, typ)


def _kind(v: Column) -> Column:
    """Type of a value: number, string, boolean, list, object or null; NULL when absent."""
    s = F.schema_of_variant(v)
    return F.when(s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean") \
        .when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "object").when(s == "VOID", "null").otherwise(s)


def list_presets(presets: DataFrame) -> DataFrame:
    """Name, titles, class count and output modes of every readable preset."""
    p = parsed(presets).where("v IS NOT NULL")
    v = F.col("v")
    mode = F.coalesce(_get(v, "$.output.mode", "string"), F.lit("design"))
    desc = _get(v, "$.description", "string")
    return p.select(F.coalesce(_get(v, "$.preset_name", "string"), F.col("file")).alias("name"),
                    F.coalesce(_get(v, "$.display_name", "string"), desc, F.col("file")).alias("display_name"),
                    F.coalesce(desc, F.lit("")).alias("description"),
                    F.coalesce(F.size(_get(v, "$.ai_semantic_classes", "array<variant>")), F.lit(0)).alias("semantic_classes"),
                    F.when(mode == "both", F.lit("design,plate")).otherwise(mode).alias("output_modes"))


def _issue(cond: Column, text) -> Column:
    return F.when(cond, text if isinstance(text, Column) else F.lit(text))


def _class_issues(v: Column) -> Column:
    items = F.coalesce(_get(v, "$.ai_semantic_classes", "array<variant>"), F.array().cast("array<variant>"))

    def region_issues(c: Column, tag: Column, key: str) -> Column:
        reg = _get(c, f"$.{key}")
        many = _kind(_get(reg, "$[0]")) == "list"
        regs = F.when(_kind(reg).isNull() | (_kind(reg) == "null"), F.array().cast("array<variant>")) \
            .when(many, _get(reg, "$", "array<variant>")).otherwise(F.array(reg))

        def check(r: Column) -> Column:
            cells = _get(r, "$", "array<variant>")
            ok = (F.size(cells) == 4) & F.forall(cells, lambda x: _kind(x) == "number")
            inside = F.forall(_get(r, "$", "array<double>"), lambda x: x.between(0.0, 1.0))
            return F.when(~F.coalesce(ok, F.lit(False)), F.concat(tag, F.lit(f".{key} 必须是 4 元归一化数值"))) \
                .when(~F.coalesce(inside, F.lit(False)), F.concat(tag, F.lit(f".{key} 取值应在 [0,1]")))

        return F.transform(regs, check)

    def one(c: Column, i: Column) -> Column:
        tag = F.concat(F.lit("ai_semantic_classes["), i.cast("string"), F.lit("]"))
        name, layer, prompt = (F.nullif(_get(c, f"$.{k}", "string"), F.lit("")) for k in ("name", "layer_name", "prompt"))
        shown = F.coalesce(name, layer, F.lit("None"))
        own = F.array(_issue(name.isNull() & layer.isNull(), F.concat(tag, F.lit(" 缺少 name/layer_name"))),
                      _issue(prompt.isNull(), F.concat(tag, F.lit("（"), shown, F.lit("）缺少 prompt"))))
        listed = F.concat(own, region_issues(c, tag, "region"), region_issues(c, tag, "regions"))
        return F.when(_kind(c) == "object", listed).otherwise(F.array(F.concat(tag, F.lit(" 必须是对象"))))

    return F.flatten(F.transform(items, one))


# The issue texts below.
def preset_issues(v: Column) -> Column:
    """All problems of one preset, in the order the checks run."""
    at = lambda p: _get(v, p)
    kind = lambda p: _kind(at(p))
    there = lambda p: kind(p).isNotNull() & (kind(p) != "null")
    top = [_issue(kind(f"$.{k}").isNotNull() & (kind(f"$.{k}") != "number"), f"{k} 必须是数值") for k in ("super_res_scale", "dpi")]
    top.append(_issue((kind("$.super_res_scale") == "number") & (_get(v, "$.super_res_scale", "double") <= 0), "super_res_scale 必须 > 0"))
    mode = _get(v, "$.mode", "string")
    top.append(_issue(kind("$.mode").isNotNull() & ~F.coalesce(mode.isin("locked", "auto", "hybrid"), F.lit(False)),
                      F.concat(F.lit("mode 必须是 ['auto', 'hybrid', 'locked'] 之一，实际 '"), F.coalesce(mode, F.lit("")), F.lit("'"))))
    top.append(_issue(kind("$.auto_evolve").isNotNull() & (kind("$.auto_evolve") != "boolean"), "auto_evolve 必须是布尔"))
    sem = kind("$.layer_semantics")
    top += [_issue(there("$.layer_semantics") & (sem != "object"), "layer_semantics 必须是对象"),
            _issue(there("$.layer_semantics.name_mapping") & (kind("$.layer_semantics.name_mapping") != "object"), "layer_semantics.name_mapping 必须是对象"),
            _issue(there("$.layer_semantics.layer_attributes") & (kind("$.layer_semantics.layer_attributes") != "list"), "layer_semantics.layer_attributes 必须是列表"),
            _issue(there("$.ai_semantic_classes") & (kind("$.ai_semantic_classes") != "list"), "ai_semantic_classes 必须是列表")]
    dr = [_issue(there("$.density_refine") & (kind("$.density_refine") != "object"), "density_refine 必须是对象"),
          _issue(there("$.density_refine.classes") & (kind("$.density_refine.classes") != "object"), "density_refine.classes 必须是 对象(图层名→{floor})")]
    floors = F.transform(F.map_entries(F.coalesce(_get(v, "$.density_refine.classes", "map<string,variant>"), F.create_map().cast("map<string,variant>"))),
                         lambda e: F.when(~F.coalesce(_kind(_get(e["value"], "$.floor")) == "number", F.lit(False)),
                                          F.concat(F.lit("density_refine.classes['"), e["key"], F.lit("'] 缺少数值 floor"))))
    po = [_issue(there("$.plate_operators") & (kind("$.plate_operators") != "object"), "plate_operators 必须是对象")]
    for op in ("contour_protection", "micro_holes", "trapping"):
        p = f"$.plate_operators.{op}"
        po.append(_issue(there(p) & (kind(p) != "object"), f"plate_operators.{op} 必须是对象"))
        po.append(_issue(kind(f"{p}.enabled").isNotNull() & (kind(f"{p}.enabled") != "boolean"), f"plate_operators.{op}.enabled 必须是布尔"))
        if op == "trapping":
            po.append(_issue((_get(v, f"{p}.enabled", "boolean") == F.lit(True)) & F.nullif(_get(v, f"{p}.spot_layer_name", "string"), F.lit("")).isNull(),
                             "plate_operators.trapping 启用时须提供 spot_layer_name"))
    every = F.concat(F.array(*top), _class_issues(v), F.array(*dr), floors, F.array(*po))
    return F.when(_kind(v) == "object", F.array_compact(every)).otherwise(F.array(F.lit("preset 根必须是对象")))


def print_integrity(presets: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Missing print parameters of presets that make plates: (file, issue)."""
    v = F.col("v")
    mode = F.lower(F.coalesce(_get(v, "$.output.mode", "string"), F.lit("design")))
    p = parsed(presets).select("file", "v", mode.alias("mode"), F.nullif(_get(v, "$.icc_path", "string"), F.lit("")).alias("icc"),
                               F.nullif(_get(v, "$.print_condition", "string"), F.lit("")).alias("cond"), _get(v, "$.output.color_mode", "string").alias("cm"))
    if files is not None:
        p = p.join(files.select(F.col("path").alias("icc"), F.lit(True).alias("_f")).distinct(), "icc", "left")
    else:
        p = p.withColumn("_f", F.lit(True))
    plate = F.col("v").isNotNull() & F.col("mode").isin("plate", "both")
    issues = F.array_compact(F.array(
        _issue(F.col("v").isNull(), "unreadable"), _issue(plate & F.col("icc").isNull(), "icc_missing"),
        _issue(plate & F.col("icc").isNotNull() & F.col("_f").isNull(), "icc_not_found"),
        _issue(plate & F.col("cond").isNotNull() & ~F.col("cond").isin(*PRINT_CONDITIONS), "print_condition_unknown"),
        _issue(F.col("v").isNotNull() & (F.col("mode") == "plate") & F.col("cm").isNotNull() & (F.col("cm") != "cmyk"), "color_mode_not_cmyk")))
    return p.select("file", F.explode(issues).alias("issue"))
