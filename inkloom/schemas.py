"""Schemas of the stored records, as DDL text."""

DETECTION = "struct<layer_name:string,category_id:string,prompt:string,boxes:array<array<double>>,logits:array<double>," \
            "num_boxes:int,instance_split:boolean,quality_gate_passed:boolean,quality_gate_reason:string," \
            "diffuse_gate_passed:boolean,diffuse_gate_reason:string>"

EPISODE_SCHEMA = f"""
    episode_id string, timestamp string, material_family string, category_ids array<string>, n_categories int,
    outcome string, confidence double, image_path string, embedding array<float>,
    audit_full struct<psb:string,size:array<int>,layer_count:int,color_mode:string,
        dims:map<string,struct<passed:boolean,evaluated:boolean,na:boolean,metrics:map<string,string>,issues:array<string>>>,
        issues:array<string>,passed:boolean>,
    audit_8d struct<lost_ratio:double,rmse_lowfreq:double,rmse_raw:double,plate_purity_ok:boolean,tac_max_pct:double,
        n_layers:int,passed:boolean>,
    output_mode string, preset string, notes string, dino_detections array<{DETECTION}>, artifact string, _corrupt string"""

CATEGORY_SCHEMA = """id string, name_zh string, name_en string, parent_id string, path string,
    name_template string, confidence double, created_at long, updated_at long, deleted_at long"""
PROMPT_SCHEMA = """id long, category_id string, prompt string, weight double, lang string, source string,
    n_hits int, n_accept int, n_reject int, n_images int, last_hit_at long, created_at long"""
AFFINITY_SCHEMA = "category_id string, material_family string, affinity double"
VERSION_SCHEMA = """version_id string, parent_version_id string, snapshot_json string, changeset string,
    evidence string, regression_status string, created_at long, activated_at long"""
ALIAS_SCHEMA = """category_id string, preset_name string, preset_id string, priority int, source string,
    created_at long, updated_at long"""

PIXEL_COLUMNS = "image_id, y, x, b, g, r"
INK_COLUMNS = "image_id, y, x, c, m, yl, k  (255 = no ink)"
MASK_COLUMNS = "image_id, layer, y, x  (foreground rows only)"
