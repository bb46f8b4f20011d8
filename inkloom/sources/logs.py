"""Episode, task and queue logs: readers, writers and the queries read on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.episodes import patch_records
from ..schemas import EPISODE_SCHEMA
from .versions import VersionLog, part_folders, union

# Manifest files by preference.
MANIFEST_NAMES = ("result.plate.manifest.json", "result.design.manifest.json", "result.manifest.json", "manifest.json")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log folder with a sequence that follows file, then position."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    return raw.select(F.col("value").alias("line"), F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos")).alias("seq"))


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim("line") != "").withColumn(
        "_r", F.from_json("line", EPISODE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def parse_episode_lines(lines: DataFrame) -> DataFrame:
    """Good records of a JSON-lines log; keys outside the schema stay in ``_raw``."""
    rest = [c for c in lines.columns if c != "line"]
    return _parsed(lines).where("_r._corrupt IS NULL AND _r.episode_id IS NOT NULL").select(
        *rest, F.col("line").alias("_raw"), "_r.*").drop("_corrupt")


def corrupt_lines(lines: DataFrame) -> DataFrame:
    """The lines a reader skips, for a reject table."""
    return _parsed(lines).where("_r._corrupt IS NOT NULL").drop("_r")


def newest(episodes: DataFrame, limit: int | None = None, material_family: str | None = None) -> DataFrame:
    """Episodes, newest first; all of them unless ``limit`` is asked for."""
    if material_family is not None:
        episodes = episodes.where(F.col("material_family") == material_family)
    ordered = episodes.orderBy(F.desc("seq"))
    return ordered if limit is None else ordered.limit(limit)


def read_episodes(spark: SparkSession, path: str, limit: int | None = None, material_family: str | None = None) -> DataFrame:
    return newest(parse_episode_lines(read_lines(spark, path)), limit, material_family)


def read_episode_files(spark: SparkSession, path: str) -> DataFrame:
    """``<id>.episode.json`` files in month folders, the month kept as a column."""
    df = spark.read.schema(EPISODE_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "*.episode.json").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.withColumn("month", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2})/", 1))


def preferred(records: DataFrame, key: str) -> DataFrame:
    """One record per id: files before log rows, then the first."""
    return records.groupBy(key).agg(F.min_by(F.struct(*records.columns), F.struct("priority", "seq")).alias("_r")).select("_r.*")


def episode_id(ts: Column, *parts: str) -> Column:
    """``ep_<time>_<hash>``, the same for the same input."""
    digest = F.substring(F.sha1(F.concat_ws("|", *[F.col(p).cast("string") for p in parts])), 1, 12)
    return F.concat(F.lit("ep_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"), digest)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_episodes(episodes: DataFrame, path: str) -> None:
    """Add records to a stored episode log; readers see all of them or none."""
    log = VersionLog(episodes.sparkSession, path)
    number, entry = log.current()
    log.publish(number + 1, {"parts": log.with_part(entry.get("parts", []), episodes, union)})


def stored_episodes(spark: SparkSession, path: str) -> DataFrame:
    log = VersionLog(spark, path)
    return union([log.read(p["folder"]) for p in log.current()[1]["parts"]])


def patch_episodes(patch: DataFrame, path: str, key: str = "episode_id", order: str = "seq", keep: int = 2) -> int:
    """Publish the log with patched records and give the number of ids that were found.

    Fields that a patch leaves NULL stay; of several patches of an id the last value by ``order`` counts, field by
    field.  Fields the log lacks are added.  The ``keep`` newest states stay on disk.
    """
    spark = patch.sparkSession
    log = VersionLog(spark, path)
    number, entry = log.current()
    base = stored_episodes(spark, path)
    fields = [c for c in patch.columns if c not in (key, order)]
    merged = patch.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields])
    for c in fields:
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast(patch.schema[c].dataType))
    found = merged.select(key).join(base.select(key), key, "left_semi").count()
    if found:
        log.publish(number + 1, {"parts": [log.part(patch_records(base, merged, key))]})
        log.forget(keep, part_folders)
    return found


def page_with_total(df: DataFrame, limit: int, offset: int = 0, order: str = "seq") -> DataFrame:
    """Newest rows of one page, each with the total row count.

    The page is cut before the count joins it, so no window spans the table.
    """
    page = df.orderBy(F.desc(order)).offset(offset).limit(limit) if offset else df.orderBy(F.desc(order)).limit(limit)
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("_j", F.lit(1))
    return page.withColumn("_j", F.lit(1)).join(total, "_j").drop("_j")


def preferred_manifest(files: DataFrame, key: str, names: tuple[str, ...] = MANIFEST_NAMES) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("file_name"))
    return files.withColumn("_k", rank).where("_k > 0").groupBy(key).agg(F.min_by("file_name", "_k").alias("file_name"))


def output_files(spark: SparkSession, path: str, mode: str = "both") -> DataFrame:
    """Artifacts of a run folder by candidate name, with size; contents are not read."""
    wanted = {"result.plate.psb": "plate", "result.design.psb": "design"} if mode == "both" else {"result.psb": mode}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])[name]
    kind = F.coalesce(kind, F.when(name.isin(*MANIFEST_NAMES), "manifest"))
    return listed.select("path", "length", name.alias("file_name"), kind.alias("type")).where("type IS NOT NULL")


def image_corpus(spark: SparkSession, path: str, extensions: str = "jpg,jpeg,png") -> DataFrame:
    """Image files with the folder name as label."""
    glob = "*.{" + extensions + "}"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return listed.select("path", "length", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"))


def status_listing(tasks: DataFrame, status: str | None = None, limit: int = 20) -> DataFrame:
    kept = tasks if status is None else tasks.where(F.col("status") == status)
    return kept.orderBy(F.desc("seq")).limit(limit)


def pair_artifacts(artifacts: DataFrame, lines: DataFrame) -> DataFrame:
    """Artifacts of a task with the episode ids its log announces.

    Two artifacts of a two-line run pair by position; any other count goes by
    product line, plates to the first id and designs to the last.
    """
    ids = lines.withColumn("eid", F.regexp_extract("message", r"episode 已归档:\s*(\S+)", 1)).where("eid <> ''")
    ends = ids.groupBy("task_id").agg(F.min_by("eid", "seq").alias("_first"), F.max_by("eid", "seq").alias("_last"),
                                      F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("task_id").orderBy("seq")
    second = ids.withColumn("_r", F.row_number().over(order)).where("_r <= 2").where("_r = 2").select("task_id", F.col("eid").alias("_second"))
    n_arts = artifacts.groupBy("task_id").agg(F.count(F.lit(1)).alias("_arts"), F.min_by("artifact", "seq").alias("_art1"))
    j = artifacts.join(ends, "task_id").join(second, "task_id", "left").join(n_arts, "task_id")
    by_pos = F.col("both_mode") & (F.col("_arts") == 2) & (F.col("_n") >= 2)
    eid = F.when(by_pos, F.when(F.col("artifact") == F.col("_art1"), F.col("_first")).otherwise(F.col("_second"))) \
        .when(F.col("output_mode") == "design", F.col("_last")).otherwise(F.col("_first"))
    return j.withColumn("episode_id", eid).drop("_first", "_last", "_n", "_second", "_arts", "_art1")
