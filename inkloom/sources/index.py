"""The stored similarity index and the regression baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.episodes import regression_metrics
from .versions import VersionLog, part_folders

KEEP = 8  # states of the index that stay readable
INDEX_SCHEMA = "task_id string, embedding array<float>, audit_passed boolean"


def index_rows(episodes: DataFrame, size: int = 128) -> DataFrame:
    """Index entries of admitted episodes; vectors of another length are left out."""
    return episodes.where(F.size("embedding") == size).select(
        F.col("episode_id").alias("task_id"), "embedding", (F.col("reason") == "ok").alias("audit_passed"))


def _newest(parts: list[DataFrame]) -> DataFrame:
    """The row of the last part that has an id; older parts lose only the ids that came again, and are not grouped."""
    out = parts[0]
    for later in parts[1:]:
        out = out.join(later.select("task_id"), "task_id", "left_anti").unionByName(later)
    return out


def save_index(index: DataFrame, path: str) -> None:
    """Publish a rebuilt index; what streams had added is replaced, their batch numbers stay."""
    log = VersionLog(index.sparkSession, path)
    number, entry = log.current()
    log.publish(number + 1, {**entry, "parts": [log.part(index)]})
    log.forget(KEEP, part_folders)


def upsert_index(rows: DataFrame, path: str, batch: int, stream: str) -> bool:
    """Add one micro-batch of index rows, one per id; newer rows replace older ones of their id.

    Rows and batch number are published together, so a batch that comes again (a replay after a failure) changes nothing
    and gives False.  ``stream`` tells apart queries whose batches are counted on their own.
    """
    log = VersionLog(rows.sparkSession, path)
    number, entry = log.current()
    done = entry.get("batches", {})
    if done.get(stream, -1) >= batch:
        return False
    log.publish(number + 1, {"parts": log.with_part(entry.get("parts", []), rows, _newest), "batches": {**done, stream: batch}})
    log.forget(KEEP, part_folders)
    return True


def load_index(spark: SparkSession, path: str, schema: str = INDEX_SCHEMA) -> DataFrame:
    """The newest published index; empty before the first."""
    log = VersionLog(spark, path)
    parts = log.current()[1].get("parts", [])
    return _newest([log.read(p["folder"]) for p in parts]) if parts else spark.createDataFrame([], schema)


def extract_baseline(tasks: DataFrame, audits: DataFrame, key: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """(baseline rows, tasks without a usable audit).

    ``audits`` has the metrics map per dimension, NULL where a file was broken.
    """
    j = tasks.select(key).join(audits, key, "left")
    good = j.where("metrics IS NOT NULL").select(key, *regression_metrics(F.col("metrics"), F.col("passed")))
    return good, j.where("metrics IS NULL").select(key)
