"""Lexicon versions in files: every version a snapshot, one of them active, changed by publishing a new state.

The state names the folder of the versions table and the active version.  A version's ``snapshot_json`` maps its tables
to data folders; tables that a version does not change are its parent's folders.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon as lx
from ..schemas import VERSION_SCHEMA
from .versions import VersionLog

TABLES = ("categories", "affinity", "prompts", "aliases", "priors", "negative_samples")


def _state(spark: SparkSession, path: str) -> tuple[VersionLog, int, dict, DataFrame]:
    log = VersionLog(spark, path)
    number, entry = log.current()
    versions = log.read(entry["versions"]) if entry else spark.createDataFrame([], VERSION_SCHEMA)
    return log, number, entry, versions


def _commit(log: VersionLog, number: int, versions: DataFrame, active: dict) -> None:
    log.publish(number + 1, {"versions": log.write(versions), "active": active})


def versions(spark: SparkSession, path: str) -> DataFrame:
    return _state(spark, path)[3]


def active_version(spark: SparkSession, path: str) -> DataFrame:
    """The one row (id, version_id, activated_at) of the active version, or none."""
    active = VersionLog(spark, path).current()[1].get("active") or {}
    rows = [(1, active["version_id"], active["activated_at"])] if active else []
    return spark.createDataFrame(rows, "id int, version_id string, activated_at long")


def create_version(spark: SparkSession, path: str, version_id: str, tables: dict[str, DataFrame], now: int, *, changeset: str = "", evidence: str = "",
                   parent: str | None = None, status: str = "pending", activate: bool = False) -> None:
    """Store ``tables`` as version ``version_id``; a version of that id is replaced, and no longer activated.

    Without a ``parent`` the latest other version is it.
    """
    log, number, entry, old = _state(spark, path)
    others = old.where(F.col("version_id") != version_id)
    if parent is None:
        parent = others.agg(F.max_by("version_id", F.struct("created_at", "version_id"))).first()[0]
    inherited = others.where(F.col("version_id") == parent).select("snapshot_json").first()
    folders = {**(json.loads(inherited[0]) if inherited else {}), **{n: log.write(df) for n, df in tables.items()}}
    row = spark.createDataFrame([(version_id, parent, json.dumps(folders), changeset, evidence, status, now, now if activate else None)], VERSION_SCHEMA)
    _commit(log, number, others.unionByName(row), {"version_id": version_id, "activated_at": now} if activate else entry.get("active"))


def activate(spark: SparkSession, path: str, version_id: str, now: int) -> bool:
    """Make a stored version the active one; False, and no new state, if it is unknown."""
    log, number, _, old = _state(spark, path)
    if old.where(F.col("version_id") == version_id).isEmpty():
        return False
    _commit(log, number, lx.activate_version(old, version_id, now), {"version_id": version_id, "activated_at": now})
    return True


def roll_back(spark: SparkSession, path: str, version_id: str, now: int) -> str | None:
    """Activate the parent of ``version_id`` and name it; None without a stored parent."""
    row = versions(spark, path).where(F.col("version_id") == version_id).select("parent_version_id").first()
    parent = row[0] if row else None
    return parent if parent is not None and activate(spark, path, parent, now) else None


def expire(spark: SparkSession, path: str, cutoff: int) -> int:
    """Drop versions never activated and created before ``cutoff``, with the data no other version uses; their number.

    States before this one can no longer be read afterwards.
    """
    log, number, entry, old = _state(spark, path)
    kept = lx.drop_stale_versions(old, cutoff)
    dropped = old.join(kept.select("version_id"), "version_id", "left_anti")
    n = dropped.count()
    if n:
        folder = lambda df: df.select(F.explode(F.map_values(F.from_json("snapshot_json", "map<string,string>"))).alias("folder")).distinct()
        unused = [r["folder"] for r in folder(dropped).join(folder(kept), "folder", "left_anti").collect()]
        _commit(log, number, kept, entry.get("active"))
        for name in (*unused, entry["versions"]):
            log.remove(name)
    return n


def load(spark: SparkSession, path: str, version_id: str | None = None) -> dict[str, DataFrame]:
    """Tables of a version, the active one unless another is named; empty without it."""
    log, _, entry, known = _state(spark, path)
    if version_id is None:
        version_id = (entry.get("active") or {}).get("version_id")
    row = known.where(F.col("version_id") == version_id).select("snapshot_json").first()
    return {n: log.read(f) for n, f in json.loads(row[0]).items()} if row else {}
