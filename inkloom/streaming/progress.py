"""Task progress: stage, percent, heartbeat and replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import PRESET_SECONDS, stage_of

LOG_SCHEMA = "task_id string, seq long, ts timestamp, message string, preset string"
OUT_SCHEMA = "task_id string, seq long, stage string, progress int, message string, heartbeat boolean"
OUT_COLUMNS = ["task_id", "seq", "stage", "progress", "message", "heartbeat"]
DEFAULT_SECONDS = 240
MAX_PERCENT = 95
HEARTBEAT_MS = 10_000
TTL_MS = 24 * 3600 * 1000
FINAL = ("completed", "failed", "cancelled")
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "")


def read_log_stream(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, files_per_batch: int = 1) -> DataFrame:
    """Tail of a JSON-lines folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def estimate_seconds(preset: str = "preset") -> F.Column:
    table = F.create_map(*[F.lit(x) for kv in PRESET_SECONDS.items() for x in kv])
    return F.coalesce(table[F.col(preset)], F.lit(DEFAULT_SECONDS))


def progress_batch(lines: DataFrame, chunk: int = 4096) -> DataFrame:
    """Stage and percent per log line: the result a stream of the same lines ends with.

    The clock starts at the first line and the percent never falls, also where a line's time lies before the one above
    it.  Empty and null messages are no lines.  A final ``status`` is not looked at: one task id is one run here.

    Windows run inside chunks of the line number; one row per chunk carries the last stage, the latest time and the
    task's first line on, so a task with most of the lines is split.
    """
    kept = lines.where("message <> ''").select("task_id", "seq", "ts", "message", stage_of(F.col("message")).alias("_st"), estimate_seconds().alias("_est"),
                                               F.floor(F.col("seq") / chunk).alias("_k"))
    ends = kept.groupBy("task_id", "_k").agg(F.max_by("_st", F.when(F.col("_st").isNotNull(), F.col("seq"))).alias("_last"), F.max("ts").alias("_high"),
                                             F.min_by(F.struct("ts", "_est"), "seq").alias("_head"))
    order = Window.partitionBy("task_id").orderBy("_k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("task_id", "_k", F.last("_last", ignorenulls=True).over(before).alias("_stage"), F.max("_high").over(before).alias("_until"),
                        F.first("_head").over(order).alias("_first"))
    here = Window.partitionBy("task_id", "_k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    j = kept.withColumns({"_here": F.last("_st", ignorenulls=True).over(here), "_now": F.max("ts").over(here)}).join(carry, ["task_id", "_k"])
    secs = F.greatest("_now", "_until").cast("double") - F.col("_first.ts").cast("double")
    pct = F.greatest(F.lit(0), F.least(F.lit(MAX_PERCENT), F.floor(secs / F.greatest(F.lit(1), F.col("_first._est")) * 100).cast("int")))
    return j.select("task_id", "seq", F.coalesce("_here", "_stage", F.lit("处理中")).alias("stage"), pct.alias("progress"), "message")


class Progress(StatefulProcessor):
    """Start, clock, stage and percent of a task, each a value of its own, and one timer for silence.

    The clock is that of the log: a heartbeat adds the time since the last line arrived to that line's own time.  A line
    with a final status removes all of it, its timer included; a task whose end never comes goes after ``ttl_ms``.
    """

    def __init__(self, heartbeat_ms: int, ttl_ms: int) -> None:
        self.heartbeat_ms, self.ttl_ms = heartbeat_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "start_ms double, estimate int", self.ttl_ms)
        self.clock = handle.getValueState("clock", "line_ms double, arrived_ms long", self.ttl_ms)
        self.stage = handle.getValueState("stage", "stage string", self.ttl_ms)
        self.percent = handle.getValueState("percent", "progress int", self.ttl_ms)

    def _restart_timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, estimate = self.begun.get() if self.begun.exists() else (None, DEFAULT_SECONDS)
        stage = self.stage.get()[0] if self.stage.exists() else None
        progress = self.percent.get()[0] if self.percent.exists() else 0
        ms, out = None, []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            ms = row.ts.timestamp() * 1000.0
            if start is None:
                start, estimate = ms, int(row.estimate)
            stage = row.stage if isinstance(row.stage, str) else stage
            progress = max(progress, percent_at(ms - start, estimate))
            out.append((key[0], row.seq, stage or "处理中", progress, row.message, False))
            if row.final:
                start, estimate, stage, progress = None, DEFAULT_SECONDS, None, 0
        if start is None:  # ended: nothing is kept
            for state in (self.begun, self.clock, self.stage, self.percent):
                state.clear()
            self._restart_timer(None)
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
            self.begun.update((start, estimate))
            self.clock.update((ms, now))
            self.stage.update((stage,))
            self.percent.update((progress,))
            self._restart_timer(now + self.heartbeat_ms)
        yield pd.DataFrame(out, columns=OUT_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not (self.begun.exists() and self.clock.exists()):  # gone by its time to live: the timer ends with it
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        (start, estimate), (line_ms, arrived) = self.begun.get(), self.clock.get()
        stage = self.stage.get()[0] if self.stage.exists() else None
        before = self.percent.get()[0] if self.percent.exists() else 0
        progress = max(before, percent_at(line_ms - start + (now - arrived), estimate))
        if progress > before:
            self.percent.update((progress,))
        self.handle.registerTimer(now + self.heartbeat_ms)
        yield pd.DataFrame([(key[0], None, stage or "计算中", progress, None, True)], columns=OUT_COLUMNS)

    def close(self) -> None:
        pass


def percent_at(elapsed_ms: float, estimate: int) -> int:
    return max(0, min(MAX_PERCENT, int(elapsed_ms / 1000.0 / max(1, estimate) * 100)))


def progress_stream(lines: DataFrame, heartbeat_ms: int = HEARTBEAT_MS, ttl_ms: int = TTL_MS) -> DataFrame:
    """Progress events of a stream of log lines, with a heartbeat after ``heartbeat_ms`` of silence until a task ends.

    A task ends with a line whose ``status`` is one of ``FINAL``, where the lines have that column; a later line of the
    same id starts it anew.  Needs the RocksDB state store, as every query with timers.
    """
    if "RocksDB" not in lines.sparkSession.conf.get(*STATE_STORE):
        raise RuntimeError(f"set {STATE_STORE[0]} to the RocksDB provider")
    final = F.coalesce(F.col("status").isin(*FINAL), F.lit(False)) if "status" in lines.columns else F.lit(False)
    staged = lines.where("message <> ''").select("task_id", "seq", "ts", "message", stage_of(F.col("message")).alias("stage"),
                                                 estimate_seconds().alias("estimate"), final.alias("final"))
    return staged.groupBy("task_id").transformWithStateInPandas(Progress(heartbeat_ms, ttl_ms), OUT_SCHEMA, "append", "processingTime")


def replay(lines: DataFrame, n: int = 20) -> DataFrame:
    """Last lines of every task, oldest first."""
    order = Window.partitionBy("task_id").orderBy(F.desc("seq"))
    return lines.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)
