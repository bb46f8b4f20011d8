"""Learning tasks: enqueue rules, life cycle, and the feedback and audit joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.episodes import admission_reason, attributions, weight_updates
from ..operators.ranking import previous_value
from ..sources.index import index_rows, upsert_index

BUSY = ("queued", "running", "completed")
DECISION_SCHEMA = "episode_id string, seq long, decision string"


def enqueue_decisions_batch(events: DataFrame) -> DataFrame:
    """queued or duplicate per enqueue event, from the event before it.

    After any enqueue the task is busy, so only a status event that frees it (or
    no event at all) directly before an enqueue lets it through.
    """
    e = previous_value(events.select("episode_id", "seq", "event"), ["episode_id"], "seq", "event", "prev")
    ok = F.col("prev").isNull() | ~F.col("prev").isin("enqueue", *BUSY)
    return e.where("event = 'enqueue'").select("episode_id", "seq", F.when(ok, "queued").otherwise("duplicate").alias("decision"))


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    status = state.get[0] if state.exists else None
    for pdf in batches:
        out = []
        for row in pdf.sort_values("seq").itertuples(index=False):
            if row.event != "enqueue":
                status = row.event
            elif status in BUSY:
                out.append((key[0], row.seq, "duplicate"))
            else:
                status = "queued"
                out.append((key[0], row.seq, "queued"))
        yield pd.DataFrame(out, columns=["episode_id", "seq", "decision"])
    state.update((status,))


def enqueue_decisions(events: DataFrame) -> DataFrame:
    """The same rule on a stream, one status per episode as state."""
    return events.groupBy("episode_id").applyInPandasWithState(_decide, DECISION_SCHEMA, "status string", "append", "NoTimeout")


def task_outcomes(tasks: DataFrame, detections: DataFrame, prompts: DataFrame) -> DataFrame:
    """Final status and suggestion count of queued tasks: failed without an episode, no_op without suggestions."""
    upd = weight_updates(attributions(detections), prompts)
    n = upd.groupBy("episode_id").agg(F.count("new_weight").alias("n_suggestions"), F.count_if(F.col("old_weight").isNull()).alias("n_unknown"))
    known = detections.select("episode_id").distinct().withColumn("_known", F.lit(True))
    j = tasks.join(known, "episode_id", "left").join(n, "episode_id", "left")
    cnt = F.coalesce("n_suggestions", F.lit(0))
    status = F.when(F.col("_known").isNull(), "failed").when(cnt == 0, "no_op").otherwise("completed")
    return j.select("episode_id", status.alias("status"), cnt.cast("long").alias("n_suggestions"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"))


def run_tasks(decisions: DataFrame, detections: DataFrame, prompts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Learn for every queued task of each micro-batch; ``sink`` gets its rows as running, then with their outcome.

    Only detections of the batch's episodes are aggregated.  A batch that comes again gives the same rows.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        queued = batch.where("decision = 'queued'").select("episode_id").distinct().persist()
        if not queued.isEmpty():
            none = F.lit(0).cast("long")
            sink(queued.select("episode_id", F.lit("running").alias("status"), none.alias("n_suggestions"), none.alias("n_unknown")), epoch)
            sink(task_outcomes(queued, detections.join(queued, "episode_id", "left_semi"), prompts), epoch)
        queued.unpersist()

    return decisions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def close_requests(requests: DataFrame, reviews: DataFrame, wait: str = "7 days") -> DataFrame:
    """Requests with their review; streams keep open requests for ``wait``.

    The source of these logs has no event time; the bound is ours, and later
    reviews are left to the batch form of the same join, which has no bound.
    """
    bound = F.lit(True)
    q, r = requests, reviews.select(F.col("feedback_request_id").alias("_id"), F.col("ts").alias("reviewed_at"), "action")
    if requests.isStreaming or reviews.isStreaming:
        q, r = q.withWatermark("ts", wait), r.withWatermark("reviewed_at", wait)
        bound = F.col("reviewed_at") <= F.col("ts") + F.expr(f"INTERVAL {wait}")
    on = (F.col("feedback_request_id") == F.col("_id")) & (F.col("reviewed_at") >= F.col("ts")) & bound
    return q.join(r, on).drop("_id")


def finalize(episodes: DataFrame, audits: DataFrame, wait: str = "1 day") -> DataFrame:
    """Admission of episodes whose audit arrived; streams wait for ``wait``.

    Audits that come later are picked up by the batch form, which reads both
    logs whole and has no bound.
    """
    bound = F.lit(True)
    a = audits.select(F.col("episode_id").alias("_id"), F.col("ts").alias("audited_at"), "dims", "output_mode")
    e = episodes.drop("output_mode")
    if episodes.isStreaming or audits.isStreaming:
        e, a = e.withWatermark("ts", wait), a.withWatermark("audited_at", wait)
        bound = F.col("audited_at") <= F.col("ts") + F.expr(f"INTERVAL {wait}")
    on = (F.col("episode_id") == F.col("_id")) & (F.col("audited_at") >= F.col("ts")) & bound
    j = e.join(a, on).drop("_id")
    return j.withColumn("reason", admission_reason(F.col("dims"), F.col("output_mode"))).withColumn("admitted", F.col("reason") == "ok")


def refresh_index(finalized: DataFrame, path: str, checkpoint: str, size: int = 128):
    """Writer that puts every finalized episode into the stored index at ``path``, one upsert per micro-batch.

    An episode audited twice in a batch counts as its last audit says; one that fails a later audit stays in the index
    as not audited, so searches leave it out.  ``checkpoint`` names the stream, as its batches are counted from there.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("episode_id").agg(F.max_by(F.struct("embedding", "reason"), F.struct("audited_at", "reason")).alias("_r")).select("episode_id", "_r.*")
        upsert_index(index_rows(last, size), path, epoch, checkpoint)

    return finalized.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
