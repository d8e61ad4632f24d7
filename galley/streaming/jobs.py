"""Streaming jobs: intake, status, daily uploads and the retention sweep."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galley.operators.workflow import expired_documents
from galley.plans.reports import Manuscripts, check_report
from galley.sources.sinks import write_findings

# Progress of a document at each step of its processing.
PROGRESS = {"started": 10, "checked": 75, "reported": 85, "rendered": 92, "done": 100, "error": 100}


def intake_stream(
    spark: SparkSession, source: DataFrame, findings_path: str, paragraphs_path: str, checkpoint: str, rules: dict | None = None
) -> StreamingQuery:
    """Check every manuscript of which paragraphs arrive, and store its findings.

    Paragraphs are stored first, and touched manuscripts are checked from the
    store, so a manuscript may arrive in several batches. A paragraph that comes
    again replaces the earlier one; a repeated batch leaves one result per document.
    """

    def check(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        session = batch.sparkSession
        batch.write.parquet(f"{paragraphs_path}/batch={time.time_ns()}")
        touched = batch.select("doc_id").distinct()
        fields = [c for c in batch.columns if c not in ("doc_id", "idx")]
        stored = session.read.parquet(paragraphs_path).join(touched, "doc_id", "left_semi")
        latest = stored.groupBy("doc_id", "idx").agg(F.max_by(F.struct(*fields), "batch").alias("p")).select("doc_id", "idx", "p.*")
        write_findings(session, check_report(Manuscripts(latest.select(batch.columns)), rules), touched, findings_path)

    return (
        source.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_status(events: DataFrame) -> DataFrame:
    """Latest status per document with its time: ``events(doc_id, step, message, ts)``."""
    value = F.col("step")
    progress = F.coalesce(*[F.when(value == s, n) for s, n in PROGRESS.items()], F.lit(0))
    status = F.when(value == "done", "done").when(value == "error", "error").otherwise("processing")
    # Of events with one time stamp, the one furthest along counts.
    latest = F.max_by(F.struct("step", "message", "ts", progress.alias("progress"), status.alias("status")),
                      F.struct("ts", progress.alias("at")))
    return events.groupBy("doc_id").agg(latest.alias("l")).select(
        "doc_id",
        "l.status",
        "l.progress",
        F.when(F.col("l.status") == "error", F.col("l.message")).alias("error"),
        "l.ts",
    )


def job_status(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand the latest status per document of every batch of events to ``sink``.

    The stream keeps no state; ``ts`` tells the sink which of two states is newer.
    """
    return (
        events.writeStream.foreachBatch(lambda batch, number: sink(latest_status(batch), number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def uploads_per_day(docs: DataFrame, late: str = "2 days") -> DataFrame:
    """Uploads per day over tumbling windows; on a stream, late rows are waited for."""
    rows = docs.withWatermark("uploaded_at", late) if docs.isStreaming else docs
    return (
        rows.groupBy(F.window("uploaded_at", "1 day").alias("w"))
        .agg(F.count("*").alias("uploads"))
        .select(F.to_date("w.start").alias("day"), "uploads")
    )


def retention_sweep(docs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Split documents into (kept, expired); run on a schedule over the whole table."""
    expired = expired_documents(docs, now)
    kept = docs.where(~F.coalesce(F.col("expires_at") < now, F.lit(False)))
    return kept, expired
